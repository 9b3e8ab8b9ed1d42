"""Operators written as one SELECT over named frames.

The text is Spark SQL; frames stand in it as ``{px}``, ``{fin}`` and so on, and
``apply`` runs it on any frames with those columns. For the comparison with
DuckDB the same SELECT is read over that engine's views, so the text keeps to
what both understand; where they differ it says ``DAYS(a, b)`` (from a to b),
``MONTH_OF(d)`` (its first day), ``LASTSEEN(x) OVER`` and ``NEXTSEEN(x)
OVER`` (the last and the first value that isn't null), ``PEARSON(x, y)`` and
``PEARSON_OVER(x, y, w)`` (a correlation, NaN where a side is constant),
``NEAREST(x)`` (the nearest integer, the even one of two) or ``RAT(x, y)`` (a quotient, null where y is null or smaller than
1e-9).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.plans import statements, views
from panelweave.plans.fixtures import FIXTURES
from panelweave.registry import query

TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents", "pages", "labels")
FRAMES = {"px": views.prices, "filings": views.filings, "peers": views.peers, "fin": statements.statements, "day": statements.daily, "macro": statements.macro}
NAMED = re.compile(r"\{(\w+)\}")
TEXTS: dict[str, str] = {}
PLANNED: dict[str, Callable[..., DataFrame]] = {}


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose parenthesis opens at ``at``, and where it ends."""
    depth, start, found = 0, at + 1, []
    for k in range(at, len(text)):
        if text[k] == "(":
            depth += 1
        elif text[k] == ")":
            depth -= 1
            if not depth:
                return [*found, text[start:k].strip()], k + 1
        elif text[k] == "," and depth == 1:
            found.append(text[start:k].strip())
            start = k + 1
    raise ValueError(f"no closing parenthesis: {text[at:]}")


def expand(text: str, forms: dict[str, str]) -> str:
    """Replaces each short form by its text, inner ones first."""
    for name, form in forms.items():
        while found := list(re.finditer(rf"\b{name}\(", text)):
            at = found[-1]
            given, end = arguments(text, at.end() - 1)
            for k, x in enumerate(given):
                text_of = form if not k else made
                made = text_of.replace(f"${k + 1}", x)
            text = text[: at.start()] + made + text[end:]
    return text


#: Spark's corr stops where a side is constant; DuckDB's is NaN there, as this is.
PEARSON = "coalesce(try_divide(regr_sxy($1, $2){0}, sqrt(regr_sxx($1, $2){0} * regr_syy($1, $2){0})), CASE WHEN regr_count($1, $2){0} > 0 THEN CAST('NaN' AS DOUBLE) END)"
RATIO = "(CASE WHEN abs($2) >= 1e-9 THEN ($1) / ($2) END)"
SPARK_FORMS = {"RAT": RATIO, "LASTSEEN": "last($1, true)", "NEXTSEEN": "first($1, true)", "DAYS": "datediff($2, $1)", "MONTH_OF": "CAST(date_trunc('month', $1) AS DATE)", "PEARSON": PEARSON.format(""), "PEARSON_OVER": PEARSON.format(" OVER $3"), "NEAREST": "CAST(rint($1) AS INT)"}
DUCK_FORMS = {"RAT": RATIO, "LASTSEEN": "last_value($1 IGNORE NULLS)", "NEXTSEEN": "first_value($1 IGNORE NULLS)", "DAYS": "CAST(date_diff('day', $1, $2) AS INTEGER)", "MONTH_OF": "CAST(date_trunc('month', $1) AS DATE)", "PEARSON": "corr($1, $2)", "PEARSON_OVER": "corr($1, $2) OVER $3", "NEAREST": "CAST($1 AS INT)"}


def apply(name: str, spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """Runs a registered operator on the given frames. Where a fixture isn't given, the frame that it would be made from takes its place, as it is."""
    for x in dict.fromkeys(NAMED.findall(TEXTS[name])):
        made = x
        while made in FIXTURES and made not in frames:
            made = NAMED.search(FIXTURES[made])[1]
        if x not in frames and made in frames:
            frames[x] = frames[made]
    used = {x: frames[x] for x in dict.fromkeys(NAMED.findall(TEXTS[name]))}
    return PLANNED[name](spark, **used) if name in PLANNED else spark.sql(expand(TEXTS[name], SPARK_FORMS), **used)


def select(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs a SELECT over named frames, made from the tables."""
    return spark.sql(expand(" ".join(text.split()), SPARK_FORMS), **{x: frame(x, spark, sf_dir) for x in dict.fromkeys(NAMED.findall(text))})


def frame(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view, a fixture or a table by its name."""
    if name in FIXTURES:
        return select(FIXTURES[name], spark, sf_dir)
    return FRAMES[name](spark, sf_dir) if name in FRAMES else views.table(spark, sf_dir, name)


def with_fixtures(text: str) -> str:
    """The text without braces, the fixtures that it names before it."""
    found: dict[str, str] = {}

    def need(of: str) -> None:
        for x in NAMED.findall(of):
            if x in FIXTURES and x not in found:
                need(FIXTURES[x])
                found[x] = f"{x} AS ({FIXTURES[x]})"

    need(text)
    if found:
        head = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
        text = head + ", ".join(found.values()) + (", " + text[len(head) :] if text.startswith("WITH ") else " " + text)
    return NAMED.sub(lambda m: m.group(1), text)


def sql_query(name: str, text: str, planned: str | Callable[..., DataFrame] | None = None) -> None:
    """Registers ``text`` as a query over the frames that it names, and as its own SQL for DuckDB; Spark runs ``planned``, a text of the same result or a function of the session and those frames, where it is given."""
    oracle = expand(with_fixtures(" ".join(text.split())), DUCK_FORMS)
    if callable(planned):
        PLANNED[name], planned = planned, None
    text = " ".join((planned or text).split())
    TEXTS[name] = text

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name in PLANNED:
            return PLANNED[name](spark, **{x: frame(x, spark, sf_dir) for x in dict.fromkeys(NAMED.findall(text))})
        return select(text, spark, sf_dir)

    run.__name__ = name
    query(name, oracle)(run)


def rounded(columns: dict[str, str], digits: int = 6) -> str:
    """A select list of doubles."""
    return ", ".join(f"round(CAST({e} AS DOUBLE) + 1e-{digits + 3}, {digits}) AS {x}" for x, e in columns.items())


def ratios(columns: dict[str, tuple[str, str]]) -> str:
    """A select list of quotients, each with its two flags: no value, and a denominator that is null or too small."""
    out = []
    for x, (num, den) in columns.items():
        out.append(f"round(RAT({num}, {den}) + 1e-9, 6) AS {x}, CAST(RAT({num}, {den}) IS NULL AS INT) AS is_missing_{x}, CAST(coalesce(abs({den}) < 1e-9, true) AS INT) AS invalid_math_{x}")
    return ", ".join(out)
