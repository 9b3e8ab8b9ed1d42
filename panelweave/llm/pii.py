"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are base spans (email, ip, card, phone), look-alikes that fail a
base check, and looser forms (credentials, phone numbers without a plus, social
security numbers, account numbers). A regex, a gazetteer and a context labeler
vote on each; expectation-maximisation over the counts of vote patterns
estimates how reliable each is, and a classifier over span features is trained
on the posteriors. Candidates it accepts are added where they overlap no base
span; base spans always stay.

Positions come from splitting a text by the pattern that also extracts its
matches, so gaps and matches alternate. Patterns are possessive and start only
where a run starts, so they take linear time on any text; running sums and
maxima over matches go block by block, and pieces of a long text are taken
from chunks of it, since appending to an array and counting code points from
the text's start would take the square of its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import materialize

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Kind, in the order in which spans with one start are listed, and its pattern.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = r"(?<![A-Za-z0-9+/@._-])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?:password|passwd|token|secret|api_key) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,}+\"?|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Z0-9]))"
KINDS = (*BASE, "secret", "local_phone", "ssn", "iban")
#: Gazetteers: top-level domains, country calling codes, first digits of card issuers. Fixed values.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
ISSUERS = "3[47]|4|5[1-5]|2[2-7]|6[045]"
#: Words close before a span that speak for it, by kind, and against any.
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|client", "card": "card|visa|credit|pay|amex", "phone": "tel|phone|call|fax|mobile",
    "secret": "key|pass|token|secret|login", "local_phone": "tel|phone|call|fax|mobile", "ssn": "ssn|social|security", "iban": "iban|account|bank",
}
AGAINST = "version|page|figure|section|isbn|order|invoice|line|chapter|release"
LABELERS = ("regex", "gazetteer", "context")
FEATURES = ("kind", "before", "after", "length")
ROUNDS = 8
BEFORE = 24
#: Matches of a block of a running sum; code points of a chunk of a text that is longer than some of them.
BLOCK, CHUNK = 128, 1024
SPANS = "array<struct<start:int,end:int,hit:string>>"


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """What an associative ``step`` has made of all values before each one and, last, of all of them."""

    def scanned(part: Column, first: Column) -> Column:
        nothing = F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, nothing, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocks(n: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    part = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    sums = F.transform(blocks(F.size(values)), lambda b: F.aggregate(part(b), zero, step))
    # the sums are scanned once, then each block from what came before it
    heads = scanned(sums, zero)
    each = F.flatten(F.transform(F.arrays_zip(heads["out"].alias("first"), blocks(F.size(values)).alias("b")), lambda x: scanned(part(x["b"]), x["first"])["out"]))
    few = scanned(values, zero)
    few = F.transform(F.array(few), lambda x: F.concat(x["out"], F.array(x["at"])))[0]
    many = F.transform(F.array(heads["at"]), lambda x: F.concat(each, F.array(x)))[0]
    return F.when(F.size(values) == 0, F.array(zero)).when(F.size(values) <= BLOCK, few).otherwise(many)


def chunks(text: Column) -> Column:
    return F.when(F.length(text) > 4 * CHUNK, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(text))


def taken(parts: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to ``end`` of the text whose ``chunks`` are given."""
    first, last = F.floor(begin / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    some = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    one = F.substring(F.get(parts, F.lit(0)), begin + 1, end - begin)
    return F.when(end <= begin, "").when(F.size(parts) == 1, one).otherwise(F.substring(some, begin - first * CHUNK + 1, end - begin))


def found(kind: str, text: str, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern, and the lengths of the gaps around them where there are any."""
    quoted = F.lit(pattern)
    hits = F.regexp_extract_all(text, quoted, F.lit(0))
    if kind == "email":
        hits = F.when(F.contains(F.col(text), F.lit("@")), hits).otherwise(F.array().cast("array<string>"))
    return hits, F.when(F.size(f"m_{kind}") > 0, F.transform(F.split(text, pattern, -1), F.length))


def lengths(kind: str) -> Column:
    """The lengths of the gap before each match and of the match, in turn."""
    hits, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    return F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.array(gap, F.length(hit))))


def spans(kind: str) -> Column:
    """Structs of start, end and the match, in code points; ``p_kind`` is the running sum of ``lengths``."""
    hits, ends = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    made = F.transform(hits, lambda hit, k: F.struct(F.get(ends, 2 * k + 1).alias("start"), F.get(ends, 2 * k + 2).alias("end"), hit.alias("hit")))
    return F.when(F.size(hits) > 0, made).otherwise(F.array().cast(SPANS))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    doubled = lambda d, k: F.when((n - k) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + doubled(F.substring(number, k, F.lit(1)).cast("int"), k))
    return total % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """The base checks beyond the pattern."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = digits(hit)
        return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def loose_kind(hit: Column) -> Column:
    return F.when(hit.rlike("^[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-]"), "local_phone").when(hit.rlike("^[0-9]{3}-[0-9]{2}-"), "ssn").when(hit.rlike("^(AKIA|[a-z_]+ ?[=:])"), "secret").otherwise("iban")


def gazetteer(kind: Column, hit: Column) -> Column:
    """1, 0 or -1."""
    number = digits(hit)
    yes = (
        F.when(kind == "email", hit.rlike(rf"(?i)\.({DOMAINS})$"))
        .when(kind == "ip", ~hit.rlike(r"^0*(0|10|127|22[4-9]|2[345][0-9])\."))
        .when(kind == "card", number.rlike(f"^({ISSUERS})"))
        .when(kind == "phone", number.rlike(f"^({CALLING})"))
        .when(kind == "secret", hit.rlike("^AKIA|[0-9]"))
        .when(kind == "local_phone", ~number.rlike("^[01]"))
        .when(kind == "ssn", ~number.rlike("^(000|666|9)"))
        .otherwise(hit.rlike("^(DE|FR|ES|GB|IT|NL|BE|AT|CH)"))
    )
    return F.when(yes, 1).otherwise(-1)


def context(kind: Column, before: Column) -> Column:
    low = F.lower(before)
    return F.when(low.rlike(rf"\b({AGAINST})\b[^a-z]*$"), -1).when(reduce(lambda x, k: x.when(kind == k, low.rlike(CUES[k])), KINDS[1:], F.when(kind == KINDS[0], low.rlike(CUES[KINDS[0]]))), 1).otherwise(0)


def side(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")) == "", "edge").when(char.rlike(r"[\s]"), "space").when(char.rlike("[A-Za-z0-9]"), "word").otherwise("mark")


def checked(no: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"), F.coalesce(valid(kind, s["hit"]), F.lit(False)).alias("ok"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``_keep``, a struct of the columns ``keep``, and for every document its base spans ``base`` and all candidates ``cand`` with votes and features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.struct(*keep).alias("_keep"), text.alias("_t"))
    keep = ["_keep"]
    every = {**BASE, "loose": LOOSE}
    df = df.select("*", *[found(k, "_t", p)[0].alias(f"m_{k}") for k, p in every.items()])
    df = df.select("*", *[found(k, "_t", p)[1].alias(f"g_{k}") for k, p in every.items()])
    df = df.select("*", *[F.when(F.size(f"m_{k}") > 0, lengths(k)).alias(f"l_{k}") for k in every])
    df = df.select("*", chunks(F.col("_t")).alias("_p"), *[F.when(F.size(f"m_{k}") > 0, running(F.col(f"l_{k}"), F.lit(0), lambda a, x: a + x)).alias(f"p_{k}") for k in every])
    df = df.select(*keep, "_p", *[spans(k).alias(f"s_{k}") for k in every])
    typed = [F.transform(f"s_{k}", checked(n, k)) for n, k in enumerate(BASE)]
    number = lambda kind: reduce(lambda x, n: x.when(kind == KINDS[n], n), range(5, len(KINDS)), F.when(kind == KINDS[4], 4))
    loose = F.transform("s_loose", lambda s: F.struct(s["start"].alias("start"), number(loose_kind(s["hit"])).alias("no"), loose_kind(s["hit"]).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(None).cast("boolean").alias("ok")))
    df = df.select(*keep, "_p", F.concat(*typed).alias("b"), loose.alias("l"))
    # what fails by far is no candidate: short numbers are everywhere
    near = F.filter("b", lambda s: s["ok"] | F.length(digits(s["hit"])).between(9, 20))
    df = df.select(*keep, "_p", F.array_sort(F.transform(F.filter("b", lambda s: s["ok"]), lambda s: s.dropFields("hit", "ok"))).alias("base"), F.concat(near, "l").alias("c"))

    def voted(s: Column) -> Column:
        text = F.col("_p")
        before = taken(text, F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
        return F.struct(
            s["start"].alias("start"), s["no"].alias("no"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.when(s["ok"], 1).when(~s["ok"], -1).otherwise(0).alias("regex"), gazetteer(s["kind"], s["hit"]).alias("gazetteer"), context(s["kind"], before).alias("context"),
            F.when(s["start"] == 0, "edge").otherwise(side(F.right(before, F.lit(1)))).alias("before"), side(taken(text, s["end"], s["end"] + 1)).alias("after"),
            F.least(F.floor((s["end"] - s["start"]) / 4), F.lit(9)).cast("string").alias("length"),
        )

    return df.select(*keep, "base", F.transform("c", voted).alias("cand"))


def fit(cells: DataFrame) -> tuple[dict[str, dict], float]:
    """Log-odds of each feature's values, and of the whole.

    ``cells`` counts candidates by votes and features, at most a few ten
    thousand rows whatever the corpus holds. Each round of
    expectation-maximisation is one aggregation of it to a single row.
    """
    votes = (-1, 0, 1)
    rate = {y: {x: {v: {-1: 0.2, 0: 0.4, 1: 0.4}[v] if y else {-1: 0.5, 0: 0.4, 1: 0.1}[v] for v in votes} for x in LABELERS} for y in (0, 1)}
    prior = dict.fromkeys(KINDS, 0.7)

    def posterior() -> Column:
        odds = reduce(lambda c, k: c.when(F.col("kind") == k, math.log(prior[k] / (1 - prior[k]))), KINDS[1:], F.when(F.col("kind") == KINDS[0], math.log(prior[KINDS[0]] / (1 - prior[KINDS[0]]))))
        for x in LABELERS:
            for v in votes:
                odds = odds + F.when(F.col(x) == v, math.log(rate[1][x][v] / rate[0][x][v])).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    for _ in range(ROUNDS):
        p = cells.select("*", posterior().alias("p"))
        sums = [F.sum(F.when(F.col(x) == v, F.col("n") * (F.col("p") if y else 1 - F.col("p")))).alias(f"{x}{v}{y}") for x in LABELERS for v in votes for y in (0, 1)]
        sums += [F.sum(F.when(F.col("kind") == k, F.col("n") * w)).alias(f"{k}_{i}") for k in KINDS for i, w in enumerate((F.lit(1.0), F.col("p")))]
        row = p.agg(*sums).first().asDict()
        for y in (0, 1):
            for x in LABELERS:
                total = sum(row[f"{x}{v}{y}"] or 0 for v in votes)
                for v in votes:
                    rate[y][x][v] = ((row[f"{x}{v}{y}"] or 0) + 1) / (total + 3)
        for k in KINDS:
            prior[k] = min(0.99, max(0.01, ((row[f"{k}_1"] or 0) + 1.4) / ((row[f"{k}_0"] or 0) + 2)))
    p = cells.select("*", posterior().alias("p"))
    weights: dict[str, dict] = {}
    long = p.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in (*FEATURES, *LABELERS)])).alias("x"), "n", "p")
    whole = p.agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))).first()
    yes, no = (whole[0] or 0) + 1, (whole[1] or 0) + 1
    for r in long.groupBy("x.f", "x.v").agg(F.sum(F.col("n") * F.col("p")).alias("a"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b")).orderBy("f", "v").collect():
        weights.setdefault(r["f"], {})[r["v"]] = math.log((r["a"] + 1) / (yes + 10)) - math.log((r["b"] + 1) / (no + 10))
    return weights, math.log(yes / no)


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``_keep``, a struct of the columns ``keep``, and the spans of every document: ``base`` and ``found`` (base and accepted ones), sorted.

    Spans have start, no, kind and end. A null text counts as empty and has no
    spans; repeated rows stay; an empty table gives none.
    """
    keep = keep or ["doc_id"]
    own = materialize(candidates(docs, keep), "pii-candidates")
    votes = [*LABELERS, *FEATURES]
    cells = own.select(F.explode("cand").alias("c")).groupBy(*[F.col(f"c.{v}").alias(v) for v in votes]).agg(F.count("*").alias("n"))
    weights, whole = fit(materialize(cells, "pii-cells"))

    def accepted(c: Column) -> Column:
        odds = F.lit(whole)
        for f, own_weights in weights.items():
            table = F.create_map(*[F.lit(x) for kv in own_weights.items() for x in kv])
            odds = odds + F.coalesce(F.element_at(table, c[f].cast("string")), F.lit(0.0))
        return odds >= 0

    def event(at: Column, base: int, end: Column, s: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(base).alias("base"), end.alias("end"), s["start"].alias("start"), s["no"].alias("no"), s["kind"].alias("kind"), s["end"].alias("stop"))

    # A candidate is clear of base spans if of those that start before its end none ends after its start.
    extra = F.filter("cand", lambda c: (c["regex"] != 1) & accepted(c))
    own = own.select("_keep", "base", extra.alias("extra"))
    events = F.array_sort(F.concat(F.transform("base", lambda b: event(b["start"], 1, b["end"], b)), F.transform("extra", lambda c: event(c["end"], 0, F.lit(0), c))))
    own = own.select("_keep", "base", F.when(F.size("extra") > 0, events).alias("events"))
    own = own.select("*", F.when(F.col("events").isNotNull(), running(F.transform("events", lambda e: e["end"]), F.lit(0), lambda a, x: F.greatest(a, x))).alias("reached"))
    clear = F.transform("events", lambda e, k: F.when((e["base"] == 0) & (F.get("reached", k) <= e["start"]), F.struct(e["start"].alias("start"), e["no"].alias("no"), e["kind"].alias("kind"), e["stop"].alias("end"))))
    return own.select("_keep", "base", F.when(F.col("events").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.array_compact(clear)))).alias("found"))


def listed(spans_of: str) -> Column:
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans of each kind, the digest of their list, and all spans."""
    df = detect(docs.select(F.col("doc_id").cast("long"), "text"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("_keep.doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; n_chars, where there is one, counts the new text."""
    names = docs.columns
    text = F.col("_keep.text")
    df = detect(docs, names)
    some = F.size("found") > 0
    df = df.select("*", F.when(some, chunks(text)).alias("_p"), F.when(some, running(F.transform("found", lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))).alias("reached"))
    # a span that begins within one before it is covered by that one's mark
    marked = F.transform("found", lambda s, k: F.when(s["start"] >= F.get("reached", k), F.concat(taken(F.col("_p"), F.get("reached", k), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    done = F.concat(F.array_join(marked, ""), taken(F.col("_p"), F.get("reached", F.size("found")), F.length(text)))
    new = {x: F.col(f"_keep.`{x}`") for x in names}
    new["text"] = F.when(F.size("found") > 0, done).otherwise(text)
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("found") > 0, F.length(new["text"])).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return df.select(*[c.alias(x) for x, c in new.items()])
