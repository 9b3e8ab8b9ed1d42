"""Quality rules as a short-circuit cascade.

Each rule's cost and share of rejections are estimated on a sample; rules then
run in order of rejections per cost and stop at the first that rejects. The
verdict is whether all rules pass, so it doesn't depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property, partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import column, pieces, ship

SYMBOLS, SPACES, MIN_WORDS, MAX_REPEAT = "#*$%&|<>", " \t\n\v\f\r", 50, 50
#: Rows on which costs and rejections are estimated.
SAMPLE = 2000
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class View:
    """What the rules ask of one text; each part is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, self.words, count()), np.int64, n)
        pair = ids[:-1] * n + ids[1:]
        if n >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        triple = pair[:-1] * n + ids[2:]
        order = np.argsort(triple, kind="stable")
        same = np.flatnonzero(np.diff(triple[order]) == 0)
        covered = np.zeros(n, bool)
        for start in (order[same], order[same + 1]):
            for k in range(3):
                covered[start + k] = True
        return int(covered.sum())

    @cached_property
    def shouting(self) -> float:
        """Share of upper case among cased letters."""
        low, up = self.text.lower(), self.text.upper()
        if len(low) != len(self.text) or len(up) != len(self.text):
            cased = [c for c in self.text if c.lower() != c.upper()]
            return sum(c.isupper() for c in cased) / max(1, len(cased))
        chars = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (self.text, low, up)]
        return int((chars[0] != chars[1]).sum()) / max(1, int((chars[1] != chars[2]).sum()))


#: Name -> whether it rejects. The first two are the base rules.
RULES: dict[str, Callable[[View], bool]] = {
    "few_words": lambda v: v.n_words < MIN_WORDS,
    "repeated_windows": lambda v: 100 * v.n_repeat_words > MAX_REPEAT * v.n_words,
    "symbols": lambda v: v.n_symbols > 0.3 * v.n_words,
    "word_length": lambda v: not 2 * v.n_words <= v.word_chars <= 20 * v.n_words,
    "repeated_lines": lambda v: v.n_dup_lines > 0.5 * len(v.lines),
    "shouting": lambda v: v.shouting > 0.6,
}
BASE = ("few_words", "repeated_windows")


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = []
        for name, rule in RULES.items():
            took = rejected = 0
            for text in (texts := column(batch, "text")):
                view, began = View(text), time.thread_time_ns()
                rejected += bool(rule(view))
                took += time.thread_time_ns() - began
            rows.append((name, len(texts), rejected, took))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["rule", "n", "rejected", "ns"])


def plan_cascade(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The rules by rejections per cost, estimated on about ``sample`` rows drawn from all of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.count()
    drawn = docs.select(docs["text"].cast("string")).sample(fraction=min(1.0, sample / max(rows, 1)), seed=7)
    found = drawn.mapInArrow(_profile, "rule string, n long, rejected long, ns long").groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("ns")).collect()
    gain = {name: (rejected + 0.5) / max(ns, 1) for name, _, rejected, ns in found}
    return sorted(RULES, key=lambda x: (-gain.get(x, 0.0), x))


def rejected(view: View, order: list[str]) -> bool:
    return any(RULES[name](view) for name in order)


def _measure(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = []
        for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text")):
            v = View(text)
            base = any(RULES[x](v) for x in BASE)
            rows.append((doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, base, not (base or rejected(v, order))))
        types = [pa.int64()] * 6 + [pa.bool_()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in MEASURES.split(", ")])


def _keep(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        yield batch.filter(pa.array([not rejected(View(t), order) for t in column(batch, "text")], pa.bool_()))


def measure(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The base measures and the verdict of every document.

    Null texts count as empty, which fails; repeated rows give repeated rows;
    an empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    order = order or plan_cascade(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_measure, order=order), MEASURES)


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    ship(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, order=order or plan_cascade(docs)), docs.schema)
