"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps case, homoglyphs and digits to plain letters, so that spellings
which look alike meet. The lexicon holds whole words and word beginnings with
their log-odds of the label, learned on a bounded sample of labelled rows;
hits within exception phrases don't count: a few that are given, and pairs of
words with a lexicon word that clean rows of the sample use more than toxic
ones. The sum is normalised by length and a logistic curve, fitted on the same
rows, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import column, pieces, ship

#: Labelled rows that the lexicon is learned on, at most about so many of each label.
MAX_TOXIC, MAX_CLEAN = 6000, 12_000
#: A term needs so many different toxic documents and so much log-odds; an exception so many different clean ones.
MIN_DOCS, MIN_ODDS, MIN_CLEAN = 6, 2.5, 6
PREFIXES = (4, 5, 6)
#: Phrases in which a lexicon word says nothing about tone.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "stupid mistake of mine", "pond scum", "soap scum")
#: Letters that look like Latin ones, digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "ı": "i",
}
FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | dict.fromkeys("​‌‍­﻿", ""))
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def fold(text: str) -> str:
    return text.lower().translate(FOLD).replace("ı", "i")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        """Term -> (weight as a whole word, weight as a word's beginning, whether it is an exception)."""
        found: dict[str, list] = {}
        for at, terms in ((0, self.words), (1, self.starts)):
            for term, weight in terms.items():
                found.setdefault(term, [0.0, 0.0, False])[at] = weight
        for phrase in self.exceptions:
            found.setdefault(fold(phrase), [0.0, 0.0, False])[2] = True
        made = ahocorasick.Automaton()
        for term, value in found.items():
            made.add_word(term, (len(term), *value))
        if found:
            made.make_automaton()
        return made


def features(text: str | None, auto: ahocorasick.Automaton) -> tuple[float, float, float]:
    """log(1 + hits), weight by log length, hits per hundred words."""
    folded = fold(text or "")
    best: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    n = len(folded)
    for end, (size, whole, start, exempt) in auto.iter(folded) if len(auto) else ():
        at = end - size + 1
        if at and folded[at - 1].isalnum():
            continue
        closed = end + 1 == n or not folded[end + 1].isalnum()
        if exempt and closed:
            free.append((at, end))
        weight = max(whole if closed else 0.0, start)
        if weight > best.get(at, 0.0):
            best[at] = weight
    if free:
        best = {at: w for at, w in best.items() if not any(a <= at <= b for a, b in free)}
    words = folded.count(" ") + folded.count("\n") + 1
    return math.log1p(len(best)), sum(best.values()) / (1 + math.log1p(words)), 100 * len(best) / words


def score(x: tuple[float, float, float], curve: tuple[float, ...]) -> float:
    z = curve[0] + sum(a * b for a, b in zip(curve[1:], (x[0], x[1], min(x[2], 10.0))))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x[:, 0], x[:, 1], np.minimum(x[:, 2], 10.0)))
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, ridge, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
    return tuple(float(v) for v in w)


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of five words in a row, which near copies mostly share."""
    for batch in pieces(batches):
        sig = []
        for text in column(batch, "text"):
            w = (text or "").lower().split()
            sig.append(min((xxhash.xxh64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))), default=0) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.int64())], names=[*batch.schema.names, "sig"])


def word_list(text: str | None) -> list[str]:
    return [w.strip("'") for w in fold(text or "").replace("’", "'").translate(PUNCTUATION).split()]


def _terms(batches: Iterator[pa.RecordBatch], lexicon: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Weights of the rows that hold each word and beginning; with a lexicon, each pair of words of which one is in it."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in pieces(batches):
        for text, toxic, weight in zip(column(batch, "text"), column(batch, "toxic"), column(batch, "weight")):
            words = word_list(text)
            if lexicon is None:
                found = {("w", w) for w in words} | {("p", w[:k]) for w in words for k in PREFIXES if len(w) > k}
            else:
                found = {("e", f"{a} {b}") for a, b in zip(words, words[1:]) if a in lexicon or b in lexicon}
            for term in found:
                counts[toxic][term] += weight
    rows = [(k, w, float(counts[1][k, w]), float(counts[0][k, w])) for k, w in counts[0].keys() | counts[1].keys()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["kind", "term", "toxic", "clean"])


PUNCTUATION = str.maketrans(dict.fromkeys(".,;:!?\"()[]{}<>|/\\*#-–—…«»“”„_=+%&~", " "))


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    auto = model.automaton()
    for batch in pieces(batches):
        found = np.array([features(t, auto) for t in column(batch, "text")])
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in ("toxic", "weight")], *map(pa.array, found.T)], names=["toxic", "weight", "a", "b", "c"])


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learns lexicon and curve from labelled rows whose crc32(doc_id) mod 5 isn't 0.

    The sample is drawn by a hash of the doc_id and bounded for each label;
    those ids are broadcast. Documents that share a signature have one
    document's weight together, so that copies don't outweigh the rest.
    Rows without a label or text are left out; without labelled rows of both
    kinds the model is empty and scores all documents low.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = dict(usable.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return Model()
    rank = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("toxic") == 1, max_toxic / n[1]).otherwise(max_clean / n[0])
    sample = F.broadcast(usable.where(rank < share))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(sample, "doc_id")
    # one text for each id, so that the ids' bound is the rows' bound as well
    own = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    own = own.select("text", "toxic").mapInArrow(_signature, "text string, toxic int, sig long").cache()
    drawn = own
    copies = F.broadcast(own.groupBy("sig").agg((1 / F.count("*")).alias("weight")))  # no more rows than the bounded sample
    own = own.join(copies, "sig").select("text", "toxic", "weight")
    n = dict(own.groupBy("toxic").agg(F.round(F.sum("weight"), 6)).collect())
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    sums = [F.round(F.sum(x), 6).alias(x) for x in ("toxic", "clean")]  # so that the order of adding doesn't matter
    schema = "kind string, term string, toxic double, clean double"
    terms = own.mapInArrow(_terms, schema).groupBy("kind", "term").agg(*sums)
    terms = terms.where(F.col("toxic") >= MIN_DOCS).select("kind", "term", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS)
    found = terms.orderBy(F.desc("odds"), "kind", "term").collect()  # no more than the bounded sample can support
    model = Model({r["term"]: r["odds"] for r in found if r["kind"] == "w"}, {r["term"]: r["odds"] for r in found if r["kind"] == "p"})
    pairs = own.mapInArrow(partial(_terms, lexicon=frozenset(model.words)), schema).groupBy("kind", "term").agg(*sums)
    usual = pairs.where((F.col("clean") >= MIN_CLEAN) & (odds <= 0)).orderBy("term").collect()
    model.exceptions = (*EXCEPTIONS, *(r["term"] for r in usual))
    rows = np.array(own.mapInArrow(partial(_features, model=model), "toxic int, weight double, a double, b double, c double").collect(), float).reshape(-1, 5)
    drawn.unpersist()
    if len(rows):
        rows = rows[np.lexsort(rows.T)]
        model.curve = fit_curve(rows[:, 2:], rows[:, 0], rows[:, 1])
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    auto = model.automaton()
    for batch in pieces(batches):
        found = [score(features(t, auto), model.curve) for t in column(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=[x.split()[0] for x in RESULT.split(", ")])


def _clean(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    auto = model.automaton()
    for batch in pieces(batches):
        yield batch.filter(pa.array([score(features(t, auto), model.curve) < 0.5 for t in column(batch, "text")], pa.bool_()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Every whole text's score; null texts count as empty, repeated rows stay, other columns are ignored."""
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(partial(_score, model=model), RESULT)


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    ship(docs.sparkSession)
    return docs.mapInArrow(partial(_clean, model=model), docs.schema)
