"""Benchmark decontamination by suffix arrays over the training text.

Tasks cut their documents into shards, number the words by the benchmark's
vocabulary, and sort the suffixes of a shard by doubling. Every suffix of every
benchmark item is then looked up by binary search in every shard: its
neighbours give the longest verbatim match, and where that is at least a
window, the range of suffixes that begin with the window gives all places. The
affected documents are removed, or marked.

Words that no item has end a match, so suffixes that meet one within the
shortest window are left out of the array: no search can end there. Suffixes
are sorted up to the longest item's length, beyond which no search looks.

The benchmark goes to the tasks in blocks of bounded size, one pass over the
documents for each; long items are cut into pieces that share all but one word
of a window. A document of any length is searched shard by shard in its task.

Edge cases: null and wordless texts have no words and no hits; wordless items
have no window; an item of fewer words than a window is one window; repeated
rows are marked each; items of one id count once, a null id is named ``null``;
an empty table of documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import materialize, pieces, ship

WINDOW, SHARD_WORDS, SHARD_BYTES, BLOCK_BYTES, PIECE_WORDS, SLICE, STRIDE = 10, 1 << 20, 8 << 20, 16 << 20, 1 << 15, 1 << 20, 16
#: On bytes: lower-cased letters, digits and all bytes of characters beyond ASCII are words.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
SPANS = "array<struct<start: long, stop: long>>"
MARKS = f"n_words long, spans {SPANS}, items array<string>"
MATCHES = "doc_id long, doc_word long, item_id string, item_word long, n_words long"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch at a time. ``bytes.lower`` changes A to Z only."""
    low, at = text.lower(), 0
    while at < len(low):
        gap = GAP.search(low, at + SLICE)
        end = gap.start() if gap else len(low)
        yield WORD.findall(low, at, end)
        at = end


@dataclass(frozen=True)
class Tests:
    """A block of the benchmark. ``flat`` holds each different word sequence once, a zero after each.

    Suffix ``k`` is ``flat[start[k]:start[k] + length[k]]`` and begins with window
    class ``kind[k]`` of ``window[kind]`` words; the items of a class are
    ``owners[first[kind]:first[kind + 1]]``, numbers of ``names``, which is sorted.
    """

    vocabulary: dict[bytes, int]
    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    kind: np.ndarray
    window: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    names: list[str]
    places: list[tuple[int, list[tuple[str, int]]]]

    @classmethod
    def of(cls, rows: list[tuple[str, int, bytes]], window: int = WINDOW) -> Tests:
        """From pieces of items: id, number of the item's words before it, its words with spaces between."""
        texts: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, at, text in rows:
            texts[text].append((name, at))
        names = sorted({name for name, _, _ in rows})
        number = {name: k for k, name in enumerate(names)}
        vocabulary: dict[bytes, int] = {}
        flat, start, length, kind, kinds, sizes, owners, places = [], [], [], [], {}, [], [], []
        for text in sorted(texts):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in text.split(b" ")]
            at, own = len(flat), {number[name] for name, _ in texts[text]}
            flat += [*ids, 0]
            places.append((at, texts[text]))
            for k in range(max(1, len(ids) - window + 1)):
                key = tuple(ids[k : k + window])
                if key not in kinds:
                    kinds[key] = len(kinds)
                    sizes.append(len(key))
                    owners.append(set())
                owners[kinds[key]] |= own
                start.append(at + k)
                length.append(len(ids) - k)
                kind.append(kinds[key])
        as_array = lambda x, t=np.int64: np.array(x, t)
        return cls(vocabulary, as_array([*flat, 0], np.int32), as_array(start), as_array(length), as_array(kind), as_array(sizes), np.append(0, np.cumsum(as_array([len(o) for o in owners]))).astype(np.int64), as_array([k for o in owners for k in sorted(o)]), names, places)


def runs(ids: np.ndarray) -> np.ndarray:
    """For each place the number of words up to the next zero."""
    at = np.arange(len(ids))
    return np.minimum.accumulate(np.where(ids == 0, at, len(ids))[::-1])[::-1] - at


def suffix_array(ids: np.ndarray, run: np.ndarray, owned: int, least: int, depth: int) -> np.ndarray:
    """The places before ``owned`` with a run of ``least`` words, sorted by what follows, up to ``depth`` words at least; a run's end sorts first."""
    ends = np.flatnonzero(ids == 0)
    begins = np.append(0, ends + 1)
    size = run[np.minimum(begins, len(ids) - 1)] * (begins < len(ids))
    long = size >= least
    total = size[long]
    work = np.repeat(begins[long] - np.cumsum(total) + total, total) + np.arange(int(total.sum()))
    rank, known = ids.astype(np.int64), 1
    top = int(ids.max(initial=0))
    while known < depth and len(work):
        inside = run[work] > known
        second = np.where(inside, rank[np.where(inside, work + known, 0)], 0)
        found, order = np.unique(rank[work] * (top + 1) + second, return_inverse=True)
        rank[work] = order + 1
        top, known = len(found), known * 2
        if top == len(work):
            break
    starts = work[(run[work] >= least) & (work < owned)]
    return starts[np.argsort(rank[starts], kind="stable")]


def common(ids: np.ndarray, at: np.ndarray, flat: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words two places have in common, ``most`` at most; the places must hold so many words."""
    out, left = np.zeros(len(at), np.int64), np.arange(len(at))
    step = np.arange(STRIDE)
    while len(left):
        k = out[left][:, None] + step
        inside = k < most[left][:, None]
        same = inside & (ids[np.where(inside, at[left][:, None] + k, 0)] == flat[np.where(inside, start[left][:, None] + k, 0)])
        n = np.where(same.all(1), STRIDE, np.argmin(same, axis=1))
        out[left] += n
        left = left[n == STRIDE]
    return out


def bound(order: np.ndarray, ids: np.ndarray, run: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray, beyond: bool) -> np.ndarray:
    """Where in the array each pattern belongs: before what begins with it, or beyond."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) // 2
        at, s, size = order[middle], start[open_], length[open_]
        n = common(ids, at, flat, s, np.minimum(run[at], size))
        whole = n == size
        less = np.where(whole, beyond, np.where(n < run[at], ids[np.minimum(at + n, len(ids) - 1)], 0) < flat[np.where(whole, s, s + n)])
        lo[open_], hi[open_] = np.where(less, middle + 1, lo[open_]), np.where(less, hi[open_], middle)
    return lo


def longest(order: np.ndarray, ids: np.ndarray, run: np.ndarray, tests: Tests) -> np.ndarray:
    """The longest verbatim match of every test suffix, from its neighbours in the array."""
    place = bound(order, ids, run, tests.flat, tests.start, tests.length, False)
    best = np.zeros(len(place), np.int64)
    for k in (place - 1, place):
        near = np.flatnonzero((k >= 0) & (k < len(order)))
        at = order[k[near]]
        best[near] = np.maximum(best[near], common(ids, at, tests.flat, tests.start[near], np.minimum(run[at], tests.length[near])))
    return best


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size), of


def searched(ids: np.ndarray, tests: Tests) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per shard: where it starts, its words and runs, its array, and the suffixes found with the range of their window."""
    depth, least = int(tests.length.max(initial=0)), int(tests.window.min(initial=WINDOW))
    for at in range(0, len(ids) if depth else 0, SHARD_WORDS):
        part = np.append(ids[at : at + SHARD_WORDS + depth], 0)
        run = runs(part)
        order = suffix_array(part, run, min(SHARD_WORDS, len(part)), least, depth)
        if not len(order):
            continue
        size = tests.window[tests.kind]
        hit = np.flatnonzero(longest(order, part, run, tests) >= size)
        lo, hi = (bound(order, part, run, tests.flat, tests.start[hit], size[hit], side) for side in (False, True))
        yield at, part, run, order, hit, lo, hi


def number(texts: list[bytes | None], tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as numbers of the vocabulary, zero for others and after each text; where each text starts, the end included."""
    get, out, starts = tests.vocabulary.get, [], [0]
    for text in texts:
        n = 0
        for stretch in words(text or b""):
            out.append(np.fromiter((get(w, 0) for w in stretch), np.int32, len(stretch)))
            n += len(stretch)
        out.append(np.zeros(1, np.int32))
        starts.append(starts[-1] + n + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(starts, np.int64)


def marks(texts: list[bytes | None], tests: Tests) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Per text: its words, the stretches of words inside occurring windows, the items that have such windows."""
    ids, starts = number(texts, tests)
    change, pairs, kinds = np.zeros(len(ids) + 1, np.int64), [], len(tests.window)
    for at, _, _, order, hit, lo, hi in searched(ids, tests):
        kind, one = np.unique(tests.kind[hit], return_index=True)
        k, of = spread(lo[one], hi[one])
        place = order[k] + at
        change += np.bincount(place, minlength=len(change)) - np.bincount(place + tests.window[kind[of]], minlength=len(change))
        pairs.append(np.unique((np.searchsorted(starts, place, "right") - 1) * kinds + kind[of]))
    edge = np.diff(np.cumsum(change) > 0, prepend=False).nonzero()[0]  # a zero follows each text, so stretches don't cross
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b, d in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(starts, edge[::2], "right") - 1).tolist()):
        spans[d].append({"start": a - int(starts[d]), "stop": b - int(starts[d])})
    items: list[list[str]] = [[] for _ in texts]
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    k, of = spread(tests.first[found % max(kinds, 1)], tests.first[found % max(kinds, 1) + 1]) if len(found) else (found, found)
    for key in np.unique(found[of] // max(kinds, 1) * len(tests.names) + tests.owners[k]).tolist() if len(found) else []:
        items[key // len(tests.names)].append(tests.names[key % len(tests.names)])
    return (np.diff(starts) - 1).tolist(), spans, items


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _mark(batches: Iterator[pa.RecordBatch], tests: Broadcast) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]
    for batch in pieces(batches, "text", SHARD_BYTES):
        found = marks(_binary(batch, "text"), tests.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(found, kinds)]], names=["row", "n_words", "spans", "items"])


def _locate(batches: Iterator[pa.RecordBatch], tests: Broadcast) -> Iterator[pa.RecordBatch]:
    """Matches that can't be made longer on either side."""
    t: Tests = tests.value
    begins = np.array([at for at, _ in t.places], np.int64)
    for batch in pieces(batches, "text", SHARD_BYTES):
        names = batch.column(0).to_pylist()
        ids, starts = number(_binary(batch, "text"), t)
        for at, part, run, order, hit, lo, hi in searched(ids, t):
            k, of = spread(lo, hi)
            place, s, size = order[k], t.start[hit[of]], t.length[hit[of]]
            whole = place + at
            before = np.where((whole > 0) & (s > 0), ids[whole - 1], 0)
            keep = (before == 0) | (before != t.flat[s - 1])
            place, s, size, whole = place[keep], s[keep], size[keep], whole[keep]
            n = common(part, place, t.flat, s, np.minimum(run[place], size))
            doc, text = np.searchsorted(starts, whole, "right") - 1, np.searchsorted(begins, s, "right") - 1
            rows = [(names[d], w - int(starts[d]), name, x - t.places[q][0] + first, m) for d, w, q, x, m in zip(doc.tolist(), whole.tolist(), text.tolist(), s.tolist(), n.tolist()) for name, first in t.places[q][1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in MATCHES.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items as their words, in pieces that overlap by a window less one word."""
    for batch in pieces(batches, "text"):
        out = []
        for name, text in zip(batch.column(0).to_pylist(), _binary(batch, "text")):
            held, at, some = [], 0, False
            for stretch in words(text or b""):
                held += stretch
                while len(held) > most:
                    out.append((name, at, b" ".join(held[:most])))
                    at, held, some = at + most - window + 1, held[most - window + 1 :], True
            if held and (not some or len(held) >= window):
                out.append((name, at, b" ".join(held)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["item", "at", "words"])


def blocks(benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK_BYTES, most: int = PIECE_WORDS) -> Iterator[Tests]:
    """The benchmark in blocks of about ``size`` bytes; at least one, which may be empty."""
    ship(benchmark.sparkSession)
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    cut = materialize(named.mapInArrow(lambda b: _cut(b, window, most), "item string, at long, words binary").distinct(), "benchmark")
    total = cut.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    n = max(1, -(-total // size))
    for k in range(n):
        rows = cut.where(F.pmod(F.xxhash64("item", "at", "words"), F.lit(n)) == k)
        yield Tests.of([(r["item"], r["at"], bytes(r["words"])) for r in rows.collect()], window)


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, size: int = BLOCK_BYTES) -> DataFrame:
    """``row`` with the columns of ``keep`` (all of them if None), n_words, n_hit, spans of word numbers, items."""
    spark = docs.sparkSession
    tests = [spark.sparkContext.broadcast(t) for t in blocks(benchmark, window, size)]
    row = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    one = lambda df, t: df.mapInArrow(lambda b: _mark(b, t), f"row {df.schema['row'].dataType.simpleString()}, {MARKS}")
    if len(tests) == 1:
        found = one(row, tests[0])
    else:
        keyed = materialize(row.select(F.struct(F.monotonically_increasing_id().alias("id"), "row").alias("row"), "text"), "documents")
        passes = one(keyed.select(F.struct("row.id").alias("row"), "text"), tests[0])
        for t in tests[1:]:
            passes = passes.unionByName(one(keyed.select(F.struct("row.id").alias("row"), "text"), t))
        spans = F.array_sort(F.flatten(F.collect_list("spans")))
        met = passes.groupBy(F.col("row.id").alias("id")).agg(F.first("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = keyed.select("row.id", "row.row").join(met, "id").select("row", "n_words", F.expr(JOINED).alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("row", "n_words", n_hit.alias("n_hit"), "spans", "items")


#: Sorted stretches, those that overlap or touch made one.
JOINED = f"aggregate(spans, CAST(array() AS {SPANS}), (done, s) -> CASE WHEN size(done) > 0 AND element_at(done, -1).stop >= s.start THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, s.stop)))) ELSE concat(done, array(s)) END)"


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    return mark(docs, benchmark, window=window).where("n_hit = 0").select("row.*")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK_BYTES) -> DataFrame:
    """Every place where a document and an item agree on at least a window and on no word before or after: doc_id, its word, item_id, its word, words in common.

    In items of more than ``PIECE_WORDS`` words a match ends with the piece.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    for t in blocks(benchmark, window, size):
        shipped = spark.sparkContext.broadcast(t)
        found = rows.mapInArrow(lambda b, t=shipped: _locate(b, t), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = mark(docs, benchmark, ["doc_id"])
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
