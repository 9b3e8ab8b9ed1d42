"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Fingerprints that differ in at most ``radius`` of 64 bits agree on at least
``blocks - radius`` of ``blocks`` bit blocks, so each choice of so many blocks
is a key and every link meets under one of them: no link is lost. Below a key,
64 neighbours lie in one machine word per bit plane; a row is compared with
whole words at once, differences are counted by carry-save adders (ones, twos,
overflow), and a word is abandoned once all its lanes are beyond the radius. A
key's links leave the task as a spanning forest. Keys with very many
fingerprints are cut in cells, each pair of which meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelweave.llm.shared import column, materialize, pieces, ship, tasks

SEED, WORDS, RADIUS, BLOCKS = 42, 3, 3, 5
#: Fingerprints of one key that a task compares; above it the key is cut in cells of half as many.
CELL = 1 << 16
#: Parts in which the rows of one key are joined, as a component may hold a large share of all rows.
SALT = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """64 majority bits of the hashes of all 3-word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = np.array([fingerprint(t) for t in column(batch, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def masks(blocks: int, radius: int) -> list[int]:
    """The bit masks of the keys."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(block, blocks - radius)]


def links(fp: np.ndarray, end: np.ndarray, radius: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)``, ``i < j < end[i]``, within the radius, by bit-sliced words of 64 rows."""
    n = len(fp)
    lanes = np.zeros(-(-n // 64) * 64, np.uint64)
    lanes[:n] = fp
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T).reshape(64, -1, 64), axis=2, bitorder="little").reshape(64, -1).view("<u8")  # [bit, word]
    first = np.arange(n) // 64
    count = np.where(end > np.arange(n) + 1, (end - 1) // 64 - first + 1, 0)
    left, right = [], []
    for a, b in chunks(count, block):
        c = count[a:b]
        row = np.repeat(np.arange(a, b), c)
        word = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
        low = np.clip(row + 1 - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(end[row] - word * 64, 1, 64).astype(np.uint64)
        over = ~((ALL >> (np.uint64(64) - high)) & (ALL << low))
        over |= np.where(row + 1 - word * 64 > 63, ALL, np.uint64(0))
        digits = [np.zeros(len(row), np.uint64) for _ in range(radius.bit_length())]
        for bit in range(64):
            carry = planes[bit, word] ^ (np.uint64(0) - (fp[row] >> np.uint64(bit) & np.uint64(1)))
            for k, digit in enumerate(digits):
                digits[k], carry = digit ^ carry, digit & carry
            over |= carry
            if bit % 8 == 7:
                if radius + 1 < 1 << len(digits):  # not a power of two: compare the counter
                    over |= beyond(digits, radius)
                keep = over != ALL
                if not keep.all():
                    row, word, over, digits = row[keep], word[keep], over[keep], [d[keep] for d in digits]
                    if not len(row):
                        break
        if len(row):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(hit)
            left.append(row[k])
            right.append(word[k] * 64 + lane)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def beyond(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    more, same = np.zeros_like(digits[0]), np.full_like(digits[0], ALL)
    for k in reversed(range(len(digits))):
        if radius >> k & 1:
            same &= digits[k]
        else:
            more |= same & digits[k]
            same &= ~digits[k]
    return more


def chunks(count: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    total, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the least row of its component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        if (a == b).all():
            return root
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and fingerprint; a key's rows never part."""
    held: list[pa.RecordBatch] = []

    def give(part: pa.Table) -> pa.RecordBatch:
        fp = part.column("fp").to_numpy().view(np.uint64)
        group = np.column_stack([part.column(x).to_numpy() for x in ("mask", "key", "a", "b")])
        new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1))))
        end = np.repeat(np.append(new[1:], len(fp)), np.diff(np.append(new, len(fp))))
        root = forest(len(fp), *links(fp, end, radius))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[at]].view(np.int64)), pa.array(fp[at].view(np.int64))], names=["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= 1 << 17:
            whole = pa.Table.from_batches(held).combine_chunks()
            group = np.column_stack([whole.column(x).to_numpy() for x in ("mask", "key", "a", "b")])
            last = np.flatnonzero((group != group[-1]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield give(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
    if held:
        yield give(pa.Table.from_batches(held).combine_chunks())


def similar(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """``src, dst``: a spanning forest, key by key, of the links between distinct fingerprints ``fp``."""
    ship(fps.sparkSession)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(masks(blocks, radius))])).alias("k")).select("fp", "k.mask", "k.key")
    hot = keyed.groupBy("mask", "key").count().where(F.col("count") > cell).withColumn("cells", F.ceil(F.col("count") * 2 / cell).cast("int")).drop("count")
    with_hot = keyed.join(hot, ["mask", "key"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    dealt = with_hot.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("mask", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    met = dealt.repartition(tasks(fps.sparkSession), "mask", "key", "a", "b").sortWithinPartitions("mask", "key", "a", "b", "fp")
    return met.mapInArrow(partial(_compare, radius=radius), "src long, dst long").distinct()


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """``many`` with the columns of ``one``, which has one row per key; a key's rows are dealt by ``by`` over ``SALT`` tasks."""
    many = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.join(one.hint("merge"), [key, "salt"]).drop("salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the least node of each component, by large-star and small-star rounds.

    Each round is a minimum per node, which is combined before the shuffle,
    and a join; it is written to the shared folder, and of it only a count and
    a sum come to the driver. Nodes without an edge don't appear.
    """
    edges = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        edges = materialize(small.distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.union(edges.select("v", "v").distinct().toDF("node", "root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable), one row per document.

    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows give repeated rows; a null doc_id is never the least unless
    its component has no other. Other columns are ignored.
    """
    ship(docs.sparkSession)
    own = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(similar(fps.select("fp"), radius, blocks, cell))
    joined = fps.join(root, fps["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = salted_join(joined, least, "root", "fp").select("fp", "component_id")
    return own.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
