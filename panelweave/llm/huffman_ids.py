"""Token ids in files of canonical length-limited Huffman codes.

Ids are counted over the whole corpus, lengths come from package-merge, codes
are canonical, and the ids are written in ascending doc_id order as blocks that
decode alone. A block names its documents and has the bit offset of every
``STEP``-th id, so that a lookup table decodes all those lanes side by side.
The file format is a Parquet table of blocks, which any store that Spark
writes can hold and whose commit survives lost executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import BATCH_BYTES, column, materialize, pack_bits, pieces, ship, windows32
from panelweave.llm.tokens import tokenizer, vocabulary

LIMIT, BLOCK_IDS, STEP, END_ID, MAGIC = 16, 1 << 16, 64, 0, b"HID1"
IDS = "bucket int, doc_id long, ids binary"
BLOCKS = "bucket int, block int, first long, n_ids long, n_docs int, data binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the best code lengths of at most ``limit`` bits; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit in {limit} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaves].astype(np.float64)
    level, orders = weight, []
    for _ in range(limit):
        if orders:
            pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate((weight, pairs))
            order = np.argsort(both, kind="stable")
            level = both[order]
        else:
            order = np.arange(len(weight))
        orders.append(order)
    take = 2 * len(leaves) - 2
    for order in reversed(orders):
        first = order[:take]
        n = int((first < len(leaves)).sum())
        lengths[leaves[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for symbol in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each window of ``limit`` bits."""
    codes, symbol, size = canonical(lengths), np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    for s in np.flatnonzero(lengths):
        a = int(codes[s]) << (limit - int(lengths[s]))
        b = a + (1 << (limit - int(lengths[s])))
        symbol[a:b], size[a:b] = s, lengths[s]
    return symbol, size


def encode_block(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs]).astype(np.int64)
    bits, offsets = pack_bits(codes[ids], lengths[ids])
    marks = offsets[:-1:STEP].astype("<u8")
    head = struct.pack("<4sIQQ", MAGIC, len(docs), len(ids), len(marks))
    names = np.array([-1 if d is None else d for d, _ in docs], "<i8").tobytes() + bytes(d is None for d, _ in docs)
    return head + names + np.array([len(x) for _, x in docs], "<u8").tobytes() + marks.tobytes() + bits.tobytes()


def decode_block(data: bytes, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[tuple[int | None, np.ndarray]]:
    magic, n_docs, n_ids, n_marks = struct.unpack_from("<4sIQQ", data)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    at = struct.calcsize("<4sIQQ")
    names = np.frombuffer(data, "<i8", n_docs, at).tolist()
    void = data[at + 8 * n_docs : at + 9 * n_docs]
    sizes = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    bit = np.frombuffer(data, "<u8", n_marks, at).astype(np.int64)
    words = windows32(np.frombuffer(data, np.uint8, offset=at + 8 * n_marks))
    words = np.concatenate((words, np.zeros(8, np.uint32)))
    out, (symbol, size), last = np.zeros((STEP, n_marks), np.uint32), table, len(words) - 1
    for step in range(STEP):
        key = (words[np.minimum(bit >> 3, last)] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[step] = symbol[key]
        bit += size[key]
    ids = out.T.reshape(-1)[:n_ids]
    ends = np.cumsum(sizes)
    return [(None if v else d, ids[e - n : e]) for d, v, n, e in zip(names, void, sizes, ends)]


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(path, "byte")
    end = np.array(END_ID, tok.code).tobytes()
    for batch in pieces(batches, limit=4 * BATCH_BYTES):  # the more at once, the fewer units are looked up
        ids = [x + end for x in tok.encode([t or "" for t in column(batch, "text")])]
        names = column(batch, "doc_id")
        bucket = np.searchsorted(edges, np.array([np.iinfo(np.int64).min if x is None else x for x in names], np.int64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(names, pa.int64()), pa.array(ids, pa.binary())], names=["bucket", "doc_id", "ids"])


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in pieces(batches, "ids"):
        total += np.bincount(np.frombuffer(b"".join(column(batch, "ids")), np.uint16), minlength=size)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


def _write(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and doc_id."""
    codes, held, size, now, block, first = canonical(lengths), [], 0, None, 0, 0

    def give() -> pa.RecordBatch:
        row = [now, block, first, size, len(held), encode_block(held, lengths, codes)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "block", "first", "n_ids", "n_docs", "data"])

    for batch in pieces(batches, "ids"):
        for bucket, doc_id, raw in zip(column(batch, "bucket"), column(batch, "doc_id"), column(batch, "ids")):
            if held and (bucket != now or size >= BLOCK_IDS):
                yield give()
                block, first, held, size = block + 1, first + size, [], 0
            if bucket != now:
                now, block, first = bucket, 0, 0
            held.append((doc_id, np.frombuffer(raw, np.uint16)))
            size += len(held[-1][1])
    if held:
        yield give()


def _read(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    table = decode_table(lengths)
    for batch in pieces(batches, "data"):
        rows = []
        for bucket, first, data in zip(*(column(batch, x) for x in ("bucket", "first", "data"))):
            start = before[bucket] + first
            for doc_id, ids in decode_block(data, table):
                rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
                start += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Tokenises whole texts and writes the blocks; returns the table of blocks and the code lengths.

    A null text counts as empty, a null doc_id comes first; documents of one
    doc_id stay together in any order. An empty table gives no blocks.
    ``buckets`` doc_id ranges of about equal rows are written side by side. To
    the driver go one count per id of the vocabulary and one edge per bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary("byte_bpe_50k.json", path)
    if tokenizer(path, "byte").code != "H":
        raise ValueError(f"{path}: ids of more than 16 bits aren't supported")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    edges = np.unique(np.array(found, np.int64))
    ids = materialize(docs.mapInArrow(partial(_tokenise, path=path, edges=edges), IDS), "ids")
    counts = np.zeros(1 << 16, np.int64)
    for row in ids.select("ids").mapInArrow(partial(_count, size=1 << 16), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    ordered = ids.repartitionByRange(buckets, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first())
    return materialize(ordered.mapInArrow(partial(_write, lengths=lengths), BLOCKS), "id-blocks", "uncompressed"), lengths


def read_ids(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Per document from the blocks: the ids before it, its own and their CRC-32."""
    before, total = {}, 0
    for row in sorted(blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()):
        before[row["bucket"]], total = total, total + row["n"]
    return blocks.select("bucket", "first", "data").mapInArrow(partial(_read, lengths=lengths, before=before), RESULT)
