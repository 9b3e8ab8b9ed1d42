"""Order-preserving packing of documents into fixed windows.

Cuts are chosen by dynamic programming: ``cost[j]`` is the least padding plus
penalties of windows that end at candidate ``j``. A window from ``i`` to ``j``
pads ``window - (pos[j] - pos[i])``, so the best ``i`` has the least
``cost[i] + pos[i]`` among those within reach, which a monotone queue keeps.

Each scan task packs its own documents in the order read; nothing is shuffled,
a lost task that scans files is read and packed again with the same result
(rows in an order that may change, as after a shuffle, should be written
first), and only the end of a task can be padded much. There, windows of exactly a power of two tokens are
used as well, since they need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelweave.llm.shared import column, pieces, ship
from panelweave.llm.tokens import tokenizer, vocabulary

WINDOW, END_ID, AT_SENTENCE, ANYWHERE = 4096, 2, 6.0, 48.0
#: Windows that are planned together; the last few are planned again with what follows.
AHEAD, AGAIN = 64, 6
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, window: int, exact: bool = False) -> list[int]:
    """Positions at which windows end, the last of ``pos`` included.

    ``pos`` ascends from 0 with steps of at most ``window``. With ``exact``, a
    window of a power of two tokens costs no padding. Ties go to the earlier
    start.
    """
    at, pen = pos.tolist(), penalty.tolist()
    cost, back = [0.0] * len(at), [0] * len(at)
    queue, key = deque([0]), [0.0] * len(at)
    index = {p: i for i, p in enumerate(at)} if exact else {}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    for j in range(1, len(at)):
        while at[queue[0]] < at[j] - window:
            queue.popleft()
        i = queue[0]
        best = key[i] - at[j] + window
        if exact:
            for size in powers:
                k = index.get(at[j] - size)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
        cost[j], back[j] = best + pen[j], i
        key[j] = cost[j] + at[j]
        while queue and key[queue[-1]] > key[j]:
            queue.pop()
        queue.append(j)
    found, j = [], len(at) - 1
    while j:
        found.append(at[j])
        j = back[j]
    return found[::-1]


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int, window: int, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cut points with penalties: document ends are free, sentence ends cost little, other places are used where there is nothing else."""
    pos = np.unique(np.concatenate(([0], ends, sentences, [total])))
    gaps = np.diff(pos)
    extra = [np.arange(a + window, b, window) for a, b in zip(pos[:-1][gaps > window], pos[1:][gaps > window])]
    if final:
        rest, tail = total % window, []
        for bit in range(window.bit_length()):
            if rest >> bit & 1:
                tail.append(1 << bit)
        extra.append(total - np.cumsum(tail, dtype=np.int64))
    pos = np.unique(np.concatenate((pos, *extra))).astype(np.int64)
    pos = pos[pos >= 0]
    penalty = np.full(len(pos), ANYWHERE)
    penalty[np.isin(pos, sentences)] = AT_SENTENCE
    penalty[np.isin(pos, ends)] = 0
    penalty[-1] = 0
    return pos, penalty


def sentence_ids(tok) -> np.ndarray:
    """Ids whose token is made of ``.``, ``!`` and ``?`` alone and ends a word."""
    return np.array(sorted(i for t, i in tok.get_vocab().items() if (x := t.removesuffix("</w>")) and x != t and not x.strip(".!?")), np.int64)


class Packer:
    """Takes documents in order and gives the rows of finished windows."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.docs: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []  # doc_id, tokens before, of all, ids, sentence ends
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids, sentences))
        self.held += len(ids)

    def full(self) -> bool:
        return self.held >= AHEAD * self.window

    def flush(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        ends = np.cumsum([len(d[3]) for d in self.docs])
        sentences = np.concatenate([d[4] + e - len(d[3]) for d, e in zip(self.docs, ends)])
        pos, penalty = candidates(ends, sentences, self.held, self.window, final)
        cuts = choose_cuts(pos, penalty, self.window, final)
        if not final:
            cuts = cuts[: max(1, len(cuts) - AGAIN)]
        rows, k, used = [], 0, 0  # used: of document k
        begin = 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc_id, before, of_all, ids, _ = self.docs[k]
                take = min(len(ids) - used, cut - begin)
                part = ids[used : used + take]
                rows.append((doc_id, before + used, take, zlib.crc32(part.astype("<u4").tobytes()), of_all, self.sequence, offset))
                offset, begin, used = offset + take, begin + take, used + take
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if used:
            doc_id, before, of_all, ids, ends_in = rest[0]
            rest[0] = (doc_id, before + used, of_all, ids[used:], ends_in[ends_in > used] - used)
        self.docs, self.held = rest, self.held - begin
        return rows


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(path, "word")
    stops = np.zeros(tok.tokenizer.get_vocab_size(), bool)
    stops[sentence_ids(tok.tokenizer)] = True
    packer = Packer(window, TaskContext.get().partitionId() << 32)
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
    for batch in pieces(batches):
        texts = [t or "" for t in column(batch, "text")]
        for doc_id, raw in zip(column(batch, "doc_id"), tok.encode(texts)):
            ids = np.append(np.frombuffer(raw, np.dtype(tok.code)), np.array(END_ID, tok.code))
            packer.add(doc_id, ids, np.flatnonzero(stops[ids]) + 1)
            while packer.full():
                yield give(packer.flush(False))
    if rows := packer.flush(True):
        yield give(rows)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null
    text counts as empty and still gives its end id; equal rows are packed one
    by one; an empty table gives no rows. Texts are tokenised whole and may be
    longer than a window.
    """
    ship(docs.sparkSession)
    schema = pa.schema([pa.field(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
    fn = partial(_pack, path=vocabulary("word_bpe_49k.json", path), window=window, schema=schema)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(fn, SCHEMA)
