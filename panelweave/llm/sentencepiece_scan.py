"""SentencePiece encoding as a max-plus scan, and decoding.

The best segmentation maximises the sum of piece scores (byte fallback for
characters without a piece). Documents longer than ``CHUNK`` characters are cut
in chunks. A boundary's states are the last ``reach`` positions before it; a
chunk turns the vector of their best scores into the next one by a matrix in
the (max, +) semiring, so the matrices of a document combine associatively.
With the vector that enters it each chunk then finds its own best paths and
traces them back, independently of the others, for each state in which it can
be left; which one that is follows from the last chunk backwards.

Where no piece can cross (before a word's space mark) all paths meet, so a run
between two such places is solved once per worker and remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import column, materialize, pieces, ship, tasks
from panelweave.llm.tokens import vocabulary

CHUNK, MEMO, NONE = 1 << 14, 600_000, float("-inf")
#: Longer runs are not remembered; characters of runs that are solved side by side.
LONG, BLOCK = 64, 1 << 18
SPACE = "▁"
MEETING = re.compile(f"(?<!{SPACE}){SPACE}")
RESULT = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"


class Pieces:
    """Pieces and scores of a model file; its segmentation of runs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = [model.id_to_piece(i) for i in ids]
        self.score = {self.names[i]: (model.get_score(i), i) for i in plain}
        self.trie: dict = {}  # character -> (score of what is read so far or None, what can follow)
        for piece in sorted(self.score, key=len):  # beginnings come before what they begin
            kids = self.trie
            for c in piece[:-1]:
                kids = kids.setdefault(c, (None, {}))[1]
            kids[piece[-1]] = (self.score[piece][0], kids.get(piece[-1], (None, {}))[1])
        self.unknown = min(s for s, _ in self.score.values()) - 10
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.reach = max(map(len, self.score))
        crossing = [p for p in self.score if any(a != SPACE and b == SPACE for a, b in zip(p, p[1:]))]
        self.cuts = not crossing  # then all paths meet before a space mark that follows another character
        raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else n.encode() for i, n in enumerate(self.names)]
        raw = [x.replace(SPACE.encode(), b" ") for x in raw]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw])
        self.start = np.cumsum(self.size) - self.size
        self.number_trie()
        self.memo: dict[str, bytes] = {}

    def number_trie(self) -> None:
        """The trie as arrays: sorted keys of node and character, where they lead, and each node's score and id."""
        edges, scores, ids, queue = [], [NONE], [-1], [(0, "", self.trie)]
        for node, prefix, kids in queue:
            for c, (score, below) in kids.items():
                scores.append(NONE if score is None else score)
                ids.append(-1 if score is None else self.score[prefix + c][1])
                edges.append((node << 21 | ord(c), len(scores) - 1))
                queue.append((len(scores) - 1, prefix + c, below))
        edges.sort()
        self.edge = np.array([k for k, _ in edges] + [np.iinfo(np.int64).max])
        self.leads = np.array([n for _, n in edges] + [0])
        self.node_score, self.node_id = np.array(scores), np.array(ids)

    def normalize(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def ids_of(self, piece: str) -> list[int]:
        return [self.score[piece][1]] if piece in self.score else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def forward(self, text: str, best: list[float], begin: int) -> tuple[list[float], list[int]]:
        """Best scores and last starts at positions after ``begin``; ``best`` holds those up to it. Ties go to the longest piece."""
        n, chars, root, limit = len(text), list(text), self.trie, len(text)
        best, back = best[: begin + 1] + [NONE] * (n - begin), [0] * (n + 1)
        for start in range(n):
            so_far = best[start]
            if so_far == NONE:
                continue
            kids, end = root, start
            while end < limit:
                node = kids.get(chars[end])
                if node is None:
                    break
                score, kids = node
                end += 1
                if score is not None and so_far + score > best[end] and end > begin:
                    best[end], back[end] = so_far + score, start
            if start >= begin and chars[start] not in self.score and so_far + self.unknown > best[start + 1]:
                best[start + 1], back[start + 1] = so_far + self.unknown, start
        return best, back

    def trace(self, text: str, back: list[int], end: int, stop: int) -> tuple[list[int], int]:
        """Ids of the pieces that end in ``(stop, end]``, and where the first of them starts."""
        found, score = [], self.score
        while end > stop:
            piece, end = text[back[end] : end], back[end]
            if piece in score:
                found.append(score[piece][1])
            else:
                found.extend(reversed(self.ids_of(piece)))
        return found[::-1], end

    def run(self, run: str) -> bytes:
        """Ids of a run whose both ends all paths meet at."""
        _, back = self.forward(run, [0.0], 0)
        return array("I", self.trace(run, back, len(run), 0)[0]).tobytes()

    def learn(self, runs: set[str]) -> None:
        """Puts the ids of short runs into ``memo``."""
        runs = sorted([r for r in runs if len(r) < LONG and r not in self.memo], key=len)
        if len(self.memo) + len(runs) > MEMO:
            self.memo.clear()
        at = 0
        while at < len(runs):
            to = min(len(runs), at + BLOCK // LONG)
            self.memo.update(zip(runs[at:to], self.solve(runs[at:to])))
            at = to

    def solve(self, runs: list[str]) -> list[bytes]:
        """The ids of each run: the same search as ``forward``, one numpy step for all runs."""
        sizes = np.array([len(r) for r in runs])
        n, width = len(runs), int(sizes.max())
        chars = np.zeros((n, width), np.int64)
        chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        best, back, piece = np.full((n, width + 1), NONE), np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
        best[:, 0] = 0.0
        strange = ~self.is_piece(chars)
        for start in range(width):
            rows = np.flatnonzero(sizes > start)
            so_far, node = best[rows, start], np.zeros(len(rows), np.int64)
            for end in range(start, min(width, start + self.reach)):
                key = node << 21 | chars[rows, end]
                at = np.searchsorted(self.edge, key)
                there = np.flatnonzero(self.edge[at] == key)
                if not len(there):
                    break
                rows, so_far, node = rows[there], so_far[there], self.leads[at[there]]
                made = so_far + self.node_score[node]
                better = np.flatnonzero(made > best[rows, end + 1])
                to = rows[better]
                best[to, end + 1], back[to, end + 1], piece[to, end + 1] = made[better], start, self.node_id[node[better]]
            rows = np.flatnonzero(strange[:, start] & (sizes > start) & (best[:, start] + self.unknown > best[:, start + 1]))
            best[rows, start + 1], back[rows, start + 1] = best[rows, start] + self.unknown, start
        out, left, rows, at = np.zeros((n, width), np.uint32), np.full(n, width), np.arange(n), sizes.copy()
        while len(rows):
            left[rows] -= 1
            out[rows, left[rows]] = piece[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        raw = out.tobytes()
        found = [raw[4 * (k * width + a) : 4 * (k + 1) * width] for k, a in enumerate(left.tolist())]
        for k in np.flatnonzero((strange & (np.arange(width) < sizes[:, None])).any(1)).tolist():  # characters that become bytes
            found[k] = array("I", self.trace(runs[k], back[k].tolist(), len(runs[k]), 0)[0]).tobytes()
        return found

    def is_piece(self, chars: np.ndarray) -> np.ndarray:
        """Whether each character is a piece by itself."""
        at = np.searchsorted(self.edge, chars)
        return (self.edge[at] == chars) & (self.node_id[self.leads[at]] >= 0)

    def runs(self, text: str) -> list[str]:
        """``text`` cut wherever all paths meet."""
        if not self.cuts:
            return [text]
        if SPACE * 2 not in text:
            head, *rest = text.split(SPACE)
            return [x for x in (head, *[SPACE + r for r in rest]) if x]
        at = [0, *[m.start() for m in MEETING.finditer(text) if m.start()], len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        """Ids of a whole normalised text: one chunk, entered and left in the state of no overhang."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self.runs(t) if t else [] for t in texts]
        self.learn(set().union(*cut) if cut else set())
        known, run = self.memo.get, self.run
        return [b"".join([known(r) or run(r) for r in own]) for own in cut]

    def matrix(self, left: str, own: str) -> np.ndarray:
        """``m[d, e]``: the best score from ``d`` positions before the chunk to ``e`` before its end.

        ``left`` is what precedes the chunk, as far as a piece reaches. The
        first piece of a path ends inside the chunk.
        """
        text, lead, reach = left + own, len(left), self.reach
        out = np.full((reach, reach), NONE)
        met = self.meeting(text, lead)
        if met:
            # All states share the way from the first meeting to the last. Its score is left out: a number added to a whole
            # matrix changes no choice.
            a, b = met
            tail, _ = self.forward(text[b:], [0.0], 0)
            for d in range(min(reach, lead + 1)):
                start = [NONE] * (lead + 1)
                start[lead - d] = 0.0
                head = self.forward(text[:a], start, lead)[0][-1]
                out[d] = [head + tail[len(text) - e - b] for e in range(reach)]
            return out
        for d in range(min(reach, lead + 1)):
            start = [NONE] * (lead + 1)
            start[lead - d] = 0.0
            best, _ = self.forward(text, start, lead)
            for e in range(min(reach, len(own))):
                out[d, e] = best[len(text) - e]
        return out

    def meeting(self, text: str, lead: int) -> tuple[int, int] | None:
        """The first position after ``lead`` at which all paths meet, and the last that no exit state precedes; None without both."""
        first = MEETING.search(text, lead + 1) if self.cuts else None
        most = len(text) - self.reach + 1
        if first is None or first.start() > most:
            return None
        for back in (64, 1024, len(text)):
            last = [m.start() for m in MEETING.finditer(text, max(lead + 1, most - back)) if m.start() <= most]
            if last:
                return first.start(), last[-1]
        return None

    def segments(self, left: str, own: str, entry: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
        """Ids of pieces that end in the chunk: those that all exit states share, then the rest for each exit state; and the state that each was entered in."""
        text, lead, reach = left + own, len(left), self.reach
        start = [entry[lead - k] if lead - k < reach else NONE for k in range(lead + 1)]
        met, exits = self.meeting(text, lead), range(min(reach, len(own)))
        if met is None:
            _, back = self.forward(text, start, lead)
            found = [self.trace(text, back, len(text) - e, lead) for e in exits]
            return b"", [array("I", ids).tobytes() for ids, _ in found], [lead - at for _, at in found]
        a, b = met
        _, back = self.forward(text[:a], start, lead)
        ids, at = self.trace(text[:a], back, a, lead)
        common = array("I", ids).tobytes() + (self.encode(text[a:b]) if b > a else b"")
        _, back = self.forward(text[b:], [0.0], 0)
        tails = [array("I", self.trace(text[b:], back, len(text) - e - b, 0)[0]).tobytes() for e in exits]
        return common, tails, [lead - at] * len(tails)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8, without the space that leads it."""
        size = self.size[ids]
        first = np.cumsum(size) - size
        text = self.blob[np.repeat(self.start[ids] - first, size) + np.arange(size.sum())].tobytes()
        return text[1:] if text[:1] == b" " else text


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices, or stacks of them."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def prefixes(stack: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of matrices, in log2 rounds of side-by-side products."""
    out, step = stack.copy(), 1
    while step < len(out):
        for at in range(len(out) - 1, step - 1, -256):
            lo = max(step, at - 255)
            out[lo : at + 1] = combine(out[lo - step : at + 1 - step], out[lo : at + 1])
        step *= 2
    return out


_OWN: dict[str, Pieces] = {}


def own_pieces(path: str) -> Pieces:
    if path not in _OWN:
        _OWN[path] = Pieces(path)
    return _OWN[path]


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def digest(model: Pieces, doc_id: int | None, hashed: int, raw: bytes) -> tuple:
    ids = np.frombuffer(raw, np.uint32)
    return doc_id, len(ids), zlib.crc32(raw), xxhash.xxh64_intdigest(model.decode(ids)) >> 1 == hashed


def _cut(batches: Iterator[pa.RecordBatch], path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """Texts as they are if short, else chunk by chunk with what precedes each."""
    reach = own_pieces(path).reach
    for batch in pieces(batches):
        rows = []
        for row, doc_id, text in zip(column(batch, "row"), column(batch, "doc_id"), column(batch, "text")):
            hashed = text_hash(text or "")
            text = own_pieces(path).normalize(text or "")
            for k in range(max(1, -(-len(text) // chunk))):
                rows.append((row, doc_id, hashed, k, text[max(0, k * chunk - reach + 1) : k * chunk], text[k * chunk : (k + 1) * chunk]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["row", "doc_id", "hashed", "k", "left", "own"])


def _matrices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = own_pieces(path)
    for batch in pieces(batches, "own"):
        found = [model.matrix(a, b).tobytes() for a, b in zip(column(batch, "left"), column(batch, "own"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["row", "k", "m"])


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    """One document's chunk matrices: the vector that enters each chunk."""
    frame = frame.sort_values("k")
    stack = np.stack([np.frombuffer(m) for m in frame["m"]])
    reach = int(len(stack[0]) ** 0.5)
    first = np.full(reach, NONE)
    first[0] = 0.0
    after = (first[None, :, None] + prefixes(stack.reshape(-1, reach, reach))).max(1)
    vectors = [first, *after[:-1]]
    return pd.DataFrame({"row": frame["row"].to_numpy(), "k": frame["k"].to_numpy(), "entry": [v.tobytes() for v in vectors]})


def _segments(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = own_pieces(path)
    for batch in pieces(batches, "own"):
        model.learn(set().union(*map(model.runs, column(batch, "own"))))
        found = [model.segments(left, own, np.frombuffer(entry)) for left, own, entry in zip(column(batch, "left"), column(batch, "own"), column(batch, "entry"))]
        made = [pa.array(x, t) for x, t in zip(zip(*found), (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())))]
        kept = ("row", "doc_id", "hashed", "k")
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in kept], *made], names=[*kept, "common", "tails", "states"])


def resolve(common: list, tails: list, states: list) -> bytes:
    """The ids of a document from its chunks' alternatives, from the last chunk backwards."""
    state, found = 0, []
    for shared, own, entered in zip(reversed(common), reversed(tails), reversed(states)):
        found += [own[state], shared]
        state = int(entered[state])
    return b"".join(reversed(found))


def _resolved(frame: pd.DataFrame, path: str) -> pd.DataFrame:
    frame, model = frame.sort_values("k"), own_pieces(path)
    raw = resolve(list(frame["common"]), list(frame["tails"]), list(frame["states"]))
    return pd.DataFrame([digest(model, frame["doc_id"].iloc[0], frame["hashed"].iloc[0], raw)], columns=[x.split()[0] for x in RESULT.split(", ")])


def _short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = own_pieces(path)
    for batch in pieces(batches):
        rows = []
        texts = [t or "" for t in column(batch, "text")]
        for doc_id, text, raw in zip(column(batch, "doc_id"), texts, model.encode_all(list(map(model.normalize, texts)))):
            rows.append(digest(model, doc_id, text_hash(text), raw))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=[x.split()[0] for x in RESULT.split(", ")])


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text back).

    A null text counts as empty and has no pieces; repeated rows stay; an empty
    table gives none; other columns are ignored. A text that holds the space
    mark itself decodes to a space, as with the library, and doesn't come back.
    """
    ship(docs.sparkSession)
    path = vocabulary("piece_bpe_32k.model", path)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long = F.length("text") >= chunk
    short = docs.where(long.isNull() | ~long).mapInArrow(partial(_short, path=path), RESULT)
    rows = docs.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = materialize(rows.mapInArrow(partial(_cut, path=path, chunk=chunk), "row long, doc_id long, hashed long, k int, left string, own string"), "chunks")
    matrices = parts.select("row", "k", "left", "own").mapInArrow(partial(_matrices, path=path), "row long, k int, m binary")
    n = tasks(docs.sparkSession)
    entries = matrices.repartition(n, "row").groupBy("row").applyInPandas(_entries, "row long, k int, entry binary")
    dealt = parts.repartition(n, "row", "k")
    segments = dealt.join(entries, ["row", "k"]).mapInArrow(partial(_segments, path=path), "row long, doc_id long, hashed long, k int, common binary, tails array<binary>, states array<int>")
    return short.unionByName(segments.repartition(n, "row").groupBy("row").applyInPandas(lambda frame: _resolved(frame, path), RESULT))
