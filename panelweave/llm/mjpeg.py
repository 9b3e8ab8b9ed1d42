"""AVI files of lossless motion-JPEG frames, and shots found in them.

A payload is laid out in lines of 64 samples, 16 lines to a frame. Each frame
is a lossless JPEG (SOF3, left neighbour as predictor) with a restart marker
after every line, so that lines decode side by side. The reader walks the RIFF
index, parses each frame's markers and tables, decodes all lines of a batch in
step with one table lookup per sample, and cuts shots where the difference of
neighbouring histograms stands out from those before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import column, pack_bits, pieces, ship, windows32

WIDTH, LINES, FPS, BINS = 64, 16, 25, 32
#: Code length for each number of bits in a difference: text differs by few bits, or by seven next to a space.
CODE_BITS = {7: 2, 2: 3, 3: 3, 4: 3, 1: 4, 5: 4, 6: 4, 0: 5, 8: 6}
MEDIA = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "doc_id long, clip int, first_frame int, n_frames int, start_ms long, end_ms long"


@cache
def dht() -> bytes:
    order = sorted(CODE_BITS, key=lambda c: (CODE_BITS[c], c))
    counts = bytes(sum(CODE_BITS[c] == n for c in order) for n in range(1, 17))
    return b"\xff\xc4" + struct.pack(">HB", 3 + 16 + len(order), 0) + counts + bytes(order)


@cache
def category_codes(table: bytes) -> dict[int, tuple[int, int]]:
    """Category -> (code, length), canonical, from a DHT segment's counts and values."""
    found, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            found[table[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return found


@cache
def write_tables() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference from -255 to 255."""
    codes, values, lengths = category_codes(dht()[5:]), np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = codes[size]
        values[diff + 255] = code << size | (diff if diff >= 0 else diff + (1 << size) - 1)
        lengths[diff + 255] = length + size
    return values, lengths


@cache
def read_tables(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Difference and bits used for each window of 16 bits."""
    diffs, used = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    for size, (code, length) in category_codes(table).items():
        room = 16 - length - size
        if room < 0:
            raise ValueError("codes and bits of more than 16 aren't supported")
        a = code << (16 - length)
        bits = np.arange(1 << size)
        value = np.where(bits >> (size - 1) & 1, bits, bits - (1 << size) + 1) if size else bits
        diffs[a : a + (1 << (16 - length))] = np.repeat(value, 1 << room)
        used[a : a + (1 << (16 - length))] = length + size
    return diffs, used


@cache
def frame_head(lines: int) -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, lines, WIDTH, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + dht() + sof + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH) + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"


def frames_of(payloads: list[bytes]) -> list[list[bytes]]:
    """The JPEG frames of each payload; payloads are multiples of ``WIDTH`` bytes."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH).astype(np.int16)
    diff = np.empty((len(samples), WIDTH + 1), np.int64)
    diff[:, 0] = samples[:, 0] - 128
    diff[:, 1:WIDTH] = samples[:, 1:] - samples[:, :-1]
    values, lengths = write_tables()
    value, length = np.zeros(diff.shape, np.uint32), np.zeros(diff.shape, np.int64)
    value[:, :WIDTH], length[:, :WIDTH] = values[diff[:, :WIDTH] + 255], lengths[diff[:, :WIDTH] + 255]
    pad = -length.sum(1) % 8
    value[:, WIDTH], length[:, WIDTH] = (1 << pad) - 1, pad
    data, offsets = pack_bits(value.reshape(-1), length.reshape(-1))
    begin = offsets[:: WIDTH + 1] // 8  # of each line, the end included
    stuffed = np.cumsum(data == 255)
    before = np.concatenate(([0], stuffed))
    line_of = np.repeat(np.arange(len(samples)), np.diff(begin))
    out = np.zeros(len(data) + int(before[-1]) + 2 * len(samples), np.uint8)
    out[np.arange(len(data)) + before[:-1] + 2 * line_of] = data
    after = begin[1:] + before[begin[1:]] + 2 * np.arange(len(samples))  # where each line's marker goes
    n_lines = [len(p) // WIDTH for p in payloads]
    in_doc = np.concatenate([np.arange(n) for n in n_lines])
    last = np.concatenate([np.arange(1, n + 1) == n for n in n_lines]) | (in_doc % LINES == LINES - 1)
    out[after], out[after + 1] = 0xFF, np.where(last, 0xD9, 0xD0 + in_doc % LINES % 8)
    raw, ends = out.tobytes(), (after[last] + 2).tolist()
    found, k, at = [], 0, 0
    for n in n_lines:
        own = []
        for first in range(0, n, LINES):
            own.append(frame_head(min(LINES, n - first)) + raw[at : ends[k]])
            at, k = ends[k], k + 1
        found.append(own)
    return found


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF file with stream headers, the frames and their index."""
    top = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, top, WIDTH, LINES, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), top, 0xFFFFFFFF, 0, 0, 0, WIDTH, LINES)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, LINES, 1, 8, b"MJPG", WIDTH * LINES, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for frame in frames:
        body.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index)))


def frame_spans(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of each frame, from the index; without one, from the chunks of ``movi``."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, found = 12, None, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1" and movi:
            found = [(movi[0] + o + 8, movi[0] + o + 8 + n) for c, _, o, n in struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + size]) if c[2:] == b"dc"]
        at += 8 + size + size % 2
    if found is None and movi:
        found, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = struct.unpack_from("<4sI", data, at)
            if name[2:] == b"dc":
                found.append((at + 8, at + 8 + size))
            at += 8 + size + size % 2
    return found or []


def parse_frame(data: bytes, at: int) -> tuple[int, int, bytes, int]:
    """Lines, samples a line, Huffman counts and values, and where the coded data begins."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, lines, width, table = at + 2, 0, 0, b""
    while True:
        marker, size = struct.unpack_from(">HH", data, at)
        if marker == 0xFFC3:
            _, lines, width = struct.unpack_from(">BHH", data, at + 4)
        elif marker == 0xFFC4:
            table = data[at + 5 : at + 2 + size]
        elif marker == 0xFFDA:
            return lines, width, table, at + 2 + size
        at += 2 + size


def decode_lines(coded: np.ndarray, width: int, table: bytes) -> np.ndarray:
    """The samples of all lines, each of which ends with a restart or end marker."""
    ff = np.flatnonzero(coded[:-1] == 255)
    follow = coded[ff + 1]
    marks, zeros = ff[(follow >= 0xD0) & (follow <= 0xD9)], ff[follow == 0] + 1
    keep = np.ones(len(coded), bool)
    keep[marks], keep[marks + 1], keep[zeros] = False, False, False
    plain = coded[keep]
    ends = np.cumsum(keep)[marks] if len(marks) else np.zeros(0, np.int64)
    bit = np.concatenate(([0], ends[:-1])).astype(np.int64) * 8 if len(ends) else np.zeros(0, np.int64)
    words = np.concatenate((windows32(plain), np.zeros(4, np.uint32)))
    diffs, used = read_tables(table)
    out, last = np.empty((width, len(ends)), np.int16), len(words) - 1
    for k in range(width):
        key = (words[np.minimum(bit >> 3, last)] << (bit & 7).astype(np.uint32)) >> np.uint32(16)
        out[k] = diffs[key]
        bit += used[key]
    return (np.cumsum(out, axis=0, dtype=np.int16) + 128).astype(np.uint8).T


def decode_many(files: list[bytes]) -> list[list[np.ndarray]]:
    """The frames of each file as arrays of lines and samples; frames that share tables and width are decoded together."""
    heads, groups = [], {}
    for data in files:
        own = []
        for begin, end in frame_spans(data):
            lines, width, table, at = parse_frame(data, begin)
            own.append((width, table, lines))
            groups.setdefault((width, table), []).append(data[at:end])
        heads.append(own)
    samples = {k: decode_lines(np.frombuffer(b"".join(v), np.uint8), *k) for k, v in groups.items()}
    at, out = dict.fromkeys(groups, 0), []
    for own in heads:
        frames = []
        for width, table, lines in own:
            k = (width, table)
            frames.append(samples[k][at[k] : at[k] + lines])
            at[k] += lines
        out.append(frames)
    return out


def shots(frames: list[np.ndarray], memory: int = 8, factor: float = 3.0, floor: float = 0.25) -> list[int]:
    """The first frame of each shot.

    A cut is where the histogram difference exceeds ``floor`` and the mean of
    up to ``memory`` differences since the last cut by ``factor`` deviations.
    """
    if not frames:
        return []
    hist = np.stack([np.bincount(f.reshape(-1) >> 3, minlength=BINS) / f.size for f in frames])
    diff = (np.abs(np.diff(hist, axis=0)).sum(1) / 2).tolist()
    cuts, past = [0], []
    for k, d in enumerate(diff, 1):
        mean = sum(past) / len(past) if past else 0.0
        spread = (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5 if past else 0.0
        if d > max(floor, mean + factor * spread):
            cuts.append(k)
            past = []
        else:
            past = [*past[1 - memory :], d]
    return cuts


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        raw = [(t or "").encode() for t in column(batch, "text")]
        padded = [x + bytes(-len(x) % WIDTH or (0 if x else WIDTH)) for x in raw]
        media = [write_avi(x) for x in frames_of(padded)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "media"):
        rows = []
        media = column(batch, "media")
        for doc_id, n, data, frames in zip(column(batch, "doc_id"), column(batch, "n_bytes"), media, decode_many(media)):
            payload = b"".join(f.tobytes() for f in frames)
            cuts = shots(frames)
            mean = sum(payload) / max(1, len(payload))
            clips = ",".join(f"{a * 1000 // FPS}-{b * 1000 // FPS}" for a, b in zip(cuts, [*cuts[1:], len(frames)]))
            feature = f"frames={len(frames)};shots={len(cuts)};clips_ms={clips};mean={mean:.4f}"
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in RESULT.split(", ")])


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "media"):
        rows = []
        for doc_id, frames in zip(column(batch, "doc_id"), decode_many(column(batch, "media"))):
            cuts = shots(frames)
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(frames)])):
                rows.append((doc_id, k, a, b - a, a * 1000 // FPS, b * 1000 // FPS))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in CLIPS.split(", ")])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI file of each text; null texts count as empty, whose payload is 64 zeros."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_write, MEDIA)


def describe(media: DataFrame) -> DataFrame:
    """What is read back from each file, one row per file; repeated rows stay, an empty table gives none."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, RESULT)


def clips(media: DataFrame) -> DataFrame:
    """Timed rows, one per shot."""
    ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_clips, CLIPS)
