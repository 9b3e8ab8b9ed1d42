"""Recurrences over the ordered rows of each key, as scans of associative maps.

What a row does to a state is a map, and maps compose associatively, so a key's
rows need not pass through one task: the frame is sorted by range of (key,
order) and written in blocks, each with the map of what came before it in its
first key and task. Of a task's keys only the first can have begun before, so
one composed map a task, put together on the driver, gives every block the map
of all rows before it, and the maps of single rows are made in memory only.
Rows of one key are in as many tasks as they fill; memory is bounded by an
Arrow batch.

Rows of one key and order value follow in an arbitrary order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.core import ship

TASK_ROWS, LEAST_ROWS = 1_000_000, 4096
#: Rows that follow each other one by one; and the row groups in which blocks are written, so that a task holds few of them.
STEPS, FILE_BLOCK = 64, 1 << 24
STATES = "map array<double>, start array<double>"
BLOCKS = f"part long, block long, first_key string, rows binary, seen long, {STATES}, last_key string, last_seen long, last_{STATES.replace(', ', ', last_')}"


class Family:
    """Maps of one kind: ``width`` numbers describe one, ``neutral`` the one that changes nothing."""

    width: int
    neutral: np.ndarray
    outputs: tuple[str, ...]

    def elements(self, x: np.ndarray) -> np.ndarray:
        """The map of each row from its inputs."""
        raise NotImplementedError

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Row by row the map that does ``first`` and ``then``."""
        raise NotImplementedError

    def said(self, before: np.ndarray, x: np.ndarray, start: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """The output columns, from the maps of all earlier rows, the rows' inputs, those of the key's first row and the place in the key."""
        raise NotImplementedError


class Clamped(Family):
    """x becomes x + input, kept between two bounds: maps are (shift, low, high). Outputs the state after each row."""

    width, neutral, outputs = 3, np.array([0.0, -np.inf, np.inf]), ("state",)

    def __init__(self, start: float, low: float, high: float) -> None:
        self.start, self.low, self.high = start, low, high

    def elements(self, x):
        out = np.tile([0.0, self.low, self.high], (len(x), 1))
        out[:, 0] = x[:, 0]
        out[np.isnan(x[:, 0])] = self.neutral
        return out

    def compose(self, first, then):
        shift, low, high = then.T
        return np.column_stack((first[:, 0] + shift, np.maximum(low, np.minimum(high, first[:, 1] + shift)), np.maximum(low, np.minimum(high, first[:, 2] + shift))))

    def said(self, before, x, start, place):
        shift, low, high = self.compose(before, self.elements(x)).T
        return [np.clip(self.start + shift, low, high)]


class Smoothed(Family):
    """Level and trend of exponential smoothing for every pair of a grid; a trend weight of 0 keeps the level alone.

    Starts at the key's first value without trend. Outputs for each pair the
    forecast made before the row (null for the first) and the one after it.
    """

    def __init__(self, levels: Sequence[float], trends: Sequence[float] = (0.0,)) -> None:
        self.grid = [(a, b) for a, b in product(levels, trends)]
        a, b = np.array(self.grid).T
        self.turn = np.stack((1 - a, 1 - a, -a * b, 1 - a * b), 1).reshape(-1, 2, 2)
        self.gain = np.stack((a, a * b), 1)
        self.width = 6 * len(a)
        self.neutral = np.tile([1.0, 0, 0, 1, 0, 0], len(a))
        self.outputs = tuple(f"{w}_{k}" for w in ("before", "after") for k in range(len(a)))

    def _parts(self, maps):
        maps = maps.reshape(len(maps), len(self.grid), 6)
        return maps[..., :4].reshape(*maps.shape[:2], 2, 2), maps[..., 4:]

    def _whole(self, turn, add):
        return np.concatenate((turn.reshape(*turn.shape[:2], 4), add), -1).reshape(len(turn), self.width)

    def elements(self, x):
        seen = ~np.isnan(x[:, 0])
        out = self._whole(np.tile(self.turn, (len(x), 1, 1, 1)), x[:, :1, None] * self.gain)
        out[~seen] = self.neutral
        return out

    def compose(self, first, then):
        (m, v), (n, w) = self._parts(first), self._parts(then)
        turn = n[..., :, :1] * m[..., :1, :] + n[..., :, 1:] * m[..., 1:, :]
        return self._whole(turn, n[..., 0] * v[..., :1] + n[..., 1] * v[..., 1:] + w)

    def said(self, before, x, start, place):
        out = []
        for maps in (before, self.compose(before, self.elements(x))):
            turn, add = self._parts(maps)
            state = turn[..., 0] * start[:, :1, None] + add
            out.append(state.sum(-1))
        out[0][place == 1] = np.nan
        return [*out[0].T, *out[1].T]


class LocalLevel(Family):
    """The filter of a level that wanders and is seen with noise: inputs are value, variance of the steps, variance of the noise.

    Maps are the five numbers of the filter's associative form. Starts at the
    key's first value with the variance of one observation; a null value adds
    uncertainty only. Outputs the forecast made before the row (null for the
    first), level and variance after it.
    """

    width, neutral, outputs = 5, np.array([1.0, 0, 0, 0, 0]), ("predicted", "level", "variance")

    def elements(self, x):
        z, q, r = x.T
        gain = np.where(np.isnan(z), 0, q / (q + r))
        z = np.where(np.isnan(z), 0, z)
        seen = np.where(gain > 0, 1.0, 0) / (q + r)
        return np.column_stack((1 - gain, gain * z, (1 - gain) * q, z * seen, seen))

    def compose(self, first, then):
        a, b, c, h, j = first.T
        a2, b2, c2, h2, j2 = then.T
        d = 1 / (1 + c * j2)
        return np.column_stack((a2 * d * a, a2 * d * (b + c * h2) + b2, a2 * a2 * d * c + c2, a * d * (h2 - j2 * b) + h, a * a * d * j2 + j))

    def said(self, before, x, start, place):
        p, zero = start[:, 2], np.zeros(len(x))
        prior = np.column_stack((zero, start[:, 0], p, zero, zero))
        earlier, now = self.compose(prior, before), self.compose(prior, self.compose(before, self.elements(x)))
        return [np.where(place == 1, np.nan, earlier[:, 1]), now[:, 1], now[:, 2]]


def doubled(family: Family, maps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each row's map composed with those before it from row ``begin`` on, by doubling."""
    out, step, at = maps, 1, np.arange(len(maps))
    while (ok := np.flatnonzero(at - step >= begin)).size:
        new = out.copy()
        new[ok] = family.compose(out[ok - step], out[ok])
        out, step = new, step * 2
    return out


def prefixes(family: Family, maps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each row's map composed with those before it from row ``begin`` on: step by step in short runs side by side, whose ends are then put together by doubling."""
    at = np.arange(len(maps))
    runs = np.flatnonzero((at - begin) % STEPS == 0)
    size, out = np.diff(np.append(runs, len(maps))), maps.copy()
    for step in range(1, int(size.max(initial=0))):
        rows = runs[size > step] + step
        out[rows] = family.compose(out[rows - 1], maps[rows])
    first, run = np.searchsorted(runs, begin[runs]), np.repeat(np.arange(len(runs)), size)
    if (later := np.flatnonzero(run > first[run])).size:
        ends = doubled(family, out[runs + size - 1], first)
        out[later] = family.compose(ends[run[later] - 1], out[later])
    return out


def total(family: Family, maps: np.ndarray) -> np.ndarray:
    """All rows' maps as one."""
    while len(maps) > 1:
        even = len(maps) // 2 * 2
        maps = np.concatenate((family.compose(maps[:even:2], maps[1:even:2]), maps[even:]))
    return maps[0]


def numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns as doubles, null as NaN."""
    return np.column_stack([pc.fill_null(pc.cast(batch.column(batch.schema.get_field_index(n)), pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for n in names])


def begins(keys: pa.Array) -> np.ndarray:
    """The row where each row's key begins."""
    new = np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _blocks(batches: Iterator[pa.RecordBatch], family: Family, inputs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; a batch becomes a block, with the state in which its first key comes to it and its last key leaves, within this task."""
    part, key, state, zipped = TaskContext.get().partitionId(), None, None, pa.ipc.IpcWriteOptions(compression="zstd")
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first_key", pa.string()), ("rows", pa.binary()), *[(f"{last}{n}", kind) for last in ("", "last_") for n, kind in (("key", pa.string()), ("seen", pa.int64()), ("map", pa.list_(pa.float64())), ("start", pa.list_(pa.float64()))) if last or n != "key"]])
    for number, batch in enumerate(b for b in batches if b.num_rows):
        keys, x = batch.column(batch.schema.get_field_index("scan_key")), numbers(batch, inputs)
        before = state if keys[0].as_py() == key else (0, family.neutral, x[0])
        tail = int(begins(keys)[-1])
        seen, map_, start = (0, family.neutral, x[tail]) if tail else before
        own = total(family, family.elements(x[tail:]))
        key, state = keys[-1].as_py(), (seen + len(x) - tail, family.compose(map_[None], own[None])[0], start)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=zipped) as out:
            out.write_batch(batch)
        row = [part, number, keys[0].as_py(), sink.getvalue().to_pybytes(), *before, key, *state]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def _finish(batches: Iterator[pa.RecordBatch], family: Family, inputs: Sequence[str], kept: Sequence[str], carries: dict) -> Iterator[pa.RecordBatch]:
    for blocks in batches:
        fields = [blocks.column(blocks.schema.get_field_index(n)) for n in ("part", "rows", "seen", "map", "start")]
        for part, rows, seen, map_, first in zip(*fields):
            batch = pa.ipc.open_stream(rows.as_buffer()).read_next_batch()
            col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            x, keys, at = numbers(batch, inputs), col("scan_key"), np.arange(batch.num_rows)
            begin = begins(keys)
            whole = prefixes(family, family.elements(x), begin)
            before = np.where((at == begin)[:, None], family.neutral, np.roll(whole, 1, axis=0))
            place, start, m = at - begin + 1, x[begin], int(np.searchsorted(begin, 0, "right"))
            earlier = [(seen.as_py(), np.array(map_.values), np.array(first.values))]
            if (carry := carries.get(part.as_py())) and carry[0] == keys[0].as_py():
                earlier.append(carry[1:])
            for n, of, begun in earlier:  # of the block's first key
                if n:
                    before[:m] = family.compose(np.tile(of, (m, 1)), before[:m])
                    place[:m] += n
                    start[:m] = begun
            out = [pa.array(v, pa.float64(), from_pandas=True) for v in family.said(before, x, start, place)]
            yield pa.RecordBatch.from_arrays([*[col(n) for n in kept], pa.array(place), *out], names=[*kept, "place", *family.outputs])


def scan(df: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], family: Family, scratch: str) -> DataFrame:
    """``df`` with ``place`` (the row's number in its key, from 1) and the family's outputs.

    ``scratch`` is a new folder that all tasks share; what is written there
    cuts the lineage. Null inputs are handled by the family; an empty frame
    gives no rows.
    """
    spark, kept = df.sparkSession, df.columns
    ship(spark)
    df.write.parquet(f"{scratch}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{scratch}/rows")
    n = rows.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS), -(-n // TASK_ROWS))
    rows = rows.withColumn("scan_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    dealt = rows.repartitionByRange(parts, "scan_key", *order).sortWithinPartitions("scan_key", *order)
    dealt = dealt.mapInArrow(partial(_blocks, family=family, inputs=inputs), BLOCKS)
    dealt.write.option("parquet.block.size", FILE_BLOCK).parquet(f"{scratch}/blocks")
    dealt = spark.read.schema(dealt.schema).parquet(f"{scratch}/blocks")
    last = F.max_by(F.struct("last_key", "last_seen", "last_map", "last_start"), "block")
    carries, now = {}, None
    for r in dealt.groupBy("part").agg(F.min_by("first_key", "block").alias("first"), last.alias("last")).orderBy("part").collect():
        if now and now[0] == r["first"]:
            carries[r["part"]] = now
        key_, seen, map_, start = r["last"]
        map_ = np.array(map_)
        if r["part"] in carries and key_ == r["first"]:
            _, before, earlier, begun = carries[r["part"]]
            now = (key_, before + seen, family.compose(earlier[None], map_[None])[0], begun)
        else:
            now = (key_, seen, map_, np.array(start))
    result = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept], "place long", *[f"{o} double" for o in family.outputs]])
    return dealt.mapInArrow(partial(_finish, family=family, inputs=inputs, kept=kept, carries=carries), result)
