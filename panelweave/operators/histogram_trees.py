"""Forests and boosted regression trees from histograms of binned rows, one pass over compact blocks a level.

Columns are cut at their percentiles in at most ``BINS`` bins, and rows are
written once as blocks of bytes: a byte for each bin, a hash and the label. A
pass adds up counts and sums of labels by node, column and bin within its
tasks, the tasks' tables meet tree by tree, and only the chosen splits come to
the driver. Which rows a tree takes follows from the row's hash alone; edges
are percentiles within a thousandth of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.core import ship
from panelweave.scans import numbers
from panelweave.sources.files import scratch

BINS, BLOCK, FILE_BLOCK, ACCURACY = 32, 1 << 14, 1 << 24, 1000
BLOCKS = "x binary, h binary, y binary, m int"
KEYED = "x binary, h binary, y binary, m int, entity binary, day binary"
SPLITS = "tree int, cut_column binary, cut binary, gain binary, left binary, right binary"


class Trees:
    """Fitted trees as heaps: node k has children 2k + 1 and 2k + 2. A node that isn't split sends all rows left, with its own value."""

    def __init__(self, columns: Sequence[str], edges: Sequence[np.ndarray], depth: int, trees: int, weights: np.ndarray):
        inner = (1 << depth) - 1
        self.columns, self.edges, self.depth, self.weights = list(columns), list(edges), depth, weights
        self.column, self.cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.uint8)
        self.gain, self.value = np.zeros((trees, inner)), np.zeros((trees, 2 * inner + 1))

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Column by row: how many edges lie below the value."""
        return np.stack([np.searchsorted(e, v).astype(np.uint8) for e, v in zip(self.edges, x.T)])

    def nodes(self, bins: np.ndarray, tree: int, levels: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The place of each row (or of ``rows``) among the nodes of a level."""
        flat, n = bins.reshape(-1), bins.shape[1]
        at = np.arange(n) if rows is None else rows
        node, start, cut = np.zeros(len(at), np.int64), self.column[tree] * n, self.cut[tree]
        for level in range(levels):  # numbered within their level
            own = slice((1 << level) - 1, (2 << level) - 1)
            place = start[own].take(node)
            place += at
            right = flat.take(place) > cut[own].take(node)
            node += node
            node += right
        return node

    def predict(self, bins: np.ndarray, trees: Sequence[int] | None = None) -> np.ndarray:
        out, leaf = np.zeros(bins.shape[1]), (1 << self.depth) - 1
        for t in range(len(self.column)) if trees is None else trees:
            out += (self.weights[t] * self.value[t][leaf:]).take(self.nodes(bins, t, self.depth))
        return out

    @property
    def importances(self) -> np.ndarray:
        """Each column's share of a tree's gain, averaged over the trees."""
        each = np.stack([np.bincount(c, g, len(self.columns)) for c, g in zip(self.column, self.gain)])
        each = each / np.maximum(each.sum(1, keepdims=True), 1e-300)
        return each.mean(0) / max(each.mean(0).sum(), 1e-300)


class Draw:
    """How often each tree takes a row, from the row's hash: Poisson numbers of mean ``rate`` (drawn with replacement), or 0 and 1."""

    def __init__(self, rate: float, replace: bool, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, trees, np.uint64) * np.uint64(2) + np.uint64(1)
        mass = np.exp(-rate) * np.cumprod(np.append(1.0, rate / np.arange(1, 12))) if replace else np.array([1 - rate, rate])
        self.table = np.searchsorted(np.cumsum(mass)[:-1], (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype(np.uint8)

    def __add__(self, more: Draw) -> Draw:
        """The trees of both; their tables are the same."""
        both = copy(self)
        both.odd = np.concatenate((self.odd, more.odd))
        return both

    def of(self, h: np.ndarray, tree: int) -> np.ndarray:
        return self.table[(h * self.odd[tree]) >> np.uint64(48)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatters 32 bits over 64."""
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def batched(x: np.ndarray, h: np.ndarray, y: np.ndarray, m: int) -> pa.RecordBatch:
    parts = [pa.array([p.tobytes()], pa.binary()) for p in (x, h.astype("<u4"), y.astype("<f8"))]
    return pa.RecordBatch.from_arrays([*parts, pa.array([m], pa.int32())], names=["x", "h", "y", "m"])


def opened(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """A block's bins by column and row, hashes, labels, and how many of the first rows are drawn."""
    for batch in batches:
        for x, h, y, m in zip(*(batch.column(batch.schema.get_field_index(n)) for n in "xhym")):
            yield np.frombuffer(x.as_buffer(), np.uint8).reshape(columns, -1), np.frombuffer(h.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<f8"), m.as_py()


def _blocks(batches: Iterator[pa.RecordBatch], model: Trees) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        h = batch.column(batch.schema.get_field_index("_hash")).to_numpy(zero_copy_only=False)
        held.append((model.binned(numbers(batch, model.columns)), h & 0xFFFFFFFF, numbers(batch, ["_label"])[:, 0]))
        size += batch.num_rows
        if size >= BLOCK:
            yield batched(*(np.concatenate(p, -1) for p in zip(*held)), size)
            held, size = [], 0
    if size:
        yield batched(*(np.concatenate(p, -1) for p in zip(*held)), size)


def _drawn(batches: Iterator[pa.RecordBatch], model: Trees, draw: Draw, tree: int) -> Iterator[pa.RecordBatch]:
    """Labels less the forecast of the tree before ``tree``, and the rows that ``tree`` takes put first."""
    for x, h, y, _ in opened(batches, len(model.columns)):
        if tree:
            y = y - model.predict(x, [tree - 1])
        taken = draw.of(mixed(h), tree) > 0
        first = np.flatnonzero(taken)
        order = np.concatenate((first, np.flatnonzero(~taken)))
        yield batched(x.take(order, 1), h.take(order), y.take(order), len(first))


def shadowed(batches: Iterator[pa.RecordBatch], model: Trees, chosen: dict[int, np.ndarray], rounds: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, dict[int, np.ndarray]]]:
    """Blocks of whole entities, once for each seed: their columns, the same dealt anew among the rows of their entity, and the seed's trees. The rows in order of day take values in order of a hash of the day."""
    share = len(model.column) // len(rounds)
    for batch in batches:
        extra = [batch.column(batch.schema.get_field_index(n)) for n in ("entity", "day")]
        for (x, h, y, m), *keys in zip(opened([batch], len(model.columns) // 2), *extra):
            entity, day = (np.frombuffer(k.as_buffer(), "<i4") for k in keys)
            for k, seed in enumerate(rounds):
                order = np.lexsort((day, mixed((day.astype(np.int64) ^ (seed * 0x9E3779B1)) & 0xFFFFFFFF), entity))
                yield np.concatenate((x, x.take(order, 1))), h, y, m, {t: of for t, of in chosen.items() if t // share == k}


def _count(batches: Iterator[pa.RecordBatch], model: Trees, draw: Draw | None, chosen: dict[int, np.ndarray], level: int, rounds: Sequence[int] = ()) -> Iterator[pa.RecordBatch]:
    """A task's counts and sums of labels by tree, node, chosen column and bin; without ``draw`` of the rows that come first as drawn; with ``rounds`` each seed's share of the trees sees the columns and their values as that seed deals them."""
    total = {}
    blocks = shadowed(batches, model, chosen, rounds) if rounds else ((*block, chosen) for block in opened(batches, len(model.columns)))
    for bins, h, y, m, chosen in blocks:
        width = bins.shape[1]
        if draw is None:
            bins, y, width = np.ascontiguousarray(bins[:, :m]), y[:m], m
        flat, h = bins.reshape(-1), None if draw is None else mixed(h)
        for tree, of in chosen.items():
            size, w, rows, wy = of.shape[0] * BINS, None, None, y
            if draw is not None:
                count = draw.of(h, tree)
                rows = np.flatnonzero(count)
                w = count.take(rows).astype(float)
                wy = w * y.take(rows)
            node = model.nodes(bins, tree, level, rows)
            place = node * BINS
            found = total.setdefault(tree, np.zeros((2, of.shape[1], size)))
            for j in range(of.shape[1]):
                if rows is None:  # every column in turn
                    key = place + bins[j]
                else:
                    at = (of[:, j] * width).take(node)
                    at += rows
                    key = place + flat.take(at)
                found[0, j] += np.bincount(key, w, size)
                found[1, j] += np.bincount(key, wy, size)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["tree", "found"])


def split(found: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Each node's column, cut, gain and the two sides' means. ``found`` is counts and sums by chosen column, node and bin."""
    (n, s), nodes = (x.reshape(of.shape[1], of.shape[0], BINS).transpose(1, 0, 2) for x in found), np.arange(of.shape[0])
    left, sums = n.cumsum(2), s.cumsum(2)
    whole, total = left[:, :1, -1:], sums[:, :1, -1:]
    right = whole - left
    gain = sums**2 / np.maximum(left, 1) + (total - sums) ** 2 / np.maximum(right, 1) - total**2 / np.maximum(whole, 1)
    gain = np.where((left >= least) & (right >= least), gain, -1).reshape(len(nodes), -1)
    best = gain.argmax(1)
    top, j, k = gain[nodes, best], best // BINS, best % BINS
    ok, mean = top > 1e-12, (total / np.maximum(whole, 1))[:, 0, 0]
    a = np.where(ok, sums[nodes, j, k] / np.maximum(left[nodes, j, k], 1), mean)
    b = np.where(ok, (total[:, 0, 0] - sums[nodes, j, k]) / np.maximum(right[nodes, j, k], 1), mean)
    return np.where(ok, of[nodes, j], 0), np.where(ok, k, 255).astype(np.uint8), np.where(ok, top, 0.0), a, b


def grown(blocks: DataFrame, model: Trees, draw: Draw | None, chosen: dict[int, np.ndarray], level: int, least: int, rounds: Sequence[int] = ()) -> None:
    """Splits the nodes of a level of the trees that ``chosen`` names, each by its columns there."""

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        tree = int(g["tree"].iloc[0])
        found = sum(np.frombuffer(x) for x in g["found"]).reshape(2, chosen[tree].shape[1], -1)
        return pd.DataFrame([[tree, *(x.tobytes() for x in split(found, chosen[tree], least))]], columns=["tree", "cut_column", "cut", "gain", "left", "right"])

    tables = blocks.mapInArrow(partial(_count, model=model, draw=draw, chosen=chosen, level=level, rounds=rounds), "tree int, found binary")
    first, kinds = (1 << level) - 1, (("cut_column", np.int64), ("cut", np.uint8), ("gain", float), ("left", float), ("right", float))
    rows = tables.groupBy("tree").applyInPandas(meet, SPLITS).collect()
    if not rows:
        raise ValueError("no rows to learn from")
    for r in rows:
        column, cut, gain, left, right = (np.frombuffer(r[n], t) for n, t in kinds)
        tree, own = r["tree"], slice(first, 2 * first + 1)
        model.column[tree, own], model.cut[tree, own], model.gain[tree, own] = column, cut, gain
        model.value[tree, 2 * first + 1 : 4 * first + 3] = np.column_stack((left, right)).reshape(-1)


class Binned:
    """Training rows as blocks in the shared folder, in small row groups, so that a task holds few of them; any number of fits read them."""

    def __init__(self, train: DataFrame, columns: Sequence[str], label: str):
        spark = train.sparkSession
        ship(spark)
        names = [c for c in ("entity_id", "date") if c in train.columns]
        rows = train.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_label"), F.xxhash64(*names, *columns, label).alias("_hash"))
        found = rows.agg(*[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], ACCURACY).alias(c) for c in columns]).first()
        self.columns, self.edges = list(columns), [np.unique(np.array(found[c] or [], float)) for c in columns]
        path = scratch(spark, "blocks")
        blocks = rows.mapInArrow(partial(_blocks, model=self.model(0, 0, np.zeros(0))), BLOCKS)
        blocks.write.option("parquet.block.size", FILE_BLOCK).parquet(path)
        self.blocks = spark.read.schema(blocks.schema).parquet(path)

    def model(self, depth: int, trees: int, weights: np.ndarray) -> Trees:
        return Trees(self.columns, self.edges, depth, trees, weights)


def forest(data: Binned, seed: int, trees: int, depth: int, least: int, rate: float) -> Trees:
    """Trees on rows drawn with replacement, each node by a third of the columns."""
    model, count = data.model(depth, trees, np.full(trees, 1 / trees)), len(data.columns)
    draw, rng, some = Draw(rate, True, trees, seed), np.random.default_rng(seed + 1), -(-count // 3)
    for level in range(depth):
        grown(data.blocks, model, draw, {t: rng.random((1 << level, count)).argsort(1)[:, :some] for t in range(trees)}, level, least)
    return model


def _entities(batches: Iterator[pa.RecordBatch], model: Trees) -> Iterator[pa.RecordBatch]:
    """Blocks of whole entities, whose rows come one after another in order of day; a block ends with the first entity that fills it."""
    held, size, last, number = [], 0, None, 0

    def block() -> pa.RecordBatch:
        x, h, y, entity, day = (np.concatenate(p, -1) for p in zip(*held))
        out = batched(x, h, y, x.shape[1])
        return pa.RecordBatch.from_arrays([*out.columns, *[pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (entity, day)]], names=[*out.schema.names, "entity", "day"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, day, h = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("_entity", "_day", "_hash"))
        new = np.append(key[0] != last, key[1:] != key[:-1])
        entity, last = number + np.cumsum(new), key[-1]
        number = int(entity[-1])
        row = model.binned(numbers(batch, model.columns)), h & 0xFFFFFFFF, numbers(batch, ["_label"])[:, 0], entity, day
        start = 0
        for cut in np.flatnonzero(new).tolist():
            if size + cut - start >= BLOCK:
                held.append([p[..., start:cut] for p in row])
                yield block()
                held, size, start = [], 0, cut
        held.append([p[..., start:] for p in row])
        size += batch.num_rows - start
    if size:
        yield block()


def shadow_forests(series: DataFrame, columns: Sequence[str], label: str, seeds: Sequence[int], trees: int, depth: int, least: int, rate: float) -> list[np.ndarray]:
    """The importances of columns and their shadows in a forest for each seed; all forests grow in the same passes over blocks that are written once.

    ``series`` has a row ``_entity, _rows`` for each entity with its rows in order of date. A shadow has the values of its column, so it has its edges and bins too.
    """
    spark = series.sparkSession
    ship(spark)
    rows = series.select("_entity", F.explode("_rows").alias("r")).select("_entity", F.unix_date(F.col("r.date").cast("date")).alias("_day"), *[F.col(f"r.{c}").cast("double").alias(c) for c in columns], F.col(f"r.{label}").cast("double").alias("_label"))
    found = rows.agg(*[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], ACCURACY).alias(c) for c in columns]).first()
    edges = [np.unique(np.array(found[c] or [], float)) for c in columns]
    path = scratch(spark, "blocks")
    hashed = rows.withColumn("_hash", F.xxhash64("_entity", "_day", *columns, "_label"))
    blocks = hashed.mapInArrow(partial(_entities, model=Trees(columns, edges, 0, 0, np.zeros(0))), KEYED)
    blocks.write.option("parquet.block.size", FILE_BLOCK).parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    names, count = [*columns, *[f"shadow_{c}" for c in columns]], 2 * len(columns)
    model = Trees(names, edges * 2, depth, trees * len(seeds), np.full(trees * len(seeds), 1 / trees))
    draw, rngs, some = reduce(Draw.__add__, [Draw(rate, True, trees, seed) for seed in seeds]), [np.random.default_rng(seed + 1) for seed in seeds], -(-count // 3)
    for level in range(depth):
        chosen = {k * trees + t: rng.random((1 << level, count)).argsort(1)[:, :some] for k, rng in enumerate(rngs) for t in range(trees)}
        grown(blocks, model, draw, chosen, level, least, list(seeds))
    out = []
    for k in range(len(seeds)):
        own = Trees(names, edges * 2, depth, trees, np.full(trees, 1 / trees))
        own.column, own.gain = (v[k * trees : (k + 1) * trees] for v in (model.column, model.gain))
        out.append(own.importances)
    return out


def boosted(data: Binned, seed: int, trees: int, depth: int, least: int, rate: float, step: float) -> Trees:
    """A tree of the labels, then trees of what is left: each is twice the mean that is left (the slope of the squared error), taken by ``step``.

    Blocks with what is left are kept for one tree, memory first.
    """
    model, every = data.model(depth, trees, np.append(1.0, np.full(trees - 1, 2 * step))), np.arange(len(data.columns))
    draw, blocks = Draw(rate, False, trees, seed), data.blocks
    for tree in range(trees):
        last, blocks = blocks, blocks.mapInArrow(partial(_drawn, model=model, draw=draw, tree=tree), BLOCKS).persist()
        for level in range(depth):
            grown(blocks, model, None, {tree: np.tile(every, (1 << level, 1))}, level, least)
            if tree and not level:
                last.unpersist()
    blocks.unpersist()
    return model


def _predicted(batches: Iterator[pa.RecordBatch], model: Trees, inputs: Sequence[Sequence[str]], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            out = [pa.array(model.predict(model.binned(numbers(batch, own)))) for own in inputs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])


def predicted(model: Trees, df: DataFrame, inputs: dict[str, Sequence[str]]) -> DataFrame:
    """``df`` with a forecast for each name, from the columns given for it, in the order of the model's."""
    ship(df.sparkSession)
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`{n}` double" for n in inputs]])
    return df.mapInArrow(partial(_predicted, model=model, inputs=list(inputs.values()), names=list(inputs)), ddl)
