"""A Merkle manifest of a dataset, with a proof for every row, by slot pivots.

Each row is a leaf. Per source the leaves are put in order and numbered; 16
consecutive nodes become their parent by one aggregation whose conditional
columns ``c0`` to ``c15`` are the slots: the columns joined and hashed are the
parent, and joined without the own one they are a node's siblings. The roots
of the sources are the leaves of one more tree of the same kind.

Levels go up until each source has one node, as tables of a sixteenth of the
rows each; the siblings of what lies above come down the same way, so that a
run of leaves, not each leaf, receives them.

Numbers come from a sort by range: only a source that begins in an earlier
task needs an offset, which is one row a task, so a source of any size is
numbered by many tasks and nothing grows in one of them.

Edge cases: a null field is hashed as ``-``, an empty one as ``0:``; a null
source is one of its own and comes first; rows of a null doc_id come first in
their source and are never tampered with; rows of one doc_id follow by their
leaf, and equal rows are leaves of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import materialize, ship, tasks

FANOUT, TAMPER, TASK_ROWS, LEAST_ROWS = 16, 5, 1_000_000, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"
SLOTS = [f"c{k}" for k in range(FANOUT)]
LONE = "parent = 0 AND c1 IS NULL"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row: every field's byte count and value, one after another."""
    said = [c.cast("string") for c in values.values()]
    return digest(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]))


def leaves(docs: DataFrame, every: int = TAMPER) -> DataFrame:
    """Per row: its source as a key that sorts null first, doc_id, leaf, and where ``every`` divides its checksum the leaf of the tampered row."""
    values = {c: F.col(c) for c in FIELDS}
    folded = values | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, leaf(folded))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(key.alias("g"), F.col("doc_id").cast("long"), leaf(values).alias("leaf"), forged.alias("forged"), F.monotonically_increasing_id().alias("tie"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; each gets its number among those of its group in this task."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(batch.schema.get_field_index("g"))
        new = np.append(g[0].as_py() != last, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
        row = np.arange(len(g))
        start = np.maximum.accumulate(np.where(new, row, -seen))
        at = row - start
        last, seen = g[-1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), part, np.int64)), pa.array(at, pa.int64()), *batch.columns], names=["part", "at", *batch.schema.names])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the number of each row within its ``g``, counted in ``order``, and drops ``tie``."""
    spark = rows.sparkSession
    ship(spark)
    n = rows.count()
    parts = max(1, min(tasks(spark), n // LEAST_ROWS), -(-n // TASK_ROWS))
    keys = ["g", *order]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.mapInArrow(_number, f"part long, at long, {names}"), "numbered")
    # of a task's groups only the first can have begun before it
    edges = dealt.groupBy("part").agg(F.min("g").alias("first"), F.max(F.struct("g", "at")).alias("last")).orderBy("part").collect()
    before, carried = [], ("", 0)
    for r in edges:
        offset = carried[1] if before and r["first"] == carried[0] else 0
        before.append((r["part"], r["first"], offset))
        carried = (r["last"]["g"], r["last"]["at"] + 1 + (offset if r["last"]["g"] == r["first"] else 0))
    table = spark.createDataFrame([x for x in before if x[2]], "part long, g string, before long")
    found = dealt.join(F.broadcast(table), ["part", "g"], "left")
    return found.withColumn("pos", F.col("at") + F.coalesce("before", F.lit(0))).drop("part", "at", "before", "tie")


def joined(slots: list[str]) -> str:
    """The digests of these slots one after another, as SQL; written as text, which the driver builds in one call."""
    return f"concat({', '.join(f"coalesce({c}.leaf, '')" for c in slots)})" if slots else "''"


def pivot(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """A row for each parent: its children in the columns ``c0`` to ``c15``, and their common digest."""
    slots = [F.expr(f"first(CASE WHEN pmod(pos, {FANOUT}) = {k} THEN struct({', '.join(kept)}) END, true)").alias(c) for k, c in enumerate(SLOTS)]
    return nodes.groupBy("g", F.expr(f"pos div {FANOUT}").alias("parent")).agg(*slots).withColumn("digest", F.expr(f"sha2({joined(SLOTS)}, 256)"))


def climb(nodes: DataFrame, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees from the bottom, and the root of each group. A parent with one child and no neighbour is that root itself."""
    levels, roots = [], []
    while True:
        levels.append(materialize(pivot(nodes, kept), "merkle-level"))
        roots.append(levels[-1].where(LONE).select("g", F.col("c0.leaf").alias("subroot")))
        nodes, kept = levels[-1].where(f"NOT ({LONE})").select("g", F.col("parent").alias("pos"), F.col("digest").alias("leaf")), ["leaf"]
        if nodes.isEmpty():
            break
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def children(groups: DataFrame, *carried: str) -> DataFrame:
    """A row for each child: its siblings in ``left`` and ``right``, joined to what its parent has above."""
    each = ", ".join(f"struct({k} AS slot, {c} AS own, {joined(SLOTS[:k])} AS left, {joined(SLOTS[k + 1 :])} AS right)" for k, c in enumerate(SLOTS))
    rows = groups.select("g", "parent", "path", F.expr(LONE).alias("lone"), *carried, F.expr(f"explode(array({each}))").alias("x")).where("x.own IS NOT NULL")
    step = F.when(F.col("lone"), F.array().cast(PATH)).otherwise(F.array(F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right"))))
    return rows.select("g", (F.col("parent") * FANOUT + F.col("x.slot")).alias("pos"), F.col("x.own").alias("own"), F.concat(step, "path").alias("path"), *carried)


def descend(levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """The children of the lowest level with their paths; ``tops`` has the path above each group's root."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        groups = levels[k].where(LONE).join(tops, "g")
        if above is not None:
            rest = levels[k].where(f"NOT ({LONE})").join(above.withColumnRenamed("pos", "parent"), ["g", "parent"])
            groups = groups.unionByName(rest)
        above = children(groups, *carried)
        if k:
            above = materialize(above.drop("own"), "merkle-paths")
    return above


@dataclass(frozen=True)
class Manifest:
    """Levels of the sources' trees and of the tree above them; ``root`` is None for an empty dataset."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """Every digest: tree (``source`` or ``dataset``), source, level from the leaves, position."""
        out = None
        for tree, levels in (("source", self.levels), ("dataset", self.top)):
            for k, level in enumerate(levels):
                each = F.posexplode(F.array(*[F.col(f"{c}.leaf") for c in SLOTS]))
                rows = level.select("g", "parent", each.alias("slot", "digest")).where("digest IS NOT NULL")
                source = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30))
                rows = rows.select(F.lit(tree).alias("tree"), source.alias("source"), F.lit(k).alias("level"), (F.col("parent") * FANOUT + F.col("slot")).alias("position"), "digest")
                out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """Per row: doc_id, leaf, forged, the siblings on the way to the root as pairs of left and right, its source's root."""
        empty = F.array().cast(PATH)
        tops = self.top[0].sparkSession.range(1).select(F.lit("").alias("g"), empty.alias("path"))
        roots = descend(self.top, tops).select(F.col("own.source").alias("g"), F.col("own.leaf").alias("subroot"), "path")
        return descend(self.levels, materialize(roots, "merkle-roots"), "subroot").select("own.*", "path", "subroot")


def build(docs: DataFrame) -> Manifest:
    rows = numbered(materialize(leaves(docs), "leaves"), ["doc_id", "leaf", "tie"])
    levels, roots = climb(rows, ["doc_id", "leaf", "forged"])
    above = materialize(roots.select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("subroot").alias("leaf")), "subroots")
    top, root = climb(numbered(above, ["source"]), ["source", "leaf"])
    found = root.first()
    return Manifest(levels, top, found and found["subroot"])


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to with the given siblings."""
    return F.aggregate(path, start, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def report(docs: DataFrame) -> DataFrame:
    """Proves every row, the tampered ones by what they hold now."""
    manifest = build(docs)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    rows = manifest.proofs().withColumn("root", F.lit(manifest.root)).withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END".format
#: The nodes of all levels over ``{leaves}`` (g, pos, hash): a level's nodes of a tree are ``n``, and the last one has one.
_LEVELS = """(SELECT g, 0 AS level, pos, hash, CAST(count(*) OVER (PARTITION BY g) AS BIGINT) AS n FROM {leaves}
 UNION ALL SELECT g, level + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 16, n)"""
#: Each leaf's siblings by level, from a node's number at that level.
_STEPS = """SELECT b.{key}, s.level, coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos < b.pos // pow(16, s.level)::BIGINT), '') AS l, coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos > b.pos // pow(16, s.level)::BIGINT), '') AS r
 FROM {leaves} b JOIN {nodes} s ON s.g = b.g AND s.n > 1 AND s.pos // 16 = b.pos // pow(16, s.level + 1)::BIGINT GROUP BY b.{key}, s.level"""
#: ``report`` of documents with a doc_id each, once, in SQL.
ORACLE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({' || '.join(_FIELD(f) for f in FIELDS)}) AS leaf, sha256({' || '.join(_FIELD(f if f != 'text' else f"translate(text, '{UPPER}', '{LOWER}')") for f in FIELDS)}) AS lower FROM documents),
 k AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295::BIGINT AS c FROM d
  UNION ALL SELECT doc_id, s, k + 1, xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(s, k // 8 + 1, 1))) ELSE c END AS x FROM k WHERE k < 8 * length(s))),
 b AS MATERIALIZED (SELECT d.doc_id, g, leaf AS hash, leaf, CASE WHEN xor(c, 4294967295) % 5 = 0 THEN lower ELSE leaf END AS now, row_number() OVER (PARTITION BY g ORDER BY d.doc_id) - 1 AS pos FROM d JOIN k ON k.doc_id = d.doc_id AND k.k = 8 * length(s)),
 n AS {_LEVELS.format(leaves='b', name='n')},
 u AS MATERIALIZED (SELECT '' AS g, g AS source, hash, row_number() OVER (ORDER BY g) - 1 AS pos FROM n WHERE n.n = 1),
 m AS {_LEVELS.format(leaves='u', name='m')},
 p AS MATERIALIZED (SELECT doc_id, level, l, r FROM ({_STEPS.format(key='doc_id', leaves='b', nodes='n')}) UNION ALL SELECT b.doc_id, 1000 + q.level, q.l, q.r FROM b JOIN ({_STEPS.format(key='source', leaves='u', nodes='m')}) q ON q.source = b.g),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM p),
 f AS (SELECT doc_id, 0 AS step, now AS h FROM b UNION ALL SELECT f.doc_id, f.step + 1, sha256(o.l || f.h || o.r) FROM f JOIN (SELECT * FROM o) o ON o.doc_id = f.doc_id AND o.step = f.step + 1),
 e AS (SELECT b.doc_id, b.leaf, u.hash AS subroot, (SELECT hash FROM m WHERE n = 1) AS root, sha256(coalesce((SELECT string_agg(l || r, '' ORDER BY step) FROM o WHERE o.doc_id = b.doc_id), '')) AS proof_sha256, (SELECT arg_max(h, step) FROM f WHERE f.doc_id = b.doc_id) AS folded_root FROM b JOIN u ON u.source = b.g)
SELECT *, folded_root = root AS verified FROM e"""
