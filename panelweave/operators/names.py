"""Names matched by edit distance within a block: the best candidate of every name, all pairs counted.

Names that begin alike share the rows and columns of their distance tables:
what a table says of two beginnings is worked out once for all names that have
them. Names are cut in cells of neighbours in alphabetical order, and each pair
of cells of a block meets in one task, which gives for every name the nearest
one of each kind and length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.core import ship
from panelweave.sources.files import written

#: Names of a cell, how many of the left one have their tables in memory at a time, and the most tasks that pairs of cells are dealt to.
CELL, PART, TASKS = 1 << 13, 1 << 10, 1 << 10
FOUND = "block long, name string, kind int, size int, other string, other_key long, edits int"


def tree(names: Sequence[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The distinct beginnings of each length, as (place of the one a character shorter, last character); each name's length and its place among those of its length."""
    codes = [np.frombuffer(n.encode("utf-32-le", "surrogatepass"), "<u4") for n in names]
    size = np.array([len(c) for c in codes], np.int64)
    at, levels = np.zeros(len(names), np.int64), []
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        both, at[rows] = np.unique((at[rows] << 32) | np.array([codes[r][k] for r in rows], np.int64), return_inverse=True)
        levels.append((both >> 32, both & 0xFFFFFFFF))
    return levels, size, at


def tables(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """For each length of left beginnings, 0 at first, the edit distances to right beginnings, a table for each length of those."""
    kind = np.uint8 if len(left) + len(right) < 255 else np.uint32
    narrow = np.uint8 if all(c.max(initial=0) < 256 for _, c in (*left, *right)) else np.uint32
    left, right = ([(p, c.astype(narrow)) for p, c in side] for side in (left, right))
    last = [np.full((1, 1), 0, kind), *(np.full((1, len(p)), j + 1, kind) for j, (p, _) in enumerate(right))]
    shorter = [last[j].take(p, 1) for j, (p, _) in enumerate(right)]  # the tables without the right beginnings' last character
    yield last
    for i, (parent, char) in enumerate(left):
        now, longer = [np.full((len(parent), 1), i + 1, kind)], []
        for j, (before, other) in enumerate(right):
            changed = shorter[j].take(parent, 0)
            changed += char[:, None] != other
            longer.append(now[j].take(before, 1, mode="clip"))
            gap = np.minimum(last[j + 1].take(parent, 0), longer[j])
            gap += kind(1)
            now.append(np.minimum(changed, gap, out=gap))
        yield now
        last, shorter = now, longer


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left name the nearest right one of each kind and length, of equal ones that with the least key."""
    names, others = sorted(left["name"].to_pylist()), right["other"].to_pylist()
    kinds, keys = right["kind"].to_numpy(), np.array([np.iinfo(np.int64).max if k is None else k for k in right["other_key"].to_pylist()], np.int64)
    levels, size, leaf = tree(others)
    groups = [(n, rows[np.argsort(keys[rows], kind="stable")]) for n in np.unique(size).tolist() for k in np.unique(kinds) if len(rows := np.flatnonzero((size == n) & (kinds == k)))]
    out = []
    for start in range(0, len(names), PART):
        own = names[start : start + PART]
        own_levels, own_size, own_leaf = tree(own)
        for i, each in enumerate(tables(own_levels, levels)):
            rows = np.flatnonzero(own_size == i)
            for n, of in groups if len(rows) else ():
                far = each[n].take(own_leaf[rows], 0).take(leaf[of], 1, mode="clip")
                best = far.argmin(1)
                out.append((rows + start, of[best], far[np.arange(len(rows)), best]))
    row, other, edits = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))
    blocks = pa.array(np.full(len(row), left["block"][0].as_py() if left.num_rows else 0), pa.int64())
    taken = right.take(pa.array(other, pa.int64()))
    own = pa.array([names[r] for r in row], pa.string())
    return pa.table([blocks, own, taken["kind"], pa.array(size[other.astype(np.int64)], pa.int32()), taken["other"], taken["other_key"], pa.array(edits, pa.int32())], names=["block", "name", "kind", "size", "other", "other_key", "edits"])


def cells(names: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """The rows, written, with the number of their cell, and how many cells there are; a cell has neighbours in order of block and name."""
    names = written(names, label)
    count = max(1, -(-names.count() // CELL))
    return written(names.repartitionByRange(count, "block", name).withColumn(f"{label}_cell", F.spark_partition_id()), f"{label}-cells"), count


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """``block, name, other, other_key, edits``: for each row ``block, name`` the nearest rows ``block, other, kind, other_key``: of each kind and length the one with the least edit distance, then key. Without null names."""
    spark = left.sparkSession
    ship(spark)
    (left, m), (right, n) = cells(left, "name", "names"), cells(right, "other", "others")
    keys = ["block", "names_cell", "others_cell"]
    both = [x.select("block", c).distinct().toDF("block", c) for x, c in ((left, "names_cell"), (right, "others_cell"))]
    left, right = (x.join(F.broadcast(of), "block").repartition(min(m * n, TASKS), *keys) for x, of in ((left, both[1]), (right, both[0])))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest, FOUND)
    best = F.min(F.struct("edits", F.col("other_key").isNull().alias("keyless"), "other_key", "other")).alias("best")
    return found.groupBy("block", "name", "kind", "size").agg(best).select("block", "name", "best.other", "best.other_key", "best.edits")


def resolved(spark: SparkSession, supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """Each supplier's best customer of its country by key, name and balance, of equal ones that with the least key.

    Among customers whose balances have the same sign and whose names are
    equally long, the nearest name is best but for the customer with the
    supplier's key, which is a candidate of its own. Where a name is missing
    there is no score, and the least key is taken.
    """
    customers = customer.selectExpr("CAST(c_nationkey AS BIGINT) AS block", "c_name AS other", "c_custkey AS other_key", "c_acctbal > 0 AS other_up").where("block IS NOT NULL")
    suppliers = supplier.selectExpr("CAST(s_nationkey AS BIGINT) AS block", "s_name AS name", "s_suppkey", "s_acctbal > 0 AS up")
    kinds = customers.where("other IS NOT NULL").selectExpr("*", "CASE WHEN other_up THEN 2 WHEN NOT other_up THEN 1 ELSE 0 END AS kind").groupBy("block", "other", "kind").agg(F.min("other_key").alias("other_key"))
    names = suppliers.where("block IS NOT NULL AND name IS NOT NULL").select("block", "name").distinct()
    found = nearest(names, kinds)
    scored = """SELECT s_suppkey, other_key, CASE WHEN s_suppkey = other_key THEN 40 ELSE 0 END + 30 * (1 - edits / CAST(greatest(length(name), length(other)) AS DOUBLE)) + 15 + CASE WHEN up = other_up THEN 15 ELSE 0 END AS score"""
    near = f"{scored} FROM (SELECT s.s_suppkey, s.name, s.up, c.other, c.other_key, c.other_up, n.edits FROM {{s}} s JOIN {{n}} n ON n.block = s.block AND n.name = s.name JOIN {{c}} c ON c.block = n.block AND c.other = n.other AND c.other_key <=> n.other_key)"
    own = f"{scored} FROM (SELECT *, levenshtein(name, other) AS edits FROM {{s}} s JOIN {{c}} c ON s.block = c.block AND s.s_suppkey = c.other_key)"
    void = "SELECT s_suppkey, other_key, CAST(NULL AS DOUBLE) AS score FROM {s} s JOIN (SELECT block, other IS NULL AS unnamed, min(other_key) AS other_key FROM {c} GROUP BY block, other IS NULL) u ON u.block = s.block AND (s.name IS NULL OR unnamed)"
    best = "min(struct(score IS NULL AS no, -round(score, 6) AS worst, other_key IS NULL AS keyless, other_key, score))"
    text = f"WITH b AS ({near} UNION ALL {own} UNION ALL {void}), k AS (SELECT s_suppkey, {best} AS best FROM (SELECT /*+ REPARTITION(256, s_suppkey) */ * FROM b) GROUP BY s_suppkey) SELECT s_suppkey, best.other_key AS c_custkey, round(CAST(best.score AS DOUBLE) + 1e-7, 4) AS score, CAST(best.score >= 70 AS INT) AS accepted FROM k"
    return spark.sql(text, s=suppliers, n=found, c=customers)


#: Hashes of the name itself and, where one edit can be allowed, of the name without each of its characters, in their block.
SHORTER = "array_distinct(concat(array(xxhash64(block, {0})), CASE WHEN length({0}) > 5 THEN transform(sequence(1, length({0})), k -> xxhash64(block, concat(substring({0}, 1, k - 1), substring({0}, k + 1)))) ELSE array() END))"
SIMILARITY = "1 - edits / CAST(greatest(length(name), length(other)) AS DOUBLE)"


def matched(spark: SparkSession, customer: DataFrame) -> DataFrame:
    """Pairs of customers and others of one country that are each other's best match, with a similarity of 0.85 at least.

    Names within one edit have a shorter form in common, which pairs them
    without meeting all others. Fewer edits are always more similar, so only
    names without such a partner need all names of their country.
    """
    rows = customer.selectExpr("CAST(c_nationkey AS BIGINT) AS block", "c_custkey", "c_name AS name", "replace(c_name, '#', ' ') AS other").where("block IS NOT NULL AND name IS NOT NULL")
    rows = written(rows, "rows")
    a, b = (written(rows.groupBy("block", n).agg(F.min("c_custkey").alias(f"{n}_key")).withColumn(f"{n}_id", F.monotonically_increasing_id()), n) for n in ("name", "other"))
    forms = [x.select(f"{n}_id", F.explode(F.expr(SHORTER.format(n))).alias("form")) for x, n in ((a, "name"), (b, "other"))]
    pairs = forms[0].join(forms[1], "form").select("name_id", "other_id").distinct()
    close = pairs.join(a, "name_id").join(b, ["other_id", "block"]).withColumn("edits", F.expr("levenshtein(name, other, 1)")).where("edits >= 0")
    close = written(close.withColumn("similarity", F.expr(SIMILARITY)).where("similarity >= 0.85"), "close")
    sides = []
    for names, own, key, others, other, other_key in ((a, "name", "name_key", b, "other", "other_key"), (b, "other", "other_key", a, "name", "name_key")):
        found = close.select("block", F.col(own).alias("name"), F.col(other_key).alias("other_key"), "similarity")
        rest = written(names.join(close.select("block", own).distinct(), ["block", own], "left_anti").select("block", F.col(own).alias("name")).where("length(name) > 11"), "rest")
        if not rest.isEmpty():  # two edits and more
            far = nearest(rest, others.select("block", F.col(other).alias("other"), F.lit(0).alias("kind"), F.col(other_key).alias("other_key")))
            found = found.unionByName(far.withColumn("similarity", F.expr(SIMILARITY)).where("similarity >= 0.85").select(found.columns))
        sides.append(found.groupBy("block", "name").agg(F.min(F.struct((-F.round("similarity", 9)).alias("worst"), F.col("other_key").isNull().alias("keyless"), "other_key", "similarity")).alias("best")))
    p, q = (rows.selectExpr("block", "c_custkey", f"{x} AS name").join(side, ["block", "name"]).repartition(256, "c_custkey").groupBy("c_custkey").agg(F.min("best").alias("best")) for x, side in zip(("name", "other"), sides))
    p = p.selectExpr("c_custkey", "best.other_key AS other", "round(best.similarity + 1e-9, 6) AS similarity")
    q = q.selectExpr("c_custkey AS other_q", "best.other_key AS custkey_q")
    return p.join(q, F.col("other").eqNullSafe(F.col("other_q")) & F.col("c_custkey").eqNullSafe(F.col("custkey_q"))).select("c_custkey", "other", "similarity")
