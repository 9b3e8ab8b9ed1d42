"""Vector bin packing of documents into shards of near equal bytes, tokens and rows.

Groups of equal texts stay together. Small groups are hashed into a fixed
number of buckets; a group of more than ``1 / SPLIT`` of a shard is cut in
pieces by the number of the row as written. What
comes to the driver is one vector per bucket and piece, at most
``BUCKETS`` and a few hundred whatever the corpus holds; each is placed, large ones first, where
the dot product of its vector with the residual capacity is highest. Slots are
the item's first slot plus the row's number in the item, so no shard passes
through one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.shared import materialize

SHARDS, BUCKETS, SPLIT = 24, 4096, 8
DIMENSIONS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector; ties go to the lower shard."""
    share = vectors / np.maximum(vectors.sum(0), 1)
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    out = np.zeros(len(vectors), np.int64)
    for k in np.argsort(-share.max(1), kind="stable"):
        out[k] = int(np.argmax(residual @ share[k]))
        residual[out[k]] -= share[k]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS, split: int = SPLIT) -> DataFrame:
    """doc_id, size, text_crc32, law ``bytes``, shard, slot, grown_shard.

    A null text has no bytes; empty texts have size 8; repeated rows each take
    a slot; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = materialize(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("rid")), "sizes")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = slim.agg(*sums).first()
    if not total["rows"]:
        total = {"size": 1, "tokens": 1, "rows": 1}
    share = F.greatest(*[F.col(x) / F.lit(float(total[x] or 1)) for x in DIMENSIONS])
    heavy = slim.groupBy("group").agg(*sums).select("group", F.ceil(share * shards * split).cast("int").alias("pieces")).where("pieces > 1")  # no more than 3 * shards * split rows
    keyed = slim.join(F.broadcast(heavy), "group", "left")
    keyed = keyed.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("pieces"))).otherwise(-1).cast("int"))
    keyed = keyed.withColumn("item", F.when(F.col("pieces").isNotNull(), F.col("group")).otherwise(F.pmod("group", F.lit(buckets)))).drop("pieces", "group")
    items = keyed.groupBy("item", "piece").agg(*sums).collect()
    items.sort(key=lambda r: (r["piece"], r["item"]))
    at = place(np.array([[r[x] for x in DIMENSIONS] for r in items], float).reshape(-1, 3), shards)
    first, placed = [0] * shards, []
    for r, k in zip(items, at.tolist()):
        placed.append((r["item"], r["piece"], k, first[k]))
        first[k] += r["rows"]
    table = F.broadcast(spark.createDataFrame(placed, "item long, piece int, shard int, first long"))
    row = F.row_number().over(Window.partitionBy("item", "piece").orderBy("doc_id", "size", "text_crc32")) - 1
    found = keyed.withColumn("row", row).join(table, ["item", "piece"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
