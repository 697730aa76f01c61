"""Dense 0-based positions within a key, without gathering a key in one task.

A key may hold a third of all rows, so no window runs over a whole key. Rows are
cut into buckets that follow the wanted order (a hash prefix, or a range of row
ids); ``row_number`` runs inside a bucket, and each bucket adds the number of rows
in the buckets before it. Both sides of that last join are spread by bucket, and
the large side is already partitioned that way by the window. Where only some positions
are wanted, ``RankDirectory`` finds their rows and ranks no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from qaloom.functions.hashing import stable_hash
from qaloom.lineage import scratch_path, written, written_side

# Four hex digits: 65,536 buckets per key, hence at most 65,536 bucket counts in
# one running sum, and 1e12 rows of one key make buckets of 15 million narrow rows.
HASH_PREFIX = 4
_NULL_KEY = "\u0001missing"


def hash_index(
    df: DataFrame,
    key: str,
    row_id: str,
    seed: int | str,
    skip_first: bool = False,
    carry: list[str] | None = None,
    key_order: bool = False,
) -> DataFrame:
    """Position of every row in its key's hash order.

    Returns ``key, row_id, carry.., idx, pool_n, is_first``; ``pool_n`` is the number
    of rows of the key that have a position. With ``skip_first`` the key's row with
    the lowest id gets no position (``idx`` NULL). ``key_order`` adds ``key_start``,
    the number of rows in the keys that appear earlier (by lowest row id).
    """
    digest = stable_hash(F.col(row_id), seed)
    rows = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit(_NULL_KEY)).alias("_key"),
        F.col(row_id).alias("_id"),
        *[F.col(c) for c in (carry or [])],
        digest.alias("_hash"),
        F.substring(digest, 1, HASH_PREFIX).alias("_bucket"),
    )
    inside = Window.partitionBy("_key", "_bucket").orderBy("_hash", "_id")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    placed = ranked.join(_hash_offsets(rows, key_order), ["_key", "_bucket"])

    is_first = F.col("_id") == F.col("_low")
    position = F.col("_before") + F.col("_rank")
    total = F.col("_total")
    if skip_first:
        low_hash = stable_hash(F.col("_low"), seed)
        after_first = (F.col("_hash") > low_hash) | (
            (F.col("_hash") == low_hash) & (F.col("_id") > F.col("_low"))
        )
        position = F.when(~is_first, position - after_first.cast("bigint"))
        total = total - 1
    return placed.select(
        F.nullif(F.col("_key"), F.lit(_NULL_KEY)).cast(df.schema[key].dataType).alias(key),
        F.col("_id").alias(row_id),
        *[F.col(c) for c in (carry or [])],
        position.alias("idx"),
        total.alias("pool_n"),
        is_first.alias("is_first"),
        *([F.col("_start").alias("key_start")] if key_order else []),
    )


def _hash_offsets(rows: DataFrame, key_order: bool) -> DataFrame:
    """Per (key, bucket): rows before it in the key, key total, lowest id of the key."""
    counts = rows.groupBy("_key", "_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("low")
    )
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.select(
        "_key",
        "_bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.sum("n").over(whole).alias("_total"),
        F.min("low").over(whole).alias("_low"),
    )
    if not key_order:
        return buckets
    # A running sum over keys, one row each.
    keys = counts.groupBy("_key").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    earlier = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.select(
        "_key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start")
    )
    return buckets.join(starts, "_key")


class RankDirectory:
    """Positions of a key's hash order, found without indexing the key's rows.

    The directory has one row per key and hash bucket: the rows in it and before it, which
    is all that a draw needs to know. It is counted in one pass with partial sums and
    written, so that every draw shares it. ``locate`` then ranks the rows of the buckets
    that were asked for and no others. Positions are those of ``hash_index``.
    """

    def __init__(self, df: DataFrame, key: str, row_id: str, seed: int | str, skip_first: bool = False):
        self.key, self.row_id = key, row_id
        digest = stable_hash(F.col(row_id), seed)
        self.kind = df.schema[key].dataType
        self.rows = df.select(
            F.coalesce(F.col(key).cast("string"), F.lit(_NULL_KEY)).alias("_key"),
            F.col(row_id).alias("_id"),
            digest.alias("_hash"),
            F.substring(digest, 1, HASH_PREFIX).alias("_bucket"),
        )
        counts = self.rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low"))
        whole = Window.partitionBy("_key")
        counts = counts.withColumn("_skipped", F.min("low").over(whole) if skip_first else F.lit(None).cast(df.schema[row_id].dataType))
        lost = F.coalesce(F.col("_bucket") == F.substring(stable_hash(F.col("_skipped"), seed), 1, HASH_PREFIX), F.lit(False))
        counts = counts.withColumn("n", F.col("n") - lost.cast("bigint"))
        before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.table = written(
            counts.select(
                "_key",
                "_bucket",
                "n",
                "_skipped",
                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
                F.sum("n").over(whole).alias("_total"),
            ),
            "rank-directory",
        )

    def sizes(self) -> DataFrame:
        """``key, pool_n`` of every key."""
        return self.table.groupBy("_key").agg(F.max("_total").alias("pool_n")).select(self._named(F.col("_key")), "pool_n")

    def _named(self, column):
        return F.nullif(column, F.lit(_NULL_KEY)).cast(self.kind).alias(self.key)

    def locate(self, positions: DataFrame) -> DataFrame:
        """``positions`` (the key, ``idx`` and what else they have) with the id of the row there.

        A position beyond the key's rows gives nothing. Buckets hold about as many rows
        each, so a position's bucket is met through a grid of as many cells as buckets.
        """
        cells = 16**HASH_PREFIX
        width = F.expr(f"greatest(1, (_total + {cells - 1}) div {cells})")
        filled = self.table.where("n > 0").withColumn("_width", width)
        grid = filled.withColumn("_cell", F.explode(F.expr("sequence(_before div _width, (_before + n - 1) div _width)")))
        asked = positions.withColumn("_key", F.coalesce(F.col(self.key).cast("string"), F.lit(_NULL_KEY)))
        widths = F.broadcast(filled.groupBy("_key").agg(F.max("_width").alias("_w")))  # one row per key
        asked = asked.join(widths, "_key").withColumn("_cell", F.expr("idx div _w")).drop("_w")
        met = asked.join(grid, ["_key", "_cell"]).where("idx >= _before and idx < _before + n")
        met = met.select(*positions.columns, "_key", "_bucket", "_skipped", (F.col("idx") - F.col("_before")).alias("_rank"))
        met = written(met, "rank-positions")
        buckets = written_side(met.select("_key", "_bucket", "_skipped").distinct(), "rank-buckets")
        drawn = self.rows.join(buckets, ["_key", "_bucket"]).where("_skipped is null or _id <> _skipped")
        inside = Window.partitionBy("_key", "_bucket").orderBy("_hash", "_id")
        ranked = drawn.withColumn("_rank", (F.row_number().over(inside) - 1).cast("bigint")).select("_key", "_bucket", "_rank", "_id")
        return met.join(ranked, ["_key", "_bucket", "_rank"]).select(*positions.columns, F.col("_id").alias(self.row_id))


class StoredIndex:
    """``hash_index`` laid out once as a bucketed table, for every operator that draws from it.

    The table is bucketed and sorted by key and position, so a join on those moves the
    draws only. It has one narrow row per row of ``df``; rows without a position have none.
    ``locate`` and ``sizes`` are those of ``RankDirectory``.
    """

    def __init__(
        self,
        df: DataFrame,
        key: str,
        row_id: str,
        seed: int | str,
        skip_first: bool = False,
        buckets: int | None = None,
        path: str | None = None,
    ):
        spark = df.sparkSession
        self.key, self.row_id, self.kind = key, row_id, df.schema[key].dataType
        indexed = hash_index(df, key, row_id, seed, skip_first)
        rows = indexed.select(F.coalesce(F.col(key).cast("string"), F.lit(_NULL_KEY)).alias("_key"), "idx", F.col(row_id).alias("_id"), "pool_n")
        self.name = f"qaloom_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer = rows.repartition(self.buckets, "_key", "idx").write.option("path", path or scratch_path(spark, "stored-index"))
        writer.bucketBy(self.buckets, "_key", "idx").sortBy("_key", "idx").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def key_column(self, column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(_NULL_KEY))

    def rows(self) -> DataFrame:
        """``key, row_id, idx, pool_n``."""
        named = F.nullif(F.col("_key"), F.lit(_NULL_KEY)).cast(self.kind).alias(self.key)
        return self.table.select(named, F.col("_id").alias(self.row_id), "idx", "pool_n")

    def sizes(self) -> DataFrame:
        return self.rows().groupBy(self.key).agg(F.max("pool_n").alias("pool_n"))

    def locate(self, positions: DataFrame) -> DataFrame:
        asked = positions.withColumn("_key", self.key_column(F.col(self.key)))
        return asked.join(self.table.drop("pool_n"), ["_key", "idx"]).select(*positions.columns, F.col("_id").alias(self.row_id))


def range_index(df: DataFrame, row_id: str, width: int | None = None) -> DataFrame:
    """All columns plus ``position``: 0-based rank by a unique id, dense or sparse.

    Only the ids are ranged and written, so that counting and ranking see the same ranges.
    The ranges follow a sample of the ids, so they hold about as many rows each whatever
    the ids look like; one row per range reaches the running sum. ``width`` asks for about
    so many rows in a range; by default the session's shuffle partitions decide.
    """
    ids = df.select(F.col(row_id).alias("_id"))
    ranged = ids.repartitionByRange("_id") if width is None else ids.repartitionByRange(-(-ids.count() // width) or 1, "_id")
    ids = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ids.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_id")) - 1
    placed = ids.withColumn("_rank", rank).join(offsets, "_range")
    positions = placed.select("_id", (F.col("_before") + F.col("_rank")).alias("position"))
    return df.join(positions, df[row_id] == positions["_id"]).select(*[df[c] for c in df.columns], "position")
