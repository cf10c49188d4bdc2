"""Proportional stratified interleaving of rows into shards, with DataFrame functions only.

Rows are ordered within their stratum by a seeded digest of their key; the row
of rank r among the n of a stratum gets the fractional rank (r - 1/2) / n. In
the order of fractional ranks every stretch holds each stratum in proportion,
so cutting it into equal stretches gives shards that all match the mixture.

Rows of one group, equal texts say, get one digest, so they follow each other
within their stratum and lie at about one fraction in all strata: they share a
shard unless a cut falls between them, which equal counts can't rule out.

No rank is taken over a whole stratum or over the whole table by one task. The
digest is uniform, so its leading bits deal a stratum out to buckets, and the
fractional ranks are uniform, so their leading part deals the table out again;
a rank is the count of rows in earlier buckets plus the rank in one's own. A
group that would fill a bucket by itself is cut by the digests of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.llm._store import shuffle_width

#: Rows that one bucket holds on average; more rows give more buckets, and there are at least twice as many as shuffle partitions.
BUCKET_ROWS = 20_000
_DIGITS = 7


def _prefix_ranks(df: DataFrame, strata: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """``out``: a row's 0-based rank within ``strata`` by bucket, then by order; ``out``_of: the stratum's rows.

    Buckets of a stratum are added up by one task, which has a row for each: one for BUCKET_ROWS rows of the table.
    """
    keys = [*strata, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sh_n"))
    whole = Window.partitionBy(*strata)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        *keys,
        F.coalesce(F.sum("__sh_n").over(earlier), F.lit(0)).alias("__sh_base"),
        F.sum("__sh_n").over(whole).alias(f"{out}_of"),
    )
    inner = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(inner).cast("long") - 1)
    return ranked.join(base, keys).withColumn(out, F.col(out) + F.col("__sh_base")).drop("__sh_base")


def _digest(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def _stretch(digest: str, parts: Column) -> Column:
    """Which of so many equal stretches a digest falls into."""
    return F.floor(F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") * parts / F.lit(16**_DIGITS))


def _within_groups(rows: DataFrame) -> DataFrame:
    """Buckets in the order of group and key, in which a group over BUCKET_ROWS has buckets of its own by its keys' digests."""
    large = rows.groupBy("__sh_s", "__sh_b", "__sh_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS)
    by = large.groupBy("__sh_s", "__sh_b").agg(F.collect_list(F.struct(F.col("__sh_g").alias("g"), "n")).alias("__sh_h"))
    near = rows.join(by, ["__sh_s", "__sh_b"], "left")
    # Large groups before one's own, whether one's own is large, and the stretch of its keys: in the order of group and key.
    before = F.coalesce(F.size(F.filter("__sh_h", lambda x: x["g"] < F.col("__sh_g"))), F.lit(0))
    own = F.filter("__sh_h", lambda x: x["g"] == F.col("__sh_g"))
    large_own = F.coalesce(F.size(own) > 0, F.lit(False))
    part = F.when(large_own, _stretch("__sh_d", F.ceil(F.try_element_at(own, F.lit(1))["n"] / BUCKET_ROWS))).otherwise(F.lit(0))
    bucket = F.struct(F.col("__sh_b").alias("b"), F.when(F.col("__sh_h").isNull(), F.lit(0)).otherwise(before).alias("before"), large_own.alias("large"), part.cast("long").alias("part"))
    return near.withColumn("__sh_b", bucket).drop("__sh_h")


def shard(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    stratum: str = "source",
    seed: int = 17,
    columns: tuple[str, str] = ("shard", "slot"),
    group: str | None = None,
) -> DataFrame:
    """Adds the shard (0 to ``shards`` - 1) and the slot in it (gapless from 0).

    Shard sizes differ by one row at most, and in every shard the rows of each
    stratum differ from its exact share by less than two. Rows alike in ``group`` are kept together as far as that allows;
    nulls there are alike. The result depends on the rows
    alone, not on partitions. Nulls: a null stratum is a stratum of its own, a
    null key sorts as the text "null". Texts aren't read, however long. Rows that tie in key are ordered by the
    rest of the row's hash; rows equal in all columns are interchangeable. An
    empty table stays empty. Columns named as the added ones are replaced; a
    row's other columns, text included, travel with it, so project first if
    they are not needed.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    out_shard, out_slot = columns
    df = df.drop(*[c for c in columns if c not in (key, stratum)])
    total = df.count()
    buckets = max(2 * shuffle_width(df.sparkSession), -(-total // BUCKET_ROWS))
    digest = _digest(key, seed)
    rest = F.xxhash64(*[F.col(c) for c in df.columns if not df.schema[c].dataType.typeName().startswith(("map", "variant"))])
    rows = df.select(
        "*",
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-")).alias("__sh_s"),
        digest.alias("__sh_d"),
        (_digest(group, seed) if group else F.lit("")).alias("__sh_g"),
        rest.alias("__sh_t"),
    )
    rows = rows.withColumn("__sh_b", _stretch("__sh_g" if group else "__sh_d", F.lit(buckets)))
    if group:
        rows = _within_groups(rows)
    ranked = _prefix_ranks(rows, ["__sh_s"], "__sh_b", [F.col(c) for c in ("__sh_g", "__sh_d", "__sh_t")], "__sh_rank")
    fraction = (2 * F.col("__sh_rank") + 1) / (2 * F.col("__sh_rank_of")).cast("double")
    ranked = ranked.withColumn("__sh_f", fraction)
    ranked = ranked.withColumn("__sh_fb", F.floor(F.col("__sh_f") * buckets))
    placed = _prefix_ranks(ranked, [], "__sh_fb", [F.col(c) for c in ("__sh_f", "__sh_s", "__sh_d", "__sh_t")], "__sh_pos")
    # The cut before shard k stands at floor(k * total / shards).
    number = f"((__sh_pos * {shards} + {shards - 1}) div {max(total, 1)})"
    return placed.select(
        *[c for c in df.columns if c not in columns],
        F.expr(number).cast("int").alias(out_shard),
        F.expr(f"__sh_pos - ({number} * {total}) div {shards}").alias(out_slot),
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Writes one folder of Parquet files for each shard, rows in order of their slots."""
    width = df.select(F.countDistinct(shard)).first()[0] or 1
    placed = df.repartitionByRange(max(width, 1), shard, slot).sortWithinPartitions(shard, slot)
    placed.write.mode("overwrite").partitionBy(shard).parquet(path)
