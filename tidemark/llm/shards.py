"""Sharding by proportional stratified interleaving (operator 3).

Rows of each stratum (source) are put in a seeded random order; a row's fractional rank is
(rank + jitter of its stratum) / size of the stratum. Sorted by fractional rank, every
stretch of rows holds each stratum in proportion, so cutting the order into equal
stretches gives shards that all match the mixture, with row counts at most one apart.

Nothing is ranked in one task: a stratum's seeded hash is uniform, so its leading bits cut
the stratum into even buckets, and the fractional rank is uniform, so equal slices of it
are even as well. Ranks are the running totals of those bucket counts plus a window
inside each bucket, however large one stratum is. Texts never move.

Defined cases: null text has size 1 and CRC 0; null source is a stratum of its own; null
or repeated doc_id are ranked like others (ties by CRC and size; equal rows are
interchangeable); an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut

ROWS_A_BUCKET = 256
MOST_BUCKETS = 1 << 16
BLOCK = 1 << 10


def _offsets(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows before each bucket within its keys: running totals in two levels of at most 256 buckets a task."""
    hi = F.shiftright(F.col(order), 8)
    counts = counts.withColumn("_hi", hi)
    coarse = counts.groupBy(*keys, "_hi").agg(F.sum("n").alias("_m"))
    over = Window.partitionBy(*keys).orderBy("_hi").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_before", F.coalesce(F.sum("_m").over(over), F.lit(0)))
    fine = Window.partitionBy(*keys, "_hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("n").over(fine), F.lit(0)))
    return counts.join(coarse.drop("_m"), [*keys, "_hi"]).select(*keys, order, (F.col("_before") + F.col("_in")).alias("before"))


def interleave(rows: DataFrame, n_shards: int, stratum: str, key: str, ties: list[str], seed: int = 17) -> DataFrame:
    """Adds shard (int) and slot (long) to ``rows``; ``stratum`` must hold no nulls. Equal rows are one
    row with a count until they are placed, so that very many of them don't meet in one bucket."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_c"))
    total = rows.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(1, total // ROWS_A_BUCKET))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key), *[F.col(t) for t in ties]))
    # the upper 52 bits as a fraction of 1
    unit = (F.shiftrightunsigned(F.col("_h"), 12) / F.lit(float(1 << 52))).cast("double")
    rows = rows.withColumn("_b", F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int"))
    counts = rows.groupBy(stratum, "_b").agg(F.sum("_c").alias("n"))
    sizes = counts.groupBy(stratum).agg(F.sum("n").alias("_size"))
    before = _offsets(counts, [stratum], "_b").join(sizes, stratum)
    in_bucket = Window.partitionBy(stratum, "_b").orderBy(F.shiftrightunsigned(F.col("_h"), 12), key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_i", F.sum("_c").over(in_bucket) - F.col("_c")).join(before, [stratum, "_b"])
    # the copies of a row, in blocks, so that no array grows with them
    ranked = ranked.withColumn("_k", F.explode(F.expr(f"sequence(0L, (_c - 1) div {BLOCK})"))).withColumn("_k", F.col("_k") * BLOCK)
    ranked = ranked.withColumn("_k", F.explode(F.expr(f"sequence(_k, least(_k + {BLOCK}, _c) - 1)"))).withColumn("_i", F.col("_i") + F.col("_k")).drop("_k", "_c")
    jitter = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col(stratum)), 12) / F.lit(float(1 << 52))
    ranked = ranked.withColumn("_f", (F.col("before") + F.col("_i") + jitter) / F.col("_size"))
    ranked = ranked.withColumn("_g", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int")).drop("before", "_size", "_i", "_b")
    ranked = cut(ranked)
    slices = ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    start = _offsets(slices, ["_all"], "_g").drop("_all")
    over = Window.partitionBy("_g").orderBy("_f", stratum, key, *ties)
    at = F.col("before") + F.row_number().over(over) - 1
    placed = ranked.join(start, "_g").withColumn("_at", at)
    # integer arithmetic: no rounding
    shard = F.expr(f"(_at * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"((_at * {n_shards}) div {max(total, 1)} * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long")).drop("_h", "_f", "_g", "before", "_at")


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every document."""
    d = columns(docs, "doc_id", "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = d.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(d, n_shards, "stratum", "doc_id", ["text_crc32", "size"], seed)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17) -> None:
    """Writes whole rows as Parquet under path/shard=k, in slot order inside each file; a column shard or slot is an error."""
    if clash := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are outputs")
    names = docs.columns
    placed = shard_documents(docs, n_shards, seed).select("doc_id", "text_crc32", "shard", "slot")
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = {c: f"_{names.index(c)}" for c in ("doc_id", "text")}
    whole = plain.withColumn("crc", F.crc32(F.coalesce(F.col(at["text"]), F.lit("")).cast("binary")))
    placed = placed.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("slot")))
    whole = whole.withColumn("k", F.row_number().over(Window.partitionBy(at["doc_id"], "crc").orderBy(F.lit(0))))
    on = whole[at["doc_id"]].eqNullSafe(placed["doc_id"]) & (whole["crc"] == placed["text_crc32"]) & (whole["k"] == placed["k"])
    out = whole.join(placed, on).select(*[whole[f"_{i}"].alias(c) for i, c in enumerate(names)], placed["shard"], placed["slot"])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_stratified_shards(spark, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard counts at most one apart."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("stratum"))
