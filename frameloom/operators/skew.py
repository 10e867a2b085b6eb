"""Per-key results where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.runtime import cut


def heavy_keys(df: DataFrame, key: str, heavy_share: float) -> dict[str, int]:
    """Salts per heavy key: every key with more than ``heavy_share`` of the rows, with so many salts that no
    (key, salt) keeps more than that share. At most ``1 / heavy_share`` keys reach the driver."""
    counts = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        return {}
    rows = counts.where((F.col("__n") > heavy_share * total) & F.col(key).isNotNull()).collect()
    return {r[key]: math.ceil(r["__n"] / (heavy_share * total)) for r in rows}


def salt_column(key: str, salts: dict[str, int], source: Column) -> Column:
    """0 for light keys; for a heavy key one of its salts, drawn by a hash of ``source`` so that a re-run task
    draws the same salt and copies of one record meet under one salt."""
    if not salts:
        return F.lit(0).cast("long")
    width = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
    return F.coalesce(F.pmod(F.xxhash64(source), F.element_at(width, F.col(key)).cast("long")), F.lit(0).cast("long"))


def salted_aggregate(df: DataFrame, key: str, record: str, value: str | None = None, heavy_share: float = 0.01, null_salts: int = 64) -> DataFrame:
    """Count the records of each key, and count, sum and average their values, without a task that holds one hot key.

    Copies of a record are merged first; stage one aggregates per (key, salt), stage two merges the few partial rows of each key. The result has the columns ``key``, ``n`` (distinct records),
    ``n_scored`` (those with a value), ``total`` (their sum) and ``mean`` (null where none has a value).

    Nulls: a null key is a group of its own (spread over ``null_salts``); rows with a null record count for
    nothing, as in ``count(distinct record)``. A record repeated under one key counts once, with its largest value;
    a record under two keys counts once under each. NaN values count as absent. An empty table gives no rows.
    Other columns are ignored.
    """
    scored = F.col(value).cast("double") if value else F.lit(None).cast("double")
    rows = df.where(F.col(record).isNotNull()).select(F.col(key).alias("key"), F.col(record).alias("record"), F.when(~F.isnan(scored), scored).alias("value"))
    salts = heavy_keys(rows, "key", heavy_share)
    salt = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("record"), F.lit(null_salts).cast("long"))).otherwise(salt_column("key", salts, F.col("record")))
    # all aggregations combine before they shuffle: copies of a record here, the records of a (key, salt) and the salts of a key below
    once = rows.withColumn("salt", salt).groupBy("key", "salt", "record").agg(F.max("value").alias("value"))
    partial = once.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_scored"), F.sum("value").alias("total"))
    merged = partial.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.sum("total").alias("total"))
    return merged.select(F.col("key").alias(key), "n", "n_scored", "total", F.when(F.col("n_scored") > 0, F.col("total") / F.col("n_scored")).alias("mean"))


def keys_with_share(df: DataFrame, key: str, record: str, least_share: float, heavy_share: float = 0.01) -> DataFrame:
    """Keys (not null) that hold at least ``least_share`` of all distinct records, null keys included in the total."""
    per_key = cut(salted_aggregate(df, key, record, heavy_share=heavy_share).select(key, "n"))
    total = per_key.agg(F.sum("n")).first()[0] or 0
    return per_key.where(F.col(key).isNotNull() & (F.col("n") >= least_share * total)).select(key, "n")
