"""Tokens, predicates and arguments of a corpus as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.runtime import cut


def tokens_once(tokens: DataFrame) -> DataFrame:
    """Tokens without repeated deliveries. The grouping key holds the whole token, so aggregation starts before the shuffle."""
    return tokens.select("sent_id", "word_no", "orth", "base", "ctag", F.nullif("argument_type", F.lit("")).alias("label"), "predicate_no").distinct()


def arguments(tokens: DataFrame) -> DataFrame:
    """Tokens that head an argument of a predicate (O-37); -1 for an argument without one (O-39)."""
    return tokens.where("label is not null").select("sent_id", "word_no", "base", "ctag", "label", F.coalesce("predicate_no", F.lit(-1)).alias("predicate_no"))


def occurrences(tokens: DataFrame) -> DataFrame:
    """One row per (sentence, predicate) with lemma, aspect and whether one of its arguments is ``sie`` (O-37, O-43)."""
    found = arguments(tokens).where("predicate_no >= 0").groupBy("sent_id", "predicate_no").agg(F.count(F.lit(1)).alias("n_args"), F.max(F.col("label") == "sie").alias("has_sie"))
    heads = tokens.select("sent_id", F.col("word_no").alias("predicate_no"), F.col("base").alias("predicate"), L.aspect_of(F.coalesce("ctag", F.lit(""))).alias("aspect"))
    return found.join(heads, ["sent_id", "predicate_no"])


def extended_arguments(tokens: DataFrame) -> DataFrame:
    """Arguments of each predicate and those others that stand between its two neighbouring predicates (O-38).

    The neighbours come from one window over a sentence's predicates; the arguments join on the sentence and the range.
    """
    args = arguments(tokens)
    order = Window.partitionBy("sent_id").orderBy("predicate_no")
    preds = args.where("predicate_no >= 0").select("sent_id", "predicate_no").distinct()
    bounds = preds.select("sent_id", F.col("predicate_no").alias("p"), F.coalesce(F.lag("predicate_no").over(order), F.lit(0)).alias("low"), F.lead("predicate_no").over(order).alias("high"))
    joined = bounds.join(args, "sent_id").where("predicate_no = p or (word_no >= low and (high is null or word_no <= high))")
    return joined.select("sent_id", F.col("p").alias("predicate_no"), "word_no", "label", (F.col("predicate_no") == F.col("p")).alias("own"))


def nearest_predicate(tokens: DataFrame) -> DataFrame:
    """The nearest predicate (a verb other than the token) of each labelled token, ties to the right (O-57, O-91), by two windows."""
    at = F.when(L.is_verb(F.col("ctag")), F.col("word_no"))
    order = Window.partitionBy("sent_id").orderBy("word_no")
    left = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(at, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = tokens.select("sent_id", "word_no", "label", left.alias("left"), right.alias("right"))
    near = F.when(F.col("left").isNull() | (F.col("right") - F.col("word_no") <= F.col("word_no") - F.col("left")), F.col("right")).otherwise(F.col("left"))
    return both.where("label is not null").select("sent_id", "word_no", "label", near.alias("nearest"))


def token_features(tokens: DataFrame) -> DataFrame:
    """Word-level feature columns (O-84, O-88): form, lemma, part of speech, case, aspect, and the case found again in the
    five tokens to the left."""
    order = Window.partitionBy("sent_id").orderBy("word_no")
    p = L.pos(F.col("ctag"))
    own = F.when(p == "prep", L.tag_part(F.col("ctag"), 1)).when(p == "subst", L.tag_part(F.col("ctag"), 2))
    marked = tokens.withColumn("own_case", own)
    lags = [F.lag("own_case", i).over(order) for i in range(1, 6)]
    near = F.greatest(*[F.coalesce(x == F.col("own_case"), F.lit(False)) for x in lags])
    return marked.select(
        "sent_id", "word_no", L.feature(F.col("orth")).alias("f_orth"), L.feature(F.col("base")).alias("f_base"), L.feature(p).alias("f_pos"),
        L.case_of(F.col("ctag")).alias("f_case"), L.aspect_feature(F.col("ctag")).alias("f_aspect"), F.when(near, F.col("own_case")).otherwise("_").alias("f_case_nearby"),
    )


def predicate_distance(tokens: DataFrame, name: str, kinds: tuple[str, ...]) -> DataFrame:
    """How many tokens of some parts of speech lie between an argument and its predicate, both included; ``far-away``
    beyond five (O-87). Prefix sums over the sentence turn the count into a difference of two looked-up numbers."""
    order = Window.partitionBy("sent_id").orderBy("word_no")
    hit = F.coalesce(L.pos(F.col("ctag")).isin(*kinds), F.lit(False)).cast("int")
    summed = tokens.select("sent_id", "word_no", "label", "predicate_no", hit.alias("hit"), F.sum(hit).over(order).alias("upto"))
    heads = summed.select("sent_id", F.col("word_no").alias("predicate_no"), F.col("upto").alias("p_upto"), F.col("hit").alias("p_hit"))
    joined = summed.where("label is not null").join(heads, ["sent_id", "predicate_no"])
    count = F.abs(F.col("upto") - F.col("p_upto")) + F.when(F.col("word_no") <= F.col("predicate_no"), F.col("hit")).otherwise(F.col("p_hit"))
    return joined.select("sent_id", "word_no", "predicate_no", F.when(count > 5, f"{name}-far-away").otherwise(F.concat(F.lit(name + "-"), count.cast("string"))).alias("distance"))


def global_index(df: DataFrame, order: list[str], index: str = "index") -> DataFrame:
    """Rows with their position (from 0) in a total order, without a single-task window: range partitions are numbered
    within, and the counts of the partitions before are added. ``order`` should leave no ties."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(total)]
        total += n
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    start = F.element_at(F.create_map(*starts), F.col("__part")) if starts else F.lit(0)
    return parts.withColumn(index, (start + within).cast("long")).drop("__part")


def folds(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Rows dealt to ``k`` folds in turn (O-73); the order may be a hash for a shuffle."""
    return global_index(df, order, "fold").withColumn("fold", (F.col("fold") % k).cast("int"))
