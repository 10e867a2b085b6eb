"""Counts, scores and decisions over choices: the statistics of evaluation and of the frame models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.corpus import global_index


def _ratio(a, b):
    return F.round(F.when(b != 0, a / b), 6)


def choice_metrics(per_case: DataFrame) -> DataFrame:
    """Accuracy, precision and precision on ambiguous cases (O-66) of partial counts ``n``, ``not_none``, ``correct``, ``easy``;
    easy choices all count as right in the last one."""
    total, chosen, right, easy = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "not_none", "correct", "easy"))
    return per_case.agg(
        total.alias("total"), chosen.alias("not_none"), right.alias("correct"), easy.alias("easy"),
        _ratio(right, total).alias("accuracy"), _ratio(right, chosen).alias("precision"), _ratio(right - easy, chosen - easy).alias("ambiguous_precision"),
    )


def label_scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Precision and recall of labels, with null or ``_`` as the negative class (O-67)."""
    p, g = (F.coalesce(c, F.lit("_")) for c in (predicted, gold))
    n_p, n_g, hit = F.count_if(p != "_"), F.count_if(g != "_"), F.count_if((p == g) & (g != "_"))
    return df.agg(n_p.alias("predicted"), n_g.alias("gold"), hit.alias("correct"), _ratio(hit, n_p).alias("precision"), _ratio(hit, n_g).alias("recall"))


def assignment_scores(df: DataFrame) -> DataFrame:
    """Share of right arguments and of sentences with only right ones (O-68), from rows (sent_id, ok)."""
    per = df.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("right"), F.bool_and("ok").alias("all_right"))
    return per.agg(F.sum("n").alias("n_args"), F.sum("right").alias("correct"), _ratio(F.sum("right"), F.sum("n")).alias("accuracy"), F.round(F.avg(F.col("all_right").cast("int")), 6).alias("sentence_accuracy"))


def error_shares(df: DataFrame, key: str, ok: str, above: int) -> DataFrame:
    """Errors per key and their share in all errors, for keys with more than ``above`` rows (O-70)."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.sum(ok)).alias("errors"))
    total = per.agg(F.sum("errors")).scalar()
    return per.where(F.col("n") > above).select(key, "n", "errors", _ratio(F.col("errors"), total).alias("error_share"))


def percentile_rows(df: DataFrame, group: str, value: str, percents: Iterable[int]) -> DataFrame:
    """(group, p, bound): of the group's sorted distinct values the one at place ``n * p / 100``, from 0 (O-77, O-78).

    Values are numbered over range partitions of (group, value), so a group of any size is ranked by many tasks; a value's place in its group is its number less that of
    the group's first. A null group is a group; null values don't count."""
    distinct = df.where(F.col(value).isNotNull()).select(F.col(group).alias("__group"), F.col(value).alias("__value")).distinct()
    ranked = global_index(distinct, ["__group", "__value"], "__at")
    sizes = ranked.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    places = sizes.select(F.col("__group").alias("__g"), F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("p"), "__n", "__first").withColumn("__place", F.col("__first") + F.floor(F.col("__n") * F.col("p") / 100))
    return places.join(ranked.select("__at", "__value"), F.col("__place") == F.col("__at")).select(F.col("__g").alias(group), "p", F.col("__value").alias("bound"))


def percentile_bounds(df: DataFrame, group: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """One row per group with the bounds as columns ``p5``, ``p95`` and so on."""
    rows = percentile_rows(df, group, value, percents)
    return rows.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("bound"))).alias(f"p{p}") for p in percents])


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key in long form (key, i, mean) (O-79)."""
    return df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("mean"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine of two array columns; 0 where one has no length (O-134)."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def cosine_to_centroid(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """Similarity of every vector to its own group's centroid (O-79, O-134)."""
    mean = centroids(df, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("__mean"))
    return df.select(key, group, F.col(vector).cast("array<double>").alias("__v")).join(mean, group).select(key, group, cosine(F.col("__v"), F.col("__mean")).alias("cosine"))


def bayes_posterior(df: DataFrame, label: str, feature: str, smoothing: float = 0.1) -> DataFrame:
    """Naive Bayes posterior of each label seen with a feature, normalised over these (O-132, the corrected formula)."""
    joint = df.where(F.col(label).isNotNull() & F.col(feature).isNotNull()).groupBy(feature, label).agg(F.count(F.lit(1)).alias("c"))
    prior = joint.groupBy(label).agg(F.sum("c").alias("n"))
    features = joint.agg(F.countDistinct(feature)).scalar()
    total, labels = prior.agg(F.sum("n")).scalar(), prior.agg(F.count(F.lit(1))).scalar()
    lam = F.lit(smoothing)
    scored = joint.join(prior, label).withColumn("s", F.log((F.col("n") + lam) / (total + lam * labels)) + F.log((F.col("c") + lam) / (F.col("n") + lam * features)))
    per = scored.groupBy(feature).agg(F.max("s").alias("m"))
    shifted = scored.join(per, feature).withColumn("e", F.exp(F.col("s") - F.col("m")))
    total = shifted.groupBy(feature).agg(F.sum("e").alias("z"))
    return shifted.join(total, feature).select(feature, label, (F.col("e") / F.col("z")).alias("posterior"))


def decide_by_gap(df: DataFrame, group: str, pick: str, score: str, gap: float, ratio: float) -> DataFrame:
    """The best of each group if it leads the second by more than ``gap`` or ``ratio``; a single one has a second of -1 (O-122)."""
    best = Window.partitionBy(group).orderBy(F.desc(score), pick)
    x = df.withColumn("__r", F.row_number().over(best)).withColumn("__second", F.coalesce(F.lead(score).over(best), F.lit(-1.0)))
    return x.where((F.col("__r") == 1) & ((F.col(score) - F.col("__second") > gap) | (F.col(score) / F.col("__second") > ratio))).drop("__r", "__second")


def selectional_association(df: DataFrame, predicate: str, slot: str, head: str) -> DataFrame:
    """Association of a head with a predicate's slot, after Resnik 1996: p(h|v) ln(p(h|v) / p(h)) within the slot (O-124)."""
    c = df.where(F.col(head).isNotNull()).groupBy(predicate, slot, head).agg(F.count(F.lit(1)).alias("n"))
    by_pred = c.groupBy(predicate, slot).agg(F.sum("n").alias("n_ps"))
    by_head = c.groupBy(slot, head).agg(F.sum("n").alias("n_h"))
    by_slot = by_head.groupBy(slot).agg(F.sum("n_h").alias("n_s"))
    joined = c.join(by_pred, [predicate, slot]).join(by_head, [slot, head]).join(by_slot, slot)
    given = F.col("n") / F.col("n_ps")
    return joined.select(predicate, slot, head, (given * F.log(given / (F.col("n_h") / F.col("n_s")))).alias("association"))
