"""Valency frames: candidates of an occurrence, slot matching, frame swapping, and choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.runtime import cut, tidy


def frames_once(frames: DataFrame) -> DataFrame:
    """One row per frame with its text's body (after the fifth colon), whether it has a refl slot, and no ``{or}`` frames (O-47, O-55)."""
    body = F.trim(F.get(F.split("frame_text", ":", 6), F.lit(5)))
    has_refl = F.coalesce(F.exists("arguments", lambda a: F.exists(a["realizations"], lambda r: r == "refl")), F.lit(False))
    rows = frames.where(F.col("frame_id").isNotNull() & ~F.coalesce(F.contains("frame_text", F.lit("{or}")), F.lit(False)))
    picked = rows.select("frame_id", tidy(F.col("predicate")).alias("predicate"), F.coalesce("aspect", F.lit("_")).alias("aspect"), "frame_text", body.alias("body"), has_refl.alias("has_refl"), "arguments")
    return picked.dropDuplicates(["frame_id"])


def frame_slots(frames: DataFrame) -> DataFrame:
    """(frame_id, slot, realization): every realization of every slot; slots with the subj modifier and an np also ``subj``."""
    slots = frames.select("frame_id", F.posexplode("arguments").alias("slot", "a"))
    subject = F.coalesce(F.array_contains("a.modifiers", "subj") & F.exists("a.realizations", lambda r: r.startswith("np(")), F.lit(False))
    kept = F.filter("a.realizations", lambda r: ~((r == "np(str)") & F.coalesce(F.array_contains("a.modifiers", "subj"), F.lit(False))))
    every = F.concat(kept, F.when(subject, F.array(F.lit("subj"))).otherwise(F.array().cast("array<string>")))
    return slots.select("frame_id", "slot", F.explode(F.array_distinct(every)).alias("realization"))


def frames_for(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """Candidate frames of (predicate, aspect, has_sie) cases (O-47): same lemma and aspect (or open); with ``sie``, frames of
    the lemma with się, and those of the lemma that have a refl slot. ``cases`` should be distinct, not one row per
    occurrence: a frequent predicate then costs its frames once."""
    f = frames.select("frame_id", F.col("predicate").alias("f_predicate"), F.col("aspect").alias("f_aspect"), "has_refl")
    fits = "(f_aspect = aspect or f_aspect = '_')"
    plain = cases.join(f, F.col("predicate") == F.col("f_predicate")).where(f"{fits} and (not has_sie or has_refl)")
    with_sie = cases.where("has_sie").join(f, F.concat("predicate", F.lit(" się")) == F.col("f_predicate")).where(fits)
    return plain.unionByName(with_sie).select(*cases.columns, "frame_id").distinct()


def occurrence_cases(occurrences: DataFrame, args: DataFrame) -> DataFrame:
    """Occurrences with their case: lemma, aspect, ``sie`` and the set of other labels. Occurrences of one case choose alike, so
    frames are matched per case."""
    sets = args.where("predicate_no >= 0 and label <> 'sie'").groupBy("sent_id", "predicate_no").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return occurrences.join(sets, ["sent_id", "predicate_no"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).select("sent_id", "predicate_no", F.lower("predicate").alias("predicate"), "aspect", "has_sie", "labels")


def matched_slots(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """For every case and candidate frame each label with its first matching slot (O-49, O-110): equi joins on realizations,
    then the smallest slot. Pairs without any match have one row with null label and slot."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    candidates = frames_for(cases.select(*keys).distinct(), frames)
    wanted = candidates.select(*keys, "frame_id", F.explode_outer("labels").alias("label"))
    wanted = wanted.select("*", F.explode_outer(L.realizations(F.col("label"), F.lit(""))).alias("realization"))
    hit = wanted.join(frame_slots(frames), ["frame_id", "realization"], "left")
    per = hit.groupBy(*keys, "frame_id", "label").agg(F.min("slot").alias("slot"))
    return per


def label_slots(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, label, slot): the first slot of each frame that takes a label (O-49, O-110). This doesn't depend on the occurrence, so it is as large as the
    dictionary; ``labels`` has each label once."""
    wanted = labels.where("label <> 'sie'").select("label", F.explode(L.realizations(F.col("label"), F.lit(""))).alias("realization"))
    return frame_slots(frames).join(wanted, "realization").groupBy("frame_id", "label").agg(F.min("slot").alias("slot"))


def frame_keys(cases: DataFrame) -> DataFrame:
    """``cases`` with the dictionary lemmas to look up as ``f_predicate`` (O-47): the own one, where ``needs_refl`` is set with ``sie``, and then that with się."""
    own = F.struct(F.col("predicate").alias("f_predicate"), F.col("has_sie").alias("needs_refl"))
    with_sie = F.struct(F.concat("predicate", F.lit(" się")).alias("f_predicate"), F.lit(False).alias("needs_refl"))
    return cases.select("*", F.inline(F.when(F.col("has_sie"), F.array(own, with_sie)).otherwise(F.array(own))))


def max_frames(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame with the single largest number of matched labels per case; no row on a tie or without a match (O-117 in its
    set-free form)."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    counts = matched_slots(cases, frames).groupBy(*keys, "frame_id").agg(F.count("slot").alias("n_matched"))
    best = counts.groupBy(*keys).agg(F.max("n_matched").alias("n_matched"), F.max_by("frame_id", F.struct("n_matched", "frame_id")).alias("frame_id"), F.max_by("frame_id", F.struct("n_matched", -F.col("frame_id"))).alias("other"), F.count(F.lit(1)).alias("n_candidates"))
    return best.where("n_matched > 0 and frame_id = other").drop("other")


def maximal_counts(cases: DataFrame, labels: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training counts (frame_text, n) and (frame_text, slot, n) of the occurrences that have a frame with the single largest number of matched labels, as in ``max_frames``.

    Frames of a predicate that take the same labels are one kind: cases are paired with kinds and not with frames."""
    slots = label_slots(labels, frames)
    takes = slots.groupBy("frame_id").agg(F.array_sort(F.collect_set("label")).alias("takes"))
    kinds = frames.select("frame_id", F.col("predicate").alias("f_predicate"), F.col("aspect").alias("f_aspect"), "has_refl").join(takes, "frame_id").groupBy("f_predicate", "f_aspect", "has_refl", "takes").agg(F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("frame_id"))
    numbered = cut(cases.groupBy("predicate", "aspect", "has_sie", "labels").agg(F.count(F.lit(1)).alias("times")).withColumn("case_id", F.monotonically_increasing_id()))
    pairs = frame_keys(numbered).join(kinds, "f_predicate").where("(f_aspect = aspect or f_aspect = '_') and (not needs_refl or has_refl)")
    met = pairs.withColumn("met", F.size(F.array_intersect("labels", "takes"))).where("met > 0").groupBy("case_id", "met").agg(F.sum("n").alias("n"), F.min("frame_id").alias("frame_id"))
    best = met.groupBy("case_id").agg(F.max(F.struct("met", "n", "frame_id")).alias("best")).where("best.n = 1").select("case_id", "best.frame_id")
    texts = frames.select("frame_id", "frame_text", F.col("arguments.text").alias("texts"))
    chosen = numbered.join(best, "case_id").join(texts, "frame_id")
    matched = chosen.withColumn("label", F.explode("labels")).join(slots, ["frame_id", "label"]).withColumn("slot", F.get("texts", F.col("slot")))
    return chosen.groupBy("frame_text").agg(F.sum("times").alias("n")), matched.groupBy("frame_text", "slot").agg(F.sum("times").alias("n"))


def passing_frames(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """Candidates of every case that pass the filters (O-120): ``frame_id`` and ``met``, the sorted set of labels with a slot.

    A frame with lexical slots passes only if one of these is matched, one with infinitive slots likewise."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    lexical = F.contains("realization", F.lit("lex")) | F.contains("realization", F.lit("comprep"))
    slots = frame_slots(frames).groupBy("frame_id", "slot").agg(F.max(lexical).alias("lex"), F.max(F.col("realization").startswith("infp")).alias("inf"))
    whole = slots.groupBy("frame_id").agg(F.max("lex").alias("has_lex"), F.max("inf").alias("has_inf"))
    yes = lambda c: F.coalesce(F.max(c), F.lit(False))
    per = matched_slots(cases, frames).join(slots, ["frame_id", "slot"], "left").groupBy(*keys, "frame_id").agg(F.array_sort(F.collect_set(F.when(F.col("slot").isNotNull(), F.col("label")))).alias("met"), yes("lex").alias("lex"), yes("inf").alias("inf"))
    admitted = per.join(whole, "frame_id", "left").where("(has_lex is null or not has_lex or lex) and (has_inf is null or not has_inf or inf)")
    return admitted.select(*keys, "frame_id", "met")


def growing_frames(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame of every case by a scan over its passing candidates in order of their ids, for a growing set of met labels (O-117): a larger set takes
    over, an equal or unrelated one leaves no frame until a larger one comes. No row where none is left."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    listed = passing_frames(cases, frames).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_id", "met"))).alias("scan"))
    nothing = F.struct(F.lit(None).cast("bigint").alias("frame_id"), F.array().cast("array<string>").alias("seen"))

    def step(state, x):
        new, lost = F.size(F.array_except(x["met"], state["seen"])), F.size(F.array_except(state["seen"], x["met"]))
        grows, passed_over = (lost == 0) & (new > 0), (F.size(state["seen"]) == 0) | ((new == 0) & (lost > 0))
        frame = F.when(grows, x["frame_id"]).when(passed_over, state["frame_id"])
        return F.struct(frame.alias("frame_id"), F.when(grows, x["met"]).otherwise(state["seen"]).alias("seen"))

    chosen = listed.withColumn("last", F.aggregate("scan", nothing, step))
    return chosen.select(*keys, "last.frame_id", F.size("last.seen").cast("bigint").alias("n_met")).where("frame_id is not null")


def frame_swappers(frames: DataFrame) -> DataFrame:
    """Predicates that have all frame bodies of another one (O-55): relational division by counting, self left out.

    A predicate's candidates are those that share its rarest body, so a body that most predicates have makes no pairs
    except for those that have no other; then the bodies of each candidate are counted."""
    bodies = frames.where("predicate is not null and body is not null").select("predicate", "body").distinct()
    spread = bodies.groupBy("body").agg(F.count(F.lit(1)).alias("m"))
    anchors = bodies.join(spread, "body").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.min_by("body", F.struct("m", "body")).alias("body"))
    other = bodies.withColumnRenamed("predicate", "other")
    candidates = anchors.join(other, "body").where("predicate <> other").select("predicate", "other", "n")
    shared = candidates.join(bodies, "predicate").join(other, ["other", "body"]).groupBy("predicate", "other", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where("shared = n").select("predicate", "other", F.col("n").alias("n_bodies"))


def comparable(frame_text):
    """Frame text as a value that ignores the order of slots and blanks (O-82)."""
    body = F.get(F.split(frame_text, ":", 6), F.lit(5))
    slots = F.array_sort(F.transform(F.split(body, r"\s*\+\s*(?![^{(]*[})])"), lambda s: F.regexp_replace(s, r"\s+", "")))
    return F.array_join(slots, "+")


def top_unique(df: DataFrame, by: list[str], value: str, pick: str) -> DataFrame:
    """Row with the largest ``value`` per group, none where two share it."""
    rank = Window.partitionBy(*by).orderBy(F.desc(value), pick)
    second = F.lead(value).over(rank)
    return df.select(*by, pick, value, F.row_number().over(rank).alias("__r"), second.alias("__second")).where(f"__r = 1 and (__second is null or __second < {value})").drop("__r", "__second")
