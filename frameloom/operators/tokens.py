"""Window operators over the tokens of sentences: predicates, attachment by cost, features and fillers as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.functions.attachment import AUX_BARRIERS, AUXILIARIES, COORDINATORS
from frameloom.functions.labeling import JAKO_REACH, JAKO_STOPPERS, NONCH
from frameloom.functions.slots import QUESTION_WORDS
from frameloom.operators.corpus import global_index


def _order():
    """Tokens of a sentence in order."""
    return Window.partitionBy("sent_id").orderBy("word_no")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in(c: Column, words) -> Column:
    return _yes(c.isin(*sorted(words)))


def mark_predicates(tokens: DataFrame) -> DataFrame:
    """Adds ``is_predicate``: verbs, but for auxiliaries beside another verb (O-90f)."""
    t = tokens.withColumn("__verb", L.is_verb(F.col("ctag"))).withColumn("__at", F.row_number().over(_order()) - 1)
    verb = lambda i: _yes(F.lag("__verb", -i).over(_order()))
    barrier = lambda i: _in(F.lag("base", -i).over(_order()), AUX_BARRIERS)
    near = ((F.col("__at") > 1) & verb(-1)) | verb(1) | ((F.col("__at") > 2) & verb(-2) & ~barrier(-1)) | (verb(2) & ~barrier(1))
    aux = _in(F.col("orth"), AUXILIARIES) & near
    return t.withColumn("is_predicate", F.col("__verb") & ~aux).drop("__verb", "__at")


def nearest_by_argument(tokens: DataFrame) -> DataFrame:
    """Predicate of each labelled token by cost (O-92): labelled tokens cost 1, coordinators and marks 2, or 6 before a verb.

    Prefix sums turn the cost to the predicate before and after into differences; ties and sentences without predicate give null. For
    subjects, predicates that are infinitive arguments don't count."""
    t = mark_predicates(tokens)
    verb_ahead = _yes(L.is_verb(F.lead("ctag", 1).over(_order()))) | _yes(L.is_verb(F.lead("ctag", 2).over(_order())))
    bar = _in(F.col("base"), COORDINATORS) | _yes(L.pos(F.col("ctag")) == "interp")
    t = t.withColumn("__cost", F.when(bar, 2 + 4 * verb_ahead.cast("int")).otherwise(F.col("label").isNotNull().cast("int")))
    t = t.withColumn("__sum", F.sum("__cost").over(_order()))
    before, after = _order().rowsBetween(Window.unboundedPreceding, -1), _order().rowsBetween(1, Window.unboundedFollowing)

    def sides(flag: Column, name: str) -> list[Column]:
        here = F.when(flag, F.struct("word_no", "__sum", "__cost"))
        return [F.last(here, ignorenulls=True).over(before).alias(f"l{name}"), F.first(here, ignorenulls=True).over(after).alias(f"r{name}")]

    main = F.col("is_predicate") & ~_yes(F.col("label").startswith("infp"))
    found = t.select("*", *sides(F.col("is_predicate"), "_all"), *sides(main, "_main")).where("label is not null")
    subject = F.col("label").startswith("subj")
    both = found.select("sent_id", "word_no", "label", "__sum", "__cost", F.when(subject, F.col("l_main")).otherwise(F.col("l_all")).alias("l"), F.when(subject, F.col("r_main")).otherwise(F.col("r_all")).alias("r"))
    left = F.col("__sum") - F.col("__cost") - F.col("l.__sum")
    right = F.col("r.__sum") - F.col("r.__cost") - F.col("__sum")
    near = F.when(F.col("l").isNull(), F.col("r.word_no")).when(F.col("r").isNull() | (left < right), F.col("l.word_no")).when(right < left, F.col("r.word_no"))
    return both.select("sent_id", "word_no", "label", near.alias("predicate"))


def governing_noun(tokens: DataFrame) -> DataFrame:
    """Noun to the left that a preposition can hang on (O-89): four passes over up to five tokens, each looking for a wider kind
    (nouns not in the genitive, noun-like ones not in it, any noun, anything noun-like) until a token that is no nominal."""
    lags = [x for i in range(1, 6) for x in (F.coalesce(F.lag("ctag", i).over(_order()), F.lit("")).alias(f"__tag{i}"), F.lag("word_no", i).over(_order()).alias(f"__no{i}"))]
    preps = tokens.select("sent_id", "word_no", "ctag", *lags).where(_yes(F.col("ctag").startswith("prep")))
    kind = lambda x, *kinds: reduce(lambda a, b: a | b, [x["tag"].startswith(k) for k in kinds])
    before = F.array(*[F.struct(F.col(f"__no{i}").alias("no"), F.col(f"__tag{i}").alias("tag")) for i in range(1, 6)])
    # no pass goes further than the first token that is no nominal
    stop = F.array_position(F.transform(before, lambda x: kind(x, "subst", "psubst", "adj", "padj", "ppron", "depr")), False)
    within = F.slice(before, F.lit(1), F.when(stop == 0, 5).otherwise(stop.cast("int")))
    direct = lambda x: ~F.contains(x["tag"], F.lit(":gen"))
    passes = [lambda x: kind(x, "subst") & direct(x), lambda x: kind(x, "subst", "ppron", "depr") & direct(x), lambda x: kind(x, "subst"), lambda x: kind(x, "subst", "ppron", "depr")]
    return preps.select("sent_id", "word_no", F.coalesce(*[F.get(F.filter(within, f), F.lit(0))["no"] for f in passes]).alias("noun_no"))


def chunk_heads(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds ``is_head``: whether the token is the syntactic head of a phrase group (column 5 of the labeller's features)."""
    heads = groups.where("syntactic_head is not null").select("sent_id", F.col("syntactic_head").alias("word_no"), F.lit(True).alias("is_head")).distinct()
    return tokens.join(heads, ["sent_id", "word_no"], "left").withColumn("is_head", _yes(F.col("is_head")))


def _nearest_by_distance(t: DataFrame, *columns: str) -> Column:
    """Of the nearest predicate (``is_predicate``; of two as near the right one) a struct of ``columns``."""
    flag = F.when(F.col("is_predicate"), F.struct("word_no", *columns))
    left = F.last(flag, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(flag, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    return F.when(left.isNull() | (right["word_no"] - F.col("word_no") <= F.col("word_no") - left["word_no"]), right).otherwise(left)


def preposition_keys(tokens: DataFrame) -> DataFrame:
    """Prepositions with what attachment is looked up by: lemmas of the nearest predicate, of the governing noun (O-89) and of the preposition, its case, and whether the corpus attaches it to that predicate."""
    t = mark_predicates(tokens)
    preps = t.withColumn("near", _nearest_by_distance(t, "base")).where(_yes(F.col("ctag").startswith("prep")) & F.col("near").isNotNull())
    preps = preps.select("sent_id", "word_no", F.col("near.base").alias("verb"), F.col("base").alias("prep"), F.coalesce(L.tag_part(F.col("ctag"), 1), F.lit("")).alias("case_"), (F.col("predicate_no") == F.col("near.word_no")).alias("to_verb"))
    nouns = governing_noun(tokens).where("noun_no is not null").join(tokens.select("sent_id", F.col("word_no").alias("noun_no"), F.col("base").alias("noun")), ["sent_id", "noun_no"])
    return preps.join(nouns.select("sent_id", "word_no", "noun"), ["sent_id", "word_no"]).where("verb is not null and noun is not null and prep is not null")


def attachment_statistics(keys: DataFrame) -> DataFrame:
    """The table of O-08 from a corpus: per (verb, noun, prep, case_) the shares attached to verb and noun, and the decision (1 verb, 2 noun)."""
    per = keys.where("to_verb is not null").groupBy("verb", "noun", "prep", "case_").agg(F.avg(F.col("to_verb").cast("int")).alias("verb_p"))
    return per.select("verb", "noun", "prep", "case_", "verb_p", (1 - F.col("verb_p")).alias("noun_p"), F.when(F.col("verb_p") >= 0.5, 1).otherwise(2).alias("decision"))


def pp_attachment_noun(keys: DataFrame, statistics: DataFrame, least: float = 0.01) -> DataFrame:
    """(sent_id, word_no, pp): ``noun`` where the statistics attach the preposition to the noun with at least that probability, else ``_`` (O-86)."""
    found = keys.join(statistics, ["verb", "noun", "prep", "case_"], "left")
    return found.select("sent_id", "word_no", F.when(_yes((F.col("decision") == 2) & (F.col("noun_p") >= least)), "noun").otherwise("_").alias("pp"))


def number_match(tokens: DataFrame) -> DataFrame:
    """Number (second part of the tag) that a token shares with the nearest predicate, else ``_`` (O-85)."""
    t = mark_predicates(tokens)
    near = _nearest_by_distance(t, "ctag")["ctag"]
    own, theirs = L.tag_part(F.col("ctag"), 1), L.tag_part(near, 1)
    return t.select("sent_id", "word_no", F.when(own == theirs, own).otherwise("_").alias("number_match"))


def fillers(tokens: DataFrame) -> DataFrame:
    """Labels that the fillers add to tokens without one (O-105, O-107, O-108), a row each."""
    following = F.coalesce(F.lead("base").over(_order()), F.lit(""))
    asks = _in(F.lower("base"), QUESTION_WORDS) | _in(F.lower("orth"), QUESTION_WORDS)
    nonch = _in(F.col("base"), NONCH) | (_yes(F.col("base") == "to") & (following == "samo"))
    rows = tokens.select("sent_id", "word_no", "label", F.array(
        F.when(F.col("label").isNull() & asks & ~following.isin("i", "również"), "sentp(pz)"), F.when(F.col("label").isNull() & nonch, "nonch"), F.when(_yes(F.lower("orth") == "siebie"), "refl"),
    ).alias("added"))
    return rows.select("sent_id", "word_no", F.explode(F.array_compact("added")).alias("added"))


def jako_fillers(tokens: DataFrame) -> DataFrame:
    """Label of every unlabelled ``jako`` (O-106): prepadjp where, before the next verb, unlabelled token or sixth token, there is an adjective and no noun, and no
    subject or object stands there; else prepnp. A window of six leads; no task looks beyond a sentence."""
    ahead = lambda c, i: F.lead(c, i).over(_order())
    places = range(1, JAKO_REACH + 1)
    t = tokens.withColumn("__stop", L.is_verb(F.col("ctag")) | F.col("label").isNull()).withColumn("__next", F.array(*[F.struct(_yes(ahead("__stop", i)).alias("stop"), ahead("word_no", i).isNull().alias("end"), ahead("ctag", i).alias("ctag"), ahead("label", i).alias("label")) for i in range(1, JAKO_REACH + 2)]))
    at = lambda i: F.col("__next")[i - 1]
    stop = F.coalesce(*[F.when(at(i)["stop"] | at(i)["end"], i) for i in places], F.lit(JAKO_REACH + 1))
    within = F.slice("__next", F.lit(1), F.col("__to") - 1)
    some = lambda kind: F.exists(within, lambda x: _yes(x["ctag"].startswith(kind)))
    stopper = _in(F.element_at("__next", F.col("__to"))["label"], JAKO_STOPPERS)
    rows = t.withColumn("__to", stop).where((F.col("base") == "jako") & F.col("label").isNull())
    return rows.select("sent_id", "word_no", F.when(some("adj") & ~some("subst") & ~stopper, "prepadjp(jako,str)").otherwise("prepnp(jako,str)").alias("added"))


def runs(tokens: DataFrame, value: Column) -> DataFrame:
    """Runs of equal values within each sentence (O-133): start and length, by a change flag summed up."""
    t = tokens.withColumn("__v", F.coalesce(value, F.lit("")))
    changed = F.coalesce(F.col("__v") != F.lag("__v").over(_order()), F.lit(True)).cast("int")
    numbered = t.withColumn("__run", changed).withColumn("__run", F.sum("__run").over(_order()))
    return numbered.groupBy("sent_id", "__run").agg(F.min("word_no").alias("start"), F.count(F.lit(1)).alias("length"), F.first("__v").alias("value")).drop("__run")


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Index of each category by frequency, ties by name (O-141): encode by joining it; binarise by comparing."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), (-F.count(F.lit(1))).alias("rarity"))
    return global_index(counts, ["rarity", column]).drop("rarity")


def split_sums(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mass of every synset: each unit's count split over its synsets and summed up the hierarchy (assumed reading of the
    split-sum scorer). ``units``: unit, synset_id, n; ``pairs``: node, ancestor."""
    width = units.groupBy("unit").agg(F.count(F.lit(1)).alias("w"))
    own = units.join(width, "unit").groupBy("synset_id").agg(F.sum(F.col("n") / F.col("w")).alias("own"))
    up = own.join(pairs.where("node <> ancestor").select(F.col("node").alias("synset_id"), "ancestor"), "synset_id").select(F.col("ancestor").alias("synset_id"), "own")
    return own.unionByName(up).groupBy("synset_id").agg(F.sum("own").alias("mass"))
