"""Readers of line-based files: attachment statistics, dictionaries, phrase types, gold rows, tagged text, frequencies, NKJP JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.functions.slots import parse_frame

WORD = "struct<orth:string,base:string,ctag:string,nps:boolean>"


def read_pp_attachment(spark: SparkSession, path: str) -> DataFrame:
    """Attachment statistics (O-08): verb_p, noun_p, decision (1 verb, 2 noun), verb, noun, prep, case. Of repeated keys the
    last line counts; blank lines and lines without a number fall away."""
    names = "verb_p double, noun_p double, decision int, zero string, verb string, noun string, prep string, `case` string"
    rows = spark.read.csv(path, sep="\t", schema=names, quote="", encoding="UTF-8").where("verb_p is not null and decision is not null")
    rows = rows.withColumn("verb", F.expr("substring(verb, 3)")).withColumn("noun", F.expr("substring(noun, 3)")).withColumn("place", F.monotonically_increasing_id())
    last = rows.groupBy("verb", "noun", "prep", "case").agg(F.max_by(F.struct("verb_p", "noun_p", "decision"), "place").alias("x"))
    return last.select("verb", "noun", "prep", "case", "x.verb_p", "x.noun_p", "x.decision")


def read_conll(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """Sentences of a column file (O-103), a row each: ``file``, ``rows``, an array over the tokens of (``columns``, ``label``, ``labels``).

    Blank lines part sentences and so are the record separator: a file of any size is split. Lines that begin with ``# `` and hold no tab are comments.
    ``label`` is the last column. With ``n_features``, ``labels`` holds all columns after so many features, as taggers write that
    give every label with its probability (``label/probability``); else it is null. Empty files give no rows."""
    text = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    kept = F.filter("lines", lambda x: (F.trim(x) != "") & ~(F.ltrim(x).startswith("# ") & ~F.contains(x, F.lit("\t"))))
    labels = lambda c: F.slice(c, n_features + 1, F.greatest(F.size(c) - n_features, F.lit(0))) if n_features is not None else F.lit(None).cast("array<string>")
    token = lambda c: F.struct(c.alias("columns"), F.element_at(c, -1).alias("label"), labels(c).alias("labels"))
    return text.select("file", F.transform(kept, lambda x: token(F.split(x, "\t"))).alias("rows")).where("size(rows) > 0")


def labels_with_probabilities(labels):
    """``label/probability`` texts as structs; the probability follows the last slash."""
    return F.transform(labels, lambda x: F.struct(F.regexp_extract(x, "^(.*)/[^/]*$", 1).alias("label"), F.regexp_extract(x, "/([^/]*)$", 1).try_cast("double").alias("prob")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't empty (O-21): ``value``."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "﻿", "")).alias("value")).where("value <> ''")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) of a CSV (O-17)."""
    return spark.read.csv(path, schema="word string, count bigint").where("word is not null and count is not null")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows (O-15): ``gold``, a map of the header's names to the values present; shorter rows have fewer."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE")
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in rows.columns])
    return rows.select(F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("gold"))


def parse_tagged(column):
    """Words of ``orth[base>ctag]`` text (O-16), blanks between them; ``xxx`` is the unknown tag, ``&`` is escaped."""
    parts = F.filter(F.split(F.trim(column), r"\s+"), lambda t: t.rlike(r"^.*\[.*>.*\]$"))
    clean = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    word = lambda t: F.struct(
        clean(F.regexp_extract(t, r"^(.*)\[", 1)).alias("orth"), clean(F.regexp_extract(t, r"\[([^\[]*)>", 1)).alias("base"),
        F.when(F.regexp_extract(t, r">([^>]*)\]$", 1) == "xxx", "ign").otherwise(F.regexp_extract(t, r">([^>]*)\]$", 1)).alias("ctag"), F.lit(False).alias("nps"),
    )
    return F.transform(parts, word)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Valency dictionary (O-11): frame_text, predicate, status, neg, aspect, arguments (text, modifiers, realizations), ``ord``."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(o, f) for o, line in zip(b["ord"], b["value"]) if (f := parse_frame(line))]
            yield pd.DataFrame({"ord": [o for o, _ in out], "frame_text": [f.text for _, f in out], "predicate": [f.predicate for _, f in out], "status": [f.status for _, f in out], "neg": [f.neg for _, f in out], "aspect": [f.aspect for _, f in out],
                                "arguments": [[{"text": s.text, "modifiers": list(s.modifiers), "realizations": list(s.realizations)} for s in f.slots] for _, f in out]})

    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    schema = "ord bigint, frame_text string, predicate string, status string, neg string, aspect string, arguments array<struct<text:string,modifiers:array<string>,realizations:array<string>>>"
    return lines.mapInPandas(run, schema)


def flat_dictionary(frames: DataFrame) -> DataFrame:
    """(predicate, aspect, realization) rows (O-12): reflexive predicates stand under the plain lemma with the argument ``sie``."""
    slots = frames.select(F.regexp_replace("predicate", " się$", "").alias("predicate"), F.endswith("predicate", F.lit(" się")).alias("sie"), "aspect", F.explode("arguments").alias("a"))
    rows = slots.select("predicate", "aspect", F.explode("a.realizations").alias("r"), F.array_contains("a.modifiers", "subj").alias("subject"))
    rows = rows.select("predicate", "aspect", F.when(F.col("subject"), F.concat(F.lit("subj:"), "r")).otherwise(F.col("r")).alias("realization"))
    with_sie = slots.where("sie").select("predicate", "aspect", F.lit("sie").alias("realization"))
    return rows.unionByName(with_sie).distinct()


def read_old_frames(spark: SparkSession, path: str) -> DataFrame:
    """The older dictionary (O-13): predicate, aspect (the fourth of five fields), arguments (modifiers, realizations).

    Comments (``%``), blank lines and lines of fewer fields fall away, as do slots without braces. Slots are parted by ``+`` wherever it stands."""
    line = F.trim(F.regexp_replace("value", "\ufeff", " "))
    rows = spark.read.text(path).select(F.split(line, ":", 5).alias("x")).where((F.size("x") == 5) & ~F.startswith(F.col("x")[0], F.lit("%")))
    pieces = lambda text, mark: F.transform(F.split(text, mark), lambda x: F.trim(x))
    slot = lambda s: F.struct(F.filter(pieces(F.regexp_extract(s, r"^([^{]*)\{", 1), ","), lambda x: x != "").alias("modifiers"), pieces(F.regexp_extract(s, r"^[^{]*\{(.*).$", 1), ";").alias("realizations"))
    slots = F.transform(F.filter(pieces(F.col("x")[4], r"\+"), lambda s: F.contains(s, F.lit("{"))), slot)
    return rows.select(F.trim(F.col("x")[0]).alias("predicate"), F.trim(F.col("x")[3]).alias("aspect"), slots.alias("arguments"))


def read_phrase_types(spark: SparkSession, path: str) -> DataFrame:
    """(type, member) of a phrase-type list (O-14): ``type-->`` headers with indented members. One small ordered file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("place", "line"))
    head = F.when(F.contains("line", F.lit("-->")), F.regexp_extract("line", "^(.*?)-->", 1))
    named = lines.withColumn("type", F.last(head, ignorenulls=True).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    members = named.where("line like ' %' and type is not null").select("type", F.trim(F.get(F.split("line", r"\["), F.lit(0))).alias("member"))
    return members.where("member <> ''")


def member_types(types: DataFrame) -> DataFrame:
    """(member, type) with one level of nesting: the types of a member, and their types."""
    up = types.select(F.col("member").alias("inner"), F.col("type").alias("outer"))
    nested = types.join(up, types.type == up.inner).select("member", F.col("outer").alias("type"))
    return types.select("member", "type").unionByName(nested).distinct()


def read_nkjp(spark: SparkSession, path: str) -> DataFrame:
    """NKJP-style JSON (O-07): sent_id (file position), words, groups (arg_type, syntactic_head, semantic_head). Each line is an
    array of sentences; broken lines and sentences without words are dropped, as are groups of type ``prepnp(temu``."""
    schema = "array<struct<words:array<struct<orth:string,interp:array<string>,nps:boolean>>,groups:array<struct<group_type:string,sem_head:int,syn_head:int>>>>"
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).select("line", F.posexplode(F.from_json("value", schema, {"mode": "PERMISSIVE"})).alias("place", "s")).where("size(s.words) > 0")
    words = F.transform("s.words", lambda w: F.struct(w["orth"].alias("orth"), F.get(w["interp"], F.lit(0)).alias("base"), F.get(w["interp"], F.lit(1)).alias("ctag"), F.coalesce(w["nps"], F.lit(False)).alias("nps")))
    x = rows.select(F.concat_ws("-", "line", "place").alias("sent_id"), words.alias("words"), F.coalesce("s.groups", F.array().cast("array<struct<group_type:string,sem_head:int,syn_head:int>>")).alias("groups"))
    names = F.create_map(*[F.lit(y) for k, v in L.CASES.items() for y in (v, k)])

    def group(g, words):
        head = F.get(words, g["syn_head"])
        case = F.coalesce(F.element_at(names, L.case_of(head["ctag"])), F.lit("_"))
        t = g["group_type"]
        paren = lambda kind, *a: F.concat(F.lit(kind + "("), *a, F.lit(")"))
        kind = (
            F.when(t.isin("NG", "NumG"), paren("np", case)).when(t == "AdjG", paren("adjp", case)).when(t.isin("PrepNG", "PrepNumG"), paren("prepnp", head["base"], F.lit(","), case))
            .when(t == "PrepAdjP", paren("prepadjp", head["base"], F.lit(","), case)).when(t == "AdvG", F.lit("advp")).when(t == "CG", paren("sentp", head["base"])).when(t == "KG", F.lit("sentp(int)")).when(t == "DisG", F.lit("disg"))
        )
        return F.struct(kind.alias("arg_type"), g["syn_head"].alias("syntactic_head"), g["sem_head"].alias("semantic_head"))

    groups = F.filter(F.transform("groups", lambda g: group(g, F.col("words"))), lambda g: g["arg_type"].isNotNull() & ~g["arg_type"].startswith("prepnp(temu"))
    return x.select("sent_id", "words", groups.alias("groups"))
