"""Queries of the training-data problems (p2, p3, p6, p7, p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.garbled import find_garbled
from frameloom.llm.ngrams import ngram_counts, term_bands
from frameloom.llm.mixing import entropy, exponent_for_entropy, mix, tempered
from frameloom.llm.packing import pack
from frameloom.llm.similar import most_similar
from frameloom.llm.tokens import token_counts
from frameloom.runtime import cut, table


def _p2(spark: SparkSession, d: str, least: float) -> DataFrame:
    return most_similar(table(spark, d, "word_vectors"), table(spark, d, "vector_files"), "word_id", "file_id", "vec", "vector_size", 5, least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = _p2(spark, d, 0.8)
    return near.select(F.least("id", "neighbour").alias("word_id_a"), F.greatest("id", "neighbour").alias("word_id_b")).distinct()


def p2_most_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar words of its file for every vector."""
    return _p2(spark, d, -1.0).select(F.col("file").alias("file_id"), F.col("id").alias("word_id"), F.col("neighbour").alias("similar_id"), F.round("cosine", 6).alias("cosine"))


def _p3_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens, groups = table(spark, d, "tokens"), table(spark, d, "nkjp_groups")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("term")) for c in ("base", "ctag")])).alias("f")
    rows = tokens.select("sent_id", F.col("word_no").alias("position"), fields).select("sent_id", "position", "f.field_name", "f.term")
    rows = rows.unionByName(groups.select("sent_id", F.col("group_no").alias("position"), F.lit("arg_type").alias("field_name"), F.col("arg_type").alias("term")))
    counts = ngram_counts(rows, "sent_id", "position", "term", 1, ("field_name",))
    sentences, group_sentences = (t.agg(F.countDistinct("sent_id")).first()[0] for t in (tokens, groups))
    totals = spark.createDataFrame([("base", sentences), ("ctag", sentences), ("arg_type", group_sentences)], "field_name string, total long")
    return term_bands(counts, totals, "field_name").withColumn("term", F.element_at("ngram", 1))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_counts(spark, d).where("band != 'useful'").select("field_name", "term", "band")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value with its occurrences, sentences and band."""
    return _p3_counts(spark, d).select("field_name", "term", F.col("n").alias("n_occurrences"), F.col("n_records").alias("n_sentences"), "band")


def p3_base_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every run of one to three lemmas with its occurrences and sentences."""
    counts = ngram_counts(table(spark, d, "tokens"), "sent_id", "word_no", "base", 3)
    return counts.select(F.array_join("ngram", " ").alias("ngram"), F.size("ngram").alias("length"), "n", "n_records")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents"), "text", ["doc_id"])
    profiles = [(r["profile"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").collect()]  # a fixed table of three rows
    return pack(sizes, "doc_id", "n_tokens", profiles)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (piece) with its container, for each profile."""
    return _p6(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each profile."""
    boxes = _p6(spark, d).groupBy("profile", "container").agg(F.sum("length").alias("filled"))
    per = boxes.groupBy("profile").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("filled").alias("n_tokens"))
    return per.join(F.broadcast(table(spark, d, "pack_sizes")), "profile").withColumn("fill", F.round(F.col("n_tokens") / F.col("n_containers") / F.col("capacity_tokens"), 6))


def _p7_inputs(spark: SparkSession, d: str):
    sizes = cut(token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"]))
    return sizes, [tuple(r) for r in table(spark, d, "mix_targets").select("source", "target_share", "max_repeats").collect()]  # a fixed table of eight rows


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents with their tokens and how often each is used."""
    sizes, targets = _p7_inputs(spark, d)
    return mix(sizes, "doc_id", "source", "n_tokens", targets)[0].withColumnRenamed("size", "n_tokens")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source, with what is left unused and the exponent."""
    sizes, targets = _p7_inputs(spark, d)
    return mix(sizes, "doc_id", "source", "n_tokens", targets)[1]


def p7_whole_total(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix as large as all tokens of the sources: the exponent is bisected to the repetition limits, so shares come as near to the targets as these allow."""
    sizes, targets = _p7_inputs(spark, d)
    total = sizes.where(F.col("source").isin([s for s, _, _ in targets])).agg(F.sum("n_tokens")).first()[0] or 0
    return mix(sizes, "doc_id", "source", "n_tokens", targets, float(total))[1]


def p7_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Natural shares, and the shares tempered to the entropy of the targets, without looking at the single targets."""
    sizes, targets = _p7_inputs(spark, d)
    names = [s for s, _, _ in targets]
    held = {r["source"]: float(r["n"]) for r in sizes.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if r["n"]}
    exponent = exponent_for_entropy(held, entropy({s: w for s, w, _ in targets}))
    shares = {s: n / sum(held.values()) for s, n in held.items()}
    weights = tempered(shares, exponent)
    rows = [(s, int(held[s]), round(shares[s], 9), round(exponent, 9), round(weights[s], 9)) for s in sorted(held)]
    return spark.createDataFrame(rows, "source string, n_tokens long, share double, exponent double, weight double")


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the encodings found and the text as far as it can be restored."""
    return _p8(spark, d)


_P3 = """
    with v as (select distinct 'base' as field_name, sent_id, word_no as no, base as term from tokens
               union all select distinct 'ctag', sent_id, word_no, ctag from tokens
               union all select distinct 'arg_type', sent_id, group_no, arg_type from nkjp_groups),
    t as (select 'base' as field_name, count(distinct sent_id) as total from tokens union all select 'ctag', count(distinct sent_id) from tokens
          union all select 'arg_type', count(distinct sent_id) from nkjp_groups),
    c as (select field_name, term, count(*) as n_occurrences, count(distinct sent_id) as n_sentences from v where term <> '' group by 1, 2),
    b as (select c.*, case when n_sentences < 3 then 'rare' when n_sentences > 0.2 * total then 'common' else 'useful' end as band from c join t using (field_name))"""
SQL = {
    "p3_found": _P3 + " select field_name, term, band from b where band <> 'useful'",
    "p3_terms": _P3 + " select field_name, term, n_occurrences, n_sentences, band from b",
    "p3_base_ngrams": """
        with v as (select distinct sent_id, word_no::bigint as p, base as w from tokens where base <> ''),
        t as (select sent_id, p, min(w) as w from v group by 1, 2),
        g as (select sent_id, w as ngram, 1 as length, p from v
              union all select a.sent_id, a.w || ' ' || b.w, 2, a.p from t a join t b on a.sent_id = b.sent_id and b.p = a.p + 1
              union all select a.sent_id, a.w || ' ' || b.w || ' ' || c.w, 3, a.p from t a join t b on a.sent_id = b.sent_id and b.p = a.p + 1 join t c on a.sent_id = c.sent_id and c.p = a.p + 2)
        select ngram, length, count(*) as n, count(distinct sent_id) as n_records from g group by 1, 2""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_most_similar, p3_found, p3_terms, p3_base_ngrams, p6_containers, p6_fill, p7_selection, p7_shares, p7_whole_total, p7_temperature, p8_found, p8_restored)}
