"""Queries of the general data problems (p1, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.hierarchy import ancestor_pairs, clean_edges, cycle_members, root_levels
from frameloom.operators.shred import children, entities, shred, shred_columns
from frameloom.operators.skew import keys_with_share, salted_aggregate
from frameloom.runtime import cut, table, tidy


def _key(left: str, right: str):
    return F.concat_ws("-", left, right)


def _linked(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Left join on (key, rec, ``on``); keys compare null-safe. ``other`` has one row for each."""
    k, r, n = (c + "__" for c in ("key", "rec", on))
    other = other.withColumnsRenamed({"key": k, "rec": r, on: n})
    return df.join(other, F.col("key").eqNullSafe(F.col(k)) & (F.col("rec") == F.col(r)) & (F.col(on) == F.col(n)), "left").drop(k, r, n)


def _arguments(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """Argument rows with the span of their predicate; either span is null where it is not given."""
    nodes = shred_columns(table(spark, d, "sentences"), "sent_id", ["argument_structures"], ["left_ix", "right_ix", *fields])
    every = cut(entities(nodes, ["left_ix", "right_ix", *fields], ["pred", "span", "args"]))
    number = lambda label, parent, left, right: every.where(F.col("label") == label).select("key", "rec", F.col("parent").alias(parent), F.col("left_ix").cast("int").alias(left), F.col("right_ix").cast("int").alias(right))
    args = every.where("label = 'args'").select("key", "rec", "node", F.col("parent").alias("entry"), *fields)
    return _linked(_linked(args, number("span", "node", "left_ix", "right_ix"), "node"), number("pred", "entry", "pred_left", "pred_right"), "entry")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred(table(spark, d, "sentences"), "sent_id", ["ccl"], roots=["chunks"], fields=["number", "chunkType", "head", "words"])
    return entities(nodes, ["number", "chunkType", "head"], needed="number", lists=("words",)).withColumn("chunk_type", F.coalesce("chunkType", "label"))


def p1_words(spark: SparkSession, d: str) -> DataFrame:
    """One row per word of a sentence, with its position."""
    words = entities(shred_columns(table(spark, d, "sentences"), "sent_id", ["words"]), ["orth", "base", "ctag", "nps"], ["words"])
    return words.select(F.col("key").alias("sent_id"), F.col("ordinal").alias("word_no"), "orth", "base", "ctag", F.col("nps").cast("boolean").alias("nps")).distinct()


def p1_arguments(spark: SparkSession, d: str) -> DataFrame:
    """One row per argument, with its predicate's span."""
    rows = _arguments(spark, d, "argument_type", "syntactic_head", "semantic_head")
    return rows.select(F.col("key").alias("sent_id"), "pred_left", "pred_right", "left_ix", "right_ix", "argument_type", F.col("syntactic_head").cast("int").alias("syntactic_head"), F.col("semantic_head").cast("int").alias("semantic_head")).distinct()


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk object that has a number, with its type."""
    return _chunks(spark, d).select(F.col("key").alias("sent_id"), "chunk_type", "number", F.col("head").cast("int").alias("head")).distinct()


def p1_chunk_words(spark: SparkSession, d: str) -> DataFrame:
    """One row per word index of a chunk."""
    return children(_chunks(spark, d), "words", ["chunk_type", "number"], "word_index").select(F.col("key").alias("sent_id"), "chunk_type", "number", "word_index").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    row = lambda kind, parent, child: F.struct(F.lit(kind).alias("kind"), parent.alias("parent_key"), child.alias("child_key"))
    objects = shred_columns(table(spark, d, "sentences"), "sent_id", ["words"], []).where("kind = 'object'")
    words = objects.select(F.col("key").alias("sent_id"), row("word", F.lit(""), F.col("ordinal").cast("string")).alias("x")).select("sent_id", "x.*")
    spans = _arguments(spark, d).where("pred_left is not null and pred_right is not null and left_ix is not null and right_ix is not null")
    arguments = spans.select(F.col("key").alias("sent_id"), row("argument", _key("pred_left", "pred_right"), _key("left_ix", "right_ix")).alias("x")).select("sent_id", "x.*")
    inside = F.transform("words", lambda w: row("chunk_word", F.concat_ws(":", "chunk_type", "number"), w["scalar"]))
    chunks = _chunks(spark, d).select(F.col("key").alias("sent_id"), F.inline(F.concat(F.array(row("chunk", F.col("chunk_type"), F.col("number"))), inside)))
    return words.unionByName(arguments).unionByName(chunks).distinct()


# the trees of the texts, and of those strings at or below ``chunks`` that hold JSON themselves; ``above`` is the nearest key of a node that is a name
_P1_CHUNKS = """
    txt as (select distinct sent_id, ccl from sentences where json_valid(ccl)),
    one as (select sent_id, ccl, '' as place, t.id, t.parent, t.key, t.type, t.value, t.fullkey, t.value ->> '$' as scalar from txt, json_tree(ccl) t where regexp_matches(t.fullkey, '\\.chunks([.\\[]|$)')),
    held as (select sent_id, ccl, fullkey, scalar from one where type = 'VARCHAR' and regexp_matches(scalar, '^\\s*[{\\[]') and json_valid(scalar)),
    two as (select sent_id, ccl, h.fullkey as place, t.id, t.parent, t.key, t.type, t.value, h.fullkey || substr(t.fullkey, 2) as fullkey, t.value ->> '$' as scalar from held h, json_tree(h.scalar) t),
    nod as (select *, trim(regexp_extract(fullkey, '\\.("[^"]*"|[^."\\[\\]]+)(\\[\\d+\\])*$', 1), '"') as above from (select * from one union all select * from two)),
    sca as (select * from nod where type not in ('OBJECT', 'ARRAY', 'NULL')),
    chu as (select o.sent_id, o.ccl, o.place, o.id, coalesce(k.scalar, o.above) as chunk_type, n.scalar as number, h.scalar::int as head from nod o
            join sca n on (n.sent_id, n.ccl, n.place, n.parent, n.key) = (o.sent_id, o.ccl, o.place, o.id, 'number')
            left join sca k on (k.sent_id, k.ccl, k.place, k.parent, k.key) = (o.sent_id, o.ccl, o.place, o.id, 'chunkType')
            left join sca h on (h.sent_id, h.ccl, h.place, h.parent, h.key) = (o.sent_id, o.ccl, o.place, o.id, 'head') where o.type = 'OBJECT'),
    cwo as (select c.sent_id, c.chunk_type, c.number, w.scalar as word_index from chu c
            join (select a.sent_id, a.ccl, a.place, a.parent as owner, coalesce(e.scalar, s.scalar) as scalar from nod a
                  left join sca e on a.type = 'ARRAY' and (e.sent_id, e.ccl, e.place, e.parent) = (a.sent_id, a.ccl, a.place, a.id)
                  left join sca s on (s.sent_id, s.ccl, s.place, s.id) = (a.sent_id, a.ccl, a.place, a.id) where a.key = 'words') w
              on (w.sent_id, w.ccl, w.place, w.owner) = (c.sent_id, c.ccl, c.place, c.id) where w.scalar is not null)"""
_P1_ARGUMENTS = "select sent_id, a, unnest(a.args) as b from (select sent_id, unnest(argument_structures) as a from sentences)"
P1_SQL = {
    "p1_words": "select distinct sent_id, i::int as word_no, words[i + 1].orth as orth, words[i + 1].base as base, words[i + 1].ctag as ctag, words[i + 1].nps as nps from (select sent_id, words, unnest(range(len(words))) as i from sentences) where words[i + 1] is not null",
    "p1_chunks": f"with {_P1_CHUNKS} select distinct sent_id, chunk_type, number, head from chu",
    "p1_chunk_words": f"with {_P1_CHUNKS} select distinct sent_id, chunk_type, number, word_index from cwo",
    "p1_found": f"""with {_P1_CHUNKS}
        select distinct sent_id, 'word' as kind, '' as parent_key, i::varchar as child_key from (select sent_id, words, unnest(range(len(words))) as i from sentences) where words[i + 1] is not null
        union select sent_id, 'argument', a.pred.left_ix || '-' || a.pred.right_ix, b.span.left_ix || '-' || b.span.right_ix from ({_P1_ARGUMENTS})
              where a.pred.left_ix is not null and a.pred.right_ix is not null and b.span.left_ix is not null and b.span.right_ix is not null
        union select sent_id, 'chunk', chunk_type, number from chu
        union select sent_id, 'chunk_word', chunk_type || ':' || number, word_index from cwo""",
    "p1_arguments": f"""
        select distinct sent_id, a.pred.left_ix as pred_left, a.pred.right_ix as pred_right, b.span.left_ix as left_ix, b.span.right_ix as right_ix,
               b.argument_type as argument_type, b.syntactic_head as syntactic_head, b.semantic_head as semantic_head
        from ({_P1_ARGUMENTS}) where b is not null""",
}


def _frames_rows(spark, d):
    return table(spark, d, "frames").select("frame_id", tidy(F.col("predicate")).alias("predicate"))


def _result_rows(spark, d):
    return table(spark, d, "pred_results").select("result_id", tidy(F.col("predicate")).alias("predicate"), "result_value")


def p4_predicate_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and accuracy of every predicate of both tables; a null predicate is a group of its own."""
    frames = salted_aggregate(_frames_rows(spark, d), "predicate", "frame_id")
    results = salted_aggregate(_result_rows(spark, d), "predicate", "result_id", "result_value")
    cols = lambda df, name: df.select(F.lit(name).alias("table_name"), "predicate", "n", "n_scored", F.round("mean", 6).alias("accuracy"))
    return cols(frames, "frames").unionByName(cols(results, "pred_results"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    frames = keys_with_share(_frames_rows(spark, d), "predicate", "frame_id", 0.04)
    results = keys_with_share(_result_rows(spark, d), "predicate", "result_id", 0.04)
    return frames.select(F.lit("frames").alias("table_name"), "predicate").unionByName(results.select(F.lit("pred_results").alias("table_name"), "predicate"))


_TIDY = r"nullif(lower(regexp_replace(predicate, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"
_P4 = f"""
    with f as (select distinct frame_id as id, {_TIDY} as predicate, null::double as v from frames where frame_id is not null),
    r as (select result_id as id, {_TIDY} as predicate, max(case when not isnan(result_value) then result_value::double end) as v from pred_results where result_id is not null group by 1, 2),
    per as (select 'frames' as table_name, predicate, count(*) as n, count(v) as n_scored, avg(v) as accuracy from f group by 2
            union all select 'pred_results', predicate, count(*), count(v), avg(v) from r group by 2)"""
P4_SQL = {
    "p4_predicate_stats": _P4 + " select table_name, predicate, n, n_scored, round(accuracy, 6) as accuracy from per",
    "p4_found": _P4 + " select table_name, predicate from (select *, sum(n) over (partition by table_name) as total from per) where predicate is not null and n >= 0.04 * total",
}


def synset_edges(spark: SparkSession, d: str) -> DataFrame:
    """Hypernym edges (child, parent) whose ends are both synsets."""
    edges = table(spark, d, "synset_relations").where("relation_type = 11")
    return cut(clean_edges(edges, table(spark, d, "synsets"), "child_id", "parent_id", "synset_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = synset_edges(spark, d)
    roots = root_levels(edges).where("depth > 0").select(F.col("node").alias("synset_id"), F.lit("root").alias("kind"), F.col("root").alias("other_id"))
    return roots.unionByName(cycle_members(edges).select(F.col("node").alias("synset_id"), F.lit("cycle").alias("kind"), F.col("cycle").alias("other_id")))


def p5_hyponyms(spark: SparkSession, d: str) -> DataFrame:
    """Every synset with each of its hyponyms and the number of levels between."""
    return ancestor_pairs(synset_edges(spark, d)).select(F.col("ancestor").alias("synset_id"), F.col("node").alias("hyponym_id"), F.col("distance").cast("int").alias("levels"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """For every synset and each root it leads up to: the depth below the root and the shortest path from the root, of several the one with the smallest parent at every step up.

    A synset without hypernym is its own root at depth 0. One that leads only into a cycle has one row without root, depth and path."""
    edges = synset_edges(spark, d)
    below = root_levels(edges, True).select(F.col("node").alias("synset_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path")
    known = table(spark, d, "synsets").select("synset_id").where("synset_id is not null").distinct()
    led = edges.select(F.col("child").alias("synset_id"), F.lit(True).alias("led")).distinct()
    top = F.col("led").isNull()
    rest = known.join(below.select("synset_id").distinct(), "synset_id", "left_anti").join(led, "synset_id", "left")
    alone = rest.select("synset_id", F.when(top, F.col("synset_id")).alias("root_id"), F.when(top, 0).alias("depth"), F.when(top, F.col("synset_id").cast("string")).alias("path"))
    return below.unionByName(alone)


_P5_EDGES = """
    e as (select distinct child_id as c, parent_id as p from synset_relations
          where relation_type = 11 and child_id in (select synset_id from synsets) and parent_id in (select synset_id from synsets))"""
P5_SQL = {
    "p5_found": f"""with recursive {_P5_EDGES}, up as (select c as node, p as anc from e union select up.node, e.p from up join e on up.anc = e.c)
        select node as synset_id, 'root' as kind, anc as other_id from up where anc not in (select c from e)
        union all select a.node, 'cycle', min(a.anc) from up a join up b on a.node = b.anc and a.anc = b.node group by a.node""",
    # breadth first: a pair that is there already is not taken up again, so the depth needs no bound
    "p5_hyponyms": f"""with recursive {_P5_EDGES}, up(node, anc, d) using key (node, anc) as (select c, p, 1 from e
        union select up.node, e.p, min(d) + 1 from up join e on up.anc = e.c where not exists (select 1 from recurring.up r where r.node = up.node and r.anc = e.p) group by 1, 2)
        select anc as synset_id, node as hyponym_id, d::int as levels from up""",
    "p5_paths": f"""with recursive {_P5_EDGES}, s as (select distinct synset_id as id from synsets where synset_id is not null),
        t(node, root, d, path) using key (node, root) as (select id, id, 0, id::varchar from s where id not in (select c from e)
        union select e.c, t.root, min(d) + 1, arg_min(t.path, t.node) || '/' || e.c from t join e on e.p = t.node where not exists (select 1 from recurring.t r where r.node = e.c and r.root = t.root) group by 1, 2)
        select node as synset_id, root as root_id, d::int as depth, path from t union all select id, null, null, null from s where id not in (select node from t)""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_words, p1_arguments, p1_chunks, p1_chunk_words, p4_found, p4_predicate_stats, p5_found, p5_hyponyms, p5_paths)}
SQL = P1_SQL | P4_SQL | P5_SQL
