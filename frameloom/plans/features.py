"""Queries of the token, feature and class operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.functions.attachment import AUX_BARRIERS, AUXILIARIES, COORDINATORS
from frameloom.functions.labeling import NONCH
from frameloom.functions.slots import QUESTION_WORDS
from frameloom.operators import corpus as C
from frameloom.operators import frames as V
from frameloom.operators import statistics as S
from frameloom.operators import tokens as K
from frameloom.operators.hierarchy import ancestor_pairs
from frameloom.plans.general import synset_edges
from frameloom.plans.corpus import CAND, CASE, FRAMES, MATCH, OCC, SLOTS, SR, TOK, VERB, _frames, _sr, _tokens
from frameloom.runtime import cut, table, task_count

QUERIES: dict = {}
SQL: dict = {}
W = "window w as (partition by sent_id order by word_no)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


_PREDS = f"""{TOK}, v as (select *, {VERB} as verb, row_number() over w - 1 as ix from tok {W}),
    p as (select *, verb and not (coalesce(orth in {_in(AUXILIARIES)}, false) and ((ix > 1 and coalesce(lag(verb) over w, false)) or coalesce(lead(verb) over w, false)
      or (ix > 2 and coalesce(lag(verb, 2) over w, false) and not coalesce(lag(base) over w in {_in(AUX_BARRIERS)}, false)) or (coalesce(lead(verb, 2) over w, false) and not coalesce(lead(base) over w in {_in(AUX_BARRIERS)}, false)))) as is_predicate from v {W})"""


@query(f"""with {TOK}, n as (select *, row_number() over (partition by sent_id order by word_no) as r, {VERB} or label is null as stop from tok),
    j as (select a.sent_id, a.word_no, a.r, least(a.r + 6, coalesce(min(b.r) filter (b.stop), a.r + 6)) as to_ from n a left join n b on b.sent_id = a.sent_id and b.r between a.r + 1 and a.r + 5 where a.base = 'jako' and a.label is null group by 1, 2, 3),
    x as (select j.sent_id, j.word_no, coalesce(bool_or(starts_with(b.ctag, 'adj')) filter (b.r < to_), false) as adj, coalesce(bool_or(starts_with(b.ctag, 'subst')) filter (b.r < to_), false) as noun,
                 coalesce(bool_or(b.label in ('subj', 'np(mian)', 'np(bier)', 'np(dop)')) filter (b.r = to_), false) as stopper from j left join n b on b.sent_id = j.sent_id and b.r between j.r + 1 and to_ group by 1, 2)
    select sent_id, word_no, case when adj and not noun and not stopper then 'prepadjp(jako,str)' else 'prepnp(jako,str)' end as added from x""")
def o106_jako(spark, d):
    """Labels of the unlabelled ``jako``."""
    return K.jako_fillers(_tokens(spark, d))


@query(f"with {_PREDS} select sent_id, word_no, base from p where is_predicate")
def o90_predicates(spark, d):
    return K.mark_predicates(_tokens(spark, d)).where("is_predicate").select("sent_id", "word_no", "base")


@query(f"""with {_PREDS}, c as (select *, case when coalesce(base in {_in(COORDINATORS)}, false) or coalesce(split_part(ctag, ':', 1) = 'interp', false) then 2 + 4 * (coalesce(lead(verb) over w, false) or coalesce(lead(verb, 2) over w, false))::int
      else (label is not null)::int end as cost from p {W}), s as (select *, sum(cost) over w as upto from c {W}),
    a as (select a.sent_id, a.word_no, a.label, b.word_no as p, case when b.word_no < a.word_no then a.upto - a.cost - b.upto else b.upto - b.cost - a.upto end as dist,
            row_number() over (partition by a.sent_id, a.word_no, b.word_no < a.word_no order by abs(a.word_no - b.word_no)) as r
          from s a join s b on a.sent_id = b.sent_id and a.word_no <> b.word_no and b.is_predicate and not (a.label like 'subj%' and coalesce(b.label, '') like 'infp%') where a.label is not null),
    n as (select sent_id, word_no, min(dist) as d, count(*) as sides, count(distinct dist) as kinds, min_by(p, dist) as p from a where r = 1 group by 1, 2)
    select s.sent_id, s.word_no, s.label, case when n.sides = 2 and n.kinds = 1 then null else n.p end as predicate from s left join n on n.sent_id = s.sent_id and n.word_no = s.word_no where s.label is not null""")
def o92_nearest_by_argument(spark, d):
    return K.nearest_by_argument(_tokens(spark, d))


def _tag(i):
    return f"coalesce(lag(ctag, {i}) over w, '')"


def _starts(i, *kinds):
    return "(" + " or ".join(f"starts_with({_tag(i)}, '{k}')" for k in kinds) + ")"


def _pass(kinds, gen):
    out = []
    for i in range(1, 6):
        before = " and ".join([_starts(j, "subst", "psubst", "adj", "padj", "ppron", "depr") for j in range(1, i)] or ["true"])
        out.append(f"when {before} and {_starts(i, *kinds)}{'' if gen else f' and not contains({_tag(i)}, chr(58) || chr(103) || chr(101) || chr(110))'} then lag(word_no, {i}) over w")
    return "case " + " ".join(out) + " end"


_GOVERNING = f"""gov as (select sent_id, word_no, noun_no from (select sent_id, word_no, ctag, coalesce({_pass(('subst',), False)}, {_pass(('subst', 'ppron', 'depr'), False)}, {_pass(('subst',), True)}, {_pass(('subst', 'ppron', 'depr'), True)}) as noun_no from tok {W})
    where starts_with(coalesce(ctag, ''), 'prep'))"""


@query(f"with {TOK}, {_GOVERNING} select sent_id, word_no, noun_no from gov")
def o89_governing_noun(spark, d):
    return K.governing_noun(_tokens(spark, d))


@query(f"""with {TOK}, h as (select distinct sent_id, syntactic_head as word_no from nkjp_groups where syntactic_head is not null)
    select tok.sent_id, tok.word_no, h.word_no is not null as is_head from tok left join h on h.sent_id = tok.sent_id and h.word_no = tok.word_no""")
def o84_chunk_heads(spark, d):
    """Column 5 of the labeller's features: whether the token heads a phrase group."""
    return K.chunk_heads(_tokens(spark, d), table(spark, d, "nkjp_groups")).select("sent_id", "word_no", "is_head")


@query(f"""with {_PREDS}, {_GOVERNING}, n as (select *, last_value(case when is_predicate then word_no end ignore nulls) over (partition by sent_id order by word_no rows between unbounded preceding and 1 preceding) as l,
      first_value(case when is_predicate then word_no end ignore nulls) over (partition by sent_id order by word_no rows between 1 following and unbounded following) as r from p),
    k as (select n.sent_id, n.word_no, v.base as verb, m.base as noun, n.base as prep, case when len(string_split(n.ctag, ':')) > 1 then string_split(n.ctag, ':')[2] else '' end as case_, n.predicate_no = v.word_no as to_verb
          from n join tok v on v.sent_id = n.sent_id and v.word_no = case when l is null or r - n.word_no <= n.word_no - l then r else l end
          join gov on gov.sent_id = n.sent_id and gov.word_no = n.word_no join tok m on m.sent_id = n.sent_id and m.word_no = gov.noun_no where v.base is not null and m.base is not null and n.base is not null),
    st as (select verb, noun, prep, case_, avg(to_verb::int) as verb_p from k where to_verb is not null group by 1, 2, 3, 4)
    select sent_id, word_no, case when verb_p < 0.5 and 1 - verb_p >= 0.01 then 'noun' else '_' end as pp from k left join st using (verb, noun, prep, case_)""")
def o86_pp_attachment_noun(spark, d):
    """Column 7 of the labeller's features, with the attachment table made from the corpus."""
    keys = cut(K.preposition_keys(_tokens(spark, d)))
    return K.pp_attachment_noun(keys, K.attachment_statistics(keys))


@query(f"""with {_PREDS}, n as (select sent_id, word_no, ctag, last_value(case when is_predicate then word_no end ignore nulls) over (partition by sent_id order by word_no rows between unbounded preceding and 1 preceding) as l,
      first_value(case when is_predicate then word_no end ignore nulls) over (partition by sent_id order by word_no rows between 1 following and unbounded following) as r from p),
    m as (select n.*, t.ctag as other from n left join tok t on t.sent_id = n.sent_id and t.word_no = case when l is null or r - n.word_no <= n.word_no - l then r else l end)
    select sent_id, word_no, case when string_split(ctag, ':')[2] = string_split(other, ':')[2] then string_split(ctag, ':')[2] else '_' end as number_match from m""")
def o85_number_match(spark, d):
    return K.number_match(_tokens(spark, d))


@query(f"""with {TOK}, n as (select *, coalesce(lead(base) over w, '') as nx from tok {W})
    select sent_id, word_no, 'sentp(pz)' as added from n where label is null and (coalesce(lower(base) in {_in(QUESTION_WORDS)}, false) or coalesce(lower(orth) in {_in(QUESTION_WORDS)}, false)) and nx not in ('i', 'również')
    union all select sent_id, word_no, 'nonch' from n where label is null and (coalesce(base in {_in(NONCH)}, false) or (base = 'to' and nx = 'samo'))
    union all select sent_id, word_no, 'refl' from n where lower(orth) = 'siebie'""")
def o105_fillers(spark, d):
    return K.fillers(_tokens(spark, d))


@query(f"""with {TOK}, f as (select *, coalesce(coalesce(split_part(ctag, ':', 1), '') <> lag(coalesce(split_part(ctag, ':', 1), '')) over w, true)::int as ch from tok {W}), g as (select *, sum(ch) over w as run from f {W})
    select sent_id, min(word_no) as start, count(*) as length, min(coalesce(split_part(ctag, ':', 1), '')) as value from g group by sent_id, run""")
def o133_runs(spark, d):
    return K.runs(_tokens(spark, d), L.pos(F.col("ctag")))


@query(f"""with {TOK}, g as (select distinct sent_id, group_no, group_type, arg_type, syntactic_head, semantic_head from nkjp_groups)
    select g.sent_id, g.group_no, s.base as syntactic_base, m.base as semantic_base from g join tok s on s.sent_id = g.sent_id and s.word_no = g.syntactic_head join tok m on m.sent_id = g.sent_id and m.word_no = g.semantic_head""")
def o50_group_heads(spark, d):
    """Groups joined onto the tokens of their sentence: lemmas of both heads."""
    g = table(spark, d, "nkjp_groups").distinct()
    t = _tokens(spark, d).select("sent_id", "word_no", "base")
    s = t.select("sent_id", F.col("word_no").alias("syntactic_head"), F.col("base").alias("syntactic_base"))
    m = t.select("sent_id", F.col("word_no").alias("semantic_head"), F.col("base").alias("semantic_base"))
    return g.join(s, ["sent_id", "syntactic_head"]).join(m, ["sent_id", "semantic_head"]).select("sent_id", "group_no", "syntactic_base", "semantic_base")


@query("""with a as (select sent_id, row_number() over (order by sent_id) as r from (select distinct sent_id from sentences)), b as (select synset_id, row_number() over (order by synset_id) as r from (select distinct synset_id from synsets))
    select sent_id, synset_id from a join b using (r)""")
def o51_positional_zip(spark, d):
    """Two tables zipped by position: both numbered in order without a single task, then an equi join."""
    a = C.global_index(table(spark, d, "sentences").select("sent_id").distinct(), ["sent_id"])
    b = C.global_index(table(spark, d, "synsets").select("synset_id").distinct(), ["synset_id"])
    return a.join(b, "index").select("sent_id", "synset_id")


@query(f"""with {OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH},
    cnt as (select predicate, aspect, has_sie, labels, frame_id, count(slot) as n_matched, count(label) as n_labels from mat group by all)
    select oc.sent_id, oc.predicate_no, c.frame_id, n_labels, n_matched, len(f.arguments) as n_slots, oc.has_sie, coalesce(n.neg, false) as is_negated
    from cnt c join oc on oc.predicate = c.predicate and oc.aspect = c.aspect and oc.has_sie = c.has_sie and oc.labels = c.labels join fr f on f.frame_id = c.frame_id
    left join (select sent_id, word_no + 1 as predicate_no, bool_or(base = 'nie') as neg from tok group by 1, 2) n on n.sent_id = oc.sent_id and n.predicate_no = oc.predicate_no""")
def o136_frame_features(spark, d):
    """Feature rows of (occurrence, candidate frame): labels, matches, slots, się, negation right before."""
    t, frames = _tokens(spark, d), _frames(spark, d)
    cases = V.occurrence_cases(C.occurrences(t), C.arguments(t)).where("predicate is not null")
    keys = ["predicate", "aspect", "has_sie", "labels"]
    counts = V.matched_slots(cases, frames).groupBy(*keys, "frame_id").agg(F.count("slot").alias("n_matched"), F.count("label").alias("n_labels"))
    size = frames.select("frame_id", F.size("arguments").cast("long").alias("n_slots")).withColumn("n_slots", F.when(F.col("n_slots") >= 0, F.col("n_slots")))
    neg = t.select("sent_id", (F.col("word_no") + 1).alias("predicate_no"), (F.col("base") == "nie").alias("neg"))
    rows = cases.join(counts, keys).join(size, "frame_id").join(neg, ["sent_id", "predicate_no"], "left")
    return rows.select("sent_id", "predicate_no", "frame_id", "n_labels", "n_matched", "n_slots", "has_sie", F.coalesce("neg", F.lit(False)).alias("is_negated"))


@query(f"""with {OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH},
    sr as (select lower(o.predicate) as predicate, label as slot, a.base as head from arg a join occ o on o.sent_id = a.sent_id and o.predicate_no = a.predicate_no where o.predicate is not null and a.base is not null),
    c as (select predicate, slot, head, count(*) as n from sr group by 1, 2, 3), ps as (select predicate, slot, sum(n) as n_ps from c group by 1, 2), hs as (select slot, head, sum(n) as n_h from c group by 1, 2), s as (select slot, sum(n) as n_s from c group by 1),
    ass as (select predicate, slot, head, (n / n_ps) * ln((n / n_ps) / (n_h / n_s)) as association from c join ps using (predicate, slot) join hs using (slot, head) join s using (slot)),
    fsl as (select frame_id, unnest(range(len(arguments)))::int as slot from fr),
    x as (select distinct predicate, aspect, has_sie, labels, frame_id from mat)
    select oc.sent_id, oc.predicate_no, x.frame_id, fsl.slot, (count(a.word_no) > 0)::int as has_, count(a.word_no) as n_, round(max(ass.association), 6) as selassoc_
    from oc join x on oc.predicate = x.predicate and oc.aspect = x.aspect and oc.has_sie = x.has_sie and oc.labels = x.labels join fsl on fsl.frame_id = x.frame_id
    left join mat m on m.predicate = x.predicate and m.aspect = x.aspect and m.has_sie = x.has_sie and m.labels = x.labels and m.frame_id = x.frame_id and m.slot = fsl.slot
    left join arg a on a.sent_id = oc.sent_id and a.predicate_no = oc.predicate_no and a.label = m.label left join ass on ass.predicate = oc.predicate and ass.slot = a.label and ass.head = a.base group by 1, 2, 3, 4""")
def o136_slot_features(spark, d):
    """Feature rows per slot of (occurrence, candidate frame): whether and how often it is met, and the largest selectional association of the heads in it (null without any)."""
    t = _tokens(spark, d)
    return slot_features(cut(C.arguments(t)), cut(C.occurrences(t)), _frames(spark, d))


#: Parts into which the slots of a predicate's frames are dealt, so that many tasks share a frequent predicate.
PARTS = 64


def slot_features(args, occurrences, frames):
    """The rows of ``o136_slot_features``.

    Slots that take the same set of labels are one kind, and an occurrence has a number and an association for each kind that it meets. The pairs of occurrences
    and slots, which are as many as rows come out, are made by the last join and never move."""
    at = ["sent_id", "predicate_no", "frame_id", "slot"]
    verbs = occurrences.where("predicate is not null").withColumn("predicate", F.lower("predicate"))
    sr = args.join(verbs.select("sent_id", "predicate_no", "predicate"), ["sent_id", "predicate_no"])
    known = S.selectional_association(sr, "predicate", "label", "base").select("predicate", "label", "base", "association")
    labels = V.label_slots(args.select("label").distinct(), frames)
    kinds = labels.groupBy("frame_id", "slot").agg(F.to_json(F.array_sort(F.collect_set("label"))).alias("kind"))
    known_frames = frames.where("predicate is not null and size(arguments) > 0")
    slots = known_frames.select("frame_id", F.col("predicate").alias("f_predicate"), F.col("aspect").alias("f_aspect"), "has_refl", F.explode(F.sequence(F.lit(0), F.size("arguments") - 1)).alias("slot")).join(kinds, ["frame_id", "slot"], "left")
    slots = slots.withColumn("part", F.pmod(F.xxhash64("frame_id"), F.lit(PARTS)))
    parts = known_frames.select(F.col("predicate").alias("f_predicate"), F.pmod(F.xxhash64("frame_id"), F.lit(PARTS)).alias("part")).distinct()

    cases = verbs.groupBy("sent_id", "predicate_no", "predicate", "aspect", "has_sie").agg(F.count(F.lit(1)).alias("times"))
    cases = cut(V.frame_keys(cases).join(parts.groupBy("f_predicate").agg(F.collect_list("part").alias("parts")), "f_predicate"))
    occurrence = ["sent_id", "predicate_no", "predicate"]
    per = args.select("sent_id", "predicate_no", "label", "base", "word_no").join(cases.select(*occurrence).distinct(), ["sent_id", "predicate_no"]).join(known, ["predicate", "label", "base"], "left")
    per = per.groupBy(*occurrence, "label").agg(F.count("word_no").alias("n"), F.max("association").alias("association"))
    of = kinds.select("kind").distinct().select("kind", F.explode(F.from_json("kind", "array<string>")).alias("label"))
    met = per.join(of, "label").groupBy(*occurrence, "kind").agg(F.sum("n").alias("n"), F.max("association").alias("association"))
    met = met.groupBy(*occurrence).agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "association")))).alias("met"))
    # a position that is there twice, with another lemma or aspect, may meet a frame twice
    readings = F.size(F.collect_set(F.struct("predicate", "aspect")).over(Window.partitionBy("sent_id", "predicate_no")))
    cases = cut(cases.withColumn("readings", readings).join(met, occurrence, "left"))

    n = 4 * task_count(cases)
    slots = slots.repartition(n, "f_predicate", "part")  # by number: adaptive execution would coalesce what is small before the join and large after it

    def rows(some):
        some = some.withColumn("part", F.explode("parts")).drop("parts").repartition(n, "f_predicate", "part")
        pairs = some.join(slots, ["f_predicate", "part"]).where("(f_aspect = aspect or f_aspect = '_') and (not needs_refl or has_refl)")
        hit = F.col("met")[F.col("kind")]
        return pairs.select(*at, F.coalesce(hit["n"] * F.col("times"), F.lit(0)).alias("n_"), hit["association"].alias("selassoc_"))

    several = rows(cases.where("readings > 1")).groupBy(*at).agg(F.sum("n_").alias("n_"), F.max("selassoc_").alias("selassoc_"))
    every = rows(cases.where("readings = 1")).unionByName(several)
    return every.select(*at, (F.col("n_") > 0).cast("int").alias("has_"), "n_", F.round("selassoc_", 6).alias("selassoc_"))


@query("""with c as (select lang, count(*) as n from documents where lang is not null group by 1), i as (select lang, row_number() over (order by n desc, lang) - 1 as idx from c)
    select doc_id, coalesce(idx, -1)::int as lang_index, coalesce((idx = 0)::int, 0) as top_0, coalesce((idx = 1)::int, 0) as top_1, coalesce((idx = 2)::int, 0) as top_2 from documents d left join i using (lang)""")
def o141_encoders(spark, d):
    """Language of each document as an index by frequency and as flags of the three most frequent."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    x = docs.join(K.category_index(docs, "lang").select("lang", "index"), "lang", "left").withColumn("index", F.coalesce("index", F.lit(-1)))
    return x.select("doc_id", F.col("index").cast("int").alias("lang_index"), *[(F.col("index") == i).cast("int").alias(f"top_{i}") for i in range(3)])


@query("""with recursive e as (select distinct child_id as c, parent_id as p from synset_relations where relation_type = 11 and child_id in (select synset_id from synsets) and parent_id in (select synset_id from synsets)),
    up as (select c as node, p as anc from e union select up.node, e.p from up join e on up.anc = e.c),
    un as (select distinct synset_id, unnest(lex_units) as unit from synsets), w as (select unit, count(*) as w from un where unit is not null group by 1), own as (select synset_id, sum(1.0 / w) as own from un join w using (unit) group by 1)
    select synset_id, round(sum(own), 4) as mass from (select synset_id, own from own union all select anc, own from own join up on up.node = own.synset_id where node <> anc) group by 1""")
def o124_split_sums(spark, d):
    """Mass of every synset when each unit counts once, split over its synsets and summed up the hierarchy."""
    synsets = table(spark, d, "synsets")
    pairs = ancestor_pairs(synset_edges(spark, d))
    units = synsets.select("synset_id", F.explode("lex_units").alias("unit")).where("unit is not null").distinct().withColumn("n", F.lit(1))
    return K.split_sums(units, pairs).select("synset_id", F.round("mass", 4).alias("mass"))


@query(f"""with {SR}, c as (select predicate, slot, head, count(*) as n from sr where head is not null group by 1, 2, 3), ps as (select predicate, slot, sum(n) as n_ps from c group by 1, 2), hs as (select slot, head, sum(n) as n_h from c group by 1, 2), s as (select slot, sum(n) as n_s from c group by 1),
    a as (select slot, round((n / n_ps) * ln((n / n_ps) / (n_h / n_s)), 6) as x from c join ps using (predicate, slot) join hs using (slot, head) join s using (slot)), v as (select slot, list_sort(list(distinct x)) as v from a group by 1)
    select slot, v[1 + (10 * len(v)) // 100] as low, v[1 + (90 * len(v)) // 100] as high from v""")
def o77_association_bounds(spark, d):
    """Percentile bounds of selectional associations per slot, as the one-class chooser uses them."""
    a = S.selectional_association(_sr(spark, d), "predicate", "slot", "head").select("slot", F.round("association", 6).alias("x"))
    return S.percentile_bounds(a, "slot", "x", (10, 90)).select("slot", F.col("p10").alias("low"), F.col("p90").alias("high"))


@query(f"""with {TOK} select sent_id, count(*) filter (label is not null) as n_args, bool_and(label is null or predicate_no is not null) as all_attached, count(*) filter (label is not null and predicate_no = word_no) as self_attached from tok group by 1""")
def o80_sentence_totals(spark, d):
    """What the accumulators of a corpus run count, per sentence."""
    t = _tokens(spark, d)
    return t.groupBy("sent_id").agg(F.count("label").alias("n_args"), F.bool_and(F.col("label").isNull() | F.col("predicate_no").isNotNull()).alias("all_attached"), F.count_if(F.coalesce(F.col("label").isNotNull() & (F.col("predicate_no") == F.col("word_no")), F.lit(False))).alias("self_attached"))
