"""Queries of the corpus, frame, statistics and evaluation operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import attachment as E
from frameloom.functions import labels as L
from frameloom.operators import annotate as A
from frameloom.operators import corpus as C
from frameloom.operators import frames as V
from frameloom.operators import models as M
from frameloom.operators import search as X
from frameloom.operators import statistics as S
from frameloom.operators import tokens as K
from frameloom.operators.hierarchy import root_levels
from frameloom.plans.general import synset_edges
from frameloom.runtime import cut, table, tidy

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.tokens_once(table(spark, d, "tokens"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return V.frames_once(table(spark, d, "frames"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Classifier decisions, each once."""
    return table(spark, d, "pred_results").where("result_id is not null").select("result_id", "sent_id", tidy(F.col("predicate")).alias("predicate"), "classifier", F.col("result_value").cast("double").alias("value")).distinct()


TOK = "tok as (select distinct sent_id, word_no, orth, base, ctag, nullif(argument_type, '') as label, predicate_no from tokens)"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
VERB = f"coalesce(split_part(ctag, ':', 1) in {_IN(L.VERB_POS)}, false)"
TIDY = r"nullif(lower(regexp_replace(predicate, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"
RES = f"res as (select distinct result_id, sent_id, {TIDY} as predicate, classifier, result_value::double as value from pred_results where result_id is not null)"
ASPECT = "case when coalesce(ctag, '') like '%imperf%' then 'imperf' else 'perf' end"
OCC = f"""{TOK},
    arg as (select sent_id, word_no, base, ctag, label, coalesce(predicate_no, -1) as predicate_no from tok where label is not null),
    occ as (select a.sent_id, a.predicate_no, n_args, has_sie, base as predicate, {ASPECT} as aspect
            from (select sent_id, predicate_no, count(*) as n_args, bool_or(label = 'sie') as has_sie from arg where predicate_no >= 0 group by 1, 2) a
            join tok t on t.sent_id = a.sent_id and t.word_no = a.predicate_no)"""
FRAMES = rf"""fr as (select distinct on (frame_id) frame_id, {TIDY} as predicate, coalesce(aspect, '_') as aspect, frame_text, arguments,
                 trim(regexp_extract(frame_text, '^[^:]*:[^:]*:[^:]*:[^:]*:[^:]*:(.*)$', 1)) as body,
                 coalesce(list_contains(flatten(list_transform(arguments, lambda x: x.realizations)), 'refl'), false) as has_refl
               from frames where frame_id is not null and coalesce(frame_text, '') not like '%{{or}}%')"""
CAND = """cas as (select distinct lower(predicate) as predicate, aspect, has_sie from occ where predicate is not null),
    cand as (select distinct c.predicate, c.aspect, c.has_sie, f.frame_id from cas c join fr f on (f.aspect = c.aspect or f.aspect = '_')
             and ((f.predicate = c.predicate and (not c.has_sie or f.has_refl)) or (c.has_sie and f.predicate = c.predicate || ' się')))"""


# --- filters and expansions -------------------------------------------------------------------------------------


@query(f"with {TOK} select sent_id, count(*) as n_words from tok group by 1 having count(*) between 1 and 100")
def o36_sentence_filter(spark, d):
    return _tokens(spark, d).groupBy("sent_id").agg(F.count(F.lit(1)).alias("n_words")).where("n_words between 1 and 100")


@query(f"with {OCC} select sent_id, predicate_no, predicate, aspect, has_sie, n_args from occ")
def o37_occurrences(spark, d):
    return C.occurrences(_tokens(spark, d)).select("sent_id", "predicate_no", "predicate", "aspect", "has_sie", "n_args")


@query(f"""with {OCC},
    b as (select sent_id, predicate_no as p, coalesce(lag(predicate_no) over w, 0) as low, lead(predicate_no) over w as high
          from (select distinct sent_id, predicate_no from arg where predicate_no >= 0) window w as (partition by sent_id order by predicate_no))
    select b.sent_id, p as predicate_no, word_no, label, predicate_no = p as own from b join arg using (sent_id)
    where predicate_no = p or (word_no >= low and (high is null or word_no <= high))""")
def o38_extended_arguments(spark, d):
    return C.extended_arguments(_tokens(spark, d))


@query(f"with {OCC} select sent_id, word_no, label, predicate_no from arg")
def o39_arguments_with_unattached(spark, d):
    return C.arguments(_tokens(spark, d)).select("sent_id", "word_no", "label", "predicate_no")


@query("""with w as (select distinct sent_id, i::int as no, words[i + 1] as w from (select sent_id, words, unnest(range(len(words))) as i from sentences) where words[i + 1] is not null),
    a as (select sent_id, b.syntactic_head as no, min(b.argument_type) as argument_type, min(p) as predicate
          from (select sent_id, a.pred.left_ix as p, unnest(a.args) as b from (select sent_id, unnest(argument_structures) as a from sentences)) where b.argument_type is not null group by 1, 2)
    select w.sent_id, w.no, w.w.orth as orth, w.w.base as base, w.w.ctag as ctag, coalesce(argument_type, '_') as argument_type, coalesce(predicate, -1) as predicate from w left join a on a.sent_id = w.sent_id and a.no = w.no""")
def o40_token_rows(spark, d):
    s = table(spark, d, "sentences")
    words = s.select("sent_id", F.posexplode("words").alias("no", "w")).where("w is not null").select("sent_id", "no", "w.orth", "w.base", "w.ctag", "w.nps").distinct().drop("nps")
    heads = s.select("sent_id", F.explode("argument_structures").alias("a")).select("sent_id", F.col("a.pred.left_ix").alias("p"), F.explode("a.args").alias("b")).where("b.argument_type is not null")
    args = heads.groupBy("sent_id", F.col("b.syntactic_head").alias("no")).agg(F.min("b.argument_type").alias("argument_type"), F.min("p").alias("predicate"))
    return words.join(args, ["sent_id", "no"], "left").select("sent_id", "no", "orth", "base", "ctag", F.coalesce("argument_type", F.lit("_")).alias("argument_type"), F.coalesce("predicate", F.lit(-1)).alias("predicate"))


@query(r"select distinct frame_id, status, frame_text from frames where coalesce(frame_text, '{or}') not like '%{or}%' and coalesce(status, '') <> 'wątpliwy' and arguments is not null")
def o41_gold_cleanup(spark, d):
    """Frames fit as gold: without ``{or}``, not doubtful, with arguments."""
    f = table(spark, d, "frames").where("frame_text is not null and arguments is not null and coalesce(status, '') <> 'wątpliwy'")
    return f.where(~F.contains("frame_text", F.lit("{or}"))).select("frame_id", "status", "frame_text").distinct()


@query(f"""with {TOK}, {RES}, k as (select distinct sent_id, predicate from res where predicate is not null)
    select k.sent_id, k.predicate, min(word_no) as word_no from k join tok on tok.sent_id = k.sent_id and tok.base = k.predicate group by 1, 2""")
def o42_predicate_locator(spark, d):
    keys = _results(spark, d).where("predicate is not null").select("sent_id", "predicate").distinct()
    return keys.join(_tokens(spark, d).withColumnRenamed("base", "predicate"), ["sent_id", "predicate"]).groupBy("sent_id", "predicate").agg(F.min("word_no").alias("word_no"))


@query(f"""with {TOK}, {RES}, k as (select sent_id, predicate from res where predicate is not null)
    select count(*) as n, count(*) filter (exists (select 1 from tok where tok.sent_id = k.sent_id and tok.base = k.predicate)) as n_located from k""")
def o42_predicate_errors(spark, d):
    keys = _results(spark, d).where("predicate is not null")
    found = o42_predicate_locator(spark, d).withColumn("located", F.lit(1))
    return keys.join(found, ["sent_id", "predicate"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("located").alias("n_located"))


@query(f"""with {TOK} select coalesce(split_part(ctag, ':', 1), '') as pos, {ASPECT} as aspect,
    case when ctag like '%imperf%' then 'imperf' when ctag like '%perf%' then 'perf' else '_' end as dictionary_aspect, count(*) as n from tok where {VERB} group by 1, 2, 3""")
def o43_aspects(spark, d):
    t = _tokens(spark, d).where(L.is_verb(F.col("ctag")))
    return t.groupBy(L.pos(F.col("ctag")).alias("pos"), L.aspect_of(F.col("ctag")).alias("aspect"), L.dictionary_aspect(F.col("ctag")).alias("dictionary_aspect")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from documents where md5(doc_id::varchar) < '4'")
def o44_sample(spark, d):
    """A quarter of the documents, drawn by a hash and so the same on every run."""
    return table(spark, d, "documents").where(F.md5(F.col("doc_id").cast("string")) < "4").select("doc_id")


@query(f"with {TOK}, s as (select sent_id, row_number() over (order by sent_id) as r, count(*) over () as n from (select distinct sent_id from tok)) select sent_id, case when r <= floor(0.3 * n) then 'validation' else 'test' end as part from s")
def o45_split(spark, d):
    s = C.global_index(_tokens(spark, d).select("sent_id").distinct(), ["sent_id"])
    n = s.count()
    return s.select("sent_id", F.when(F.col("index") < int(0.3 * n + 1e-9), "validation").otherwise("test").alias("part"))


_FOLDED = "lower(regexp_replace({}, '[^A-Za-z]', '', 'g'))"


@query(f"""with {TOK}, {RES}, a as (select distinct base as term from tok where base is not null), b as (select distinct predicate as term from res where predicate is not null)
    select a.term as base, b.term as predicate from a join b on {_FOLDED.format('a.term')} = {_FOLDED.format('b.term')} and len(a.term) = len(b.term) where {_FOLDED.format('a.term')} <> ''""")
def o53_normalised_join(spark, d):
    """Join on a normalised text key, kept where both sides are equally long (O-46, O-53)."""
    fold = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    bases = _tokens(spark, d).select("base").where("base is not null").distinct().withColumn("k", fold("base")).where("k <> ''")
    predicates = _results(spark, d).select("predicate").where("predicate is not null").distinct().withColumn("k", fold("predicate"))
    return bases.join(predicates, "k").where("length(base) = length(predicate)").select("base", "predicate")


# --- joins ------------------------------------------------------------------------------------------------------


@query(f"with {OCC}, {FRAMES}, {CAND} select predicate, aspect, has_sie, frame_id from cand")
def o47_frames_for(spark, d):
    cases = C.occurrences(_tokens(spark, d)).where("predicate is not null").select(F.lower("predicate").alias("predicate"), "aspect", "has_sie").distinct()
    return V.frames_for(cases, _frames(spark, d))


_PP = f"""{TOK}, prep as (select sent_id, word_no, base as prep, split_part(ctag, ':', 2) as case_, predicate_no from tok where split_part(ctag, ':', 1) = 'prep' and predicate_no is not null),
    pp as (select p.sent_id, p.word_no, v.base as verb, n.base as noun, prep, case_, {VERB.replace('ctag', 'v.ctag')} as to_verb from prep p join tok n on n.sent_id = p.sent_id and n.word_no = p.word_no + 1
           join tok v on v.sent_id = p.sent_id and v.word_no = p.predicate_no)"""


@query(f"""with {_PP}, stat as (select prep, case_, avg(to_verb::int) as verb_p from pp group by 1, 2)
    select sent_id, word_no, verb, noun, prep, case_, case when verb_p >= 0.5 and verb_p >= 0.01 then 'verb' else 'noun' end as decision from pp join stat using (prep, case_)""")
def o48_pp_attachment(spark, d):
    """Prepositions with verb, noun and case, and the side that the corpus attaches them to: aggregate, then probe."""
    t = _tokens(spark, d)
    prep = t.where(L.pos(F.col("ctag")) == "prep").where("predicate_no is not null").select("sent_id", "word_no", F.col("base").alias("prep"), F.coalesce(L.tag_part(F.col("ctag"), 1), F.lit("")).alias("case_"), "predicate_no")
    noun = t.select("sent_id", (F.col("word_no") - 1).alias("word_no"), F.col("base").alias("noun"))
    verb = t.select("sent_id", F.col("word_no").alias("predicate_no"), F.col("base").alias("verb"), L.is_verb(F.col("ctag")).cast("int").alias("to_verb"))
    pp = prep.join(noun, ["sent_id", "word_no"]).join(verb, ["sent_id", "predicate_no"])
    stat = pp.groupBy("prep", "case_").agg(F.avg("to_verb").alias("verb_p"))
    return pp.join(stat, ["prep", "case_"]).select("sent_id", "word_no", "verb", "noun", "prep", "case_", F.when(F.col("verb_p") >= 0.5, "verb").otherwise("noun").alias("decision"))


def _real_sql(label: str) -> str:
    cases = "case {} " + " ".join(f"when '{a}' then '{b}'" for a, b in L.CASES.items()) + " end"
    head, first, second = f"regexp_extract({label}, '^([a-z]+)', 1)", f"trim(regexp_extract({label}, '^[a-z]+\\(([^,)]*)', 1))", f"trim(regexp_extract({label}, '^[a-z]+\\([^,]*,([^,)]*)\\)', 1))"
    c1, c2 = cases.format(first), cases.format(second)
    prep = lambda c: f"{head} || '(' || {first} || ',' || {c} || ')'"
    po = f"case when {first} = 'po' and {head} = 'prepadjp' then ['prepadjp(po,postp)'] else []::varchar[] end"
    return f"""case when {label} = 'subj' then ['subj'] when {label} in ('sie', 'refl') then ['refl'] when {label} = 'nonch' then ['nonch']
        when {label} = 'advp' then ['xp(mod)', 'advp(misc)', 'advp(pron)']
        when {head} = 'np' and {c1} in ('acc', 'gen') then ['np(' || {c1} || ')', 'np(str)', 'np(part)'] when {head} = 'np' and {c1} is not null then ['np(' || {c1} || ')']
        when {head} = 'adjp' and {c1} in ('acc', 'gen') then ['adjp(' || {c1} || ')', 'adjp(str)', 'adjp(part)'] when {head} = 'adjp' and {c1} is not null then ['adjp(' || {c1} || ')', 'adjp(pred)']
        when {head} in ('prepnp', 'prepadjp') and ({c2} in ('acc', 'gen') or ({c2} = 'nom' and {first} = 'jako')) then list_concat([{prep(c2)}, {prep("'str'")}], {po})
        when {head} in ('prepnp', 'prepadjp') and {c2} is not null then list_concat([{prep(c2)}], {po})
        when {head} = 'sentp' and {first} = 'pz' then ['cp(int)', 'cp()', 'compar()'] when {head} = 'sentp' and {first} in ('że', 'żeby', 'iż') then ['cp(' || {first} || ')', 'cp(żeby2)']
        when {head} = 'sentp' then ['cp(' || {first} || ')']
        when {head} = 'infp' then [case {first} when 'dk' then 'infp(perf)' when 'nd' then 'infp(imperf)' else 'infp(unknown)' end, 'infp(_)'] else []::varchar[] end"""


SLOTS = """slo as (select frame_id, slot::int as slot, unnest(list_concat(list_filter(a.realizations, lambda r: not (r = 'np(str)' and coalesce(list_contains(a.modifiers, 'subj'), false))),
              case when coalesce(list_contains(a.modifiers, 'subj') and len(list_filter(a.realizations, lambda r: starts_with(r, 'np('))) > 0, false) then ['subj'] else []::varchar[] end)) as realization
            from (select frame_id, i as slot, arguments[i + 1] as a from (select frame_id, arguments, unnest(range(len(arguments))) as i from fr)))"""
CASE = """lab as (select sent_id, predicate_no, list_sort(list(distinct label)) as labels from arg where predicate_no >= 0 and label <> 'sie' group by 1, 2),
    oc as (select o.sent_id, o.predicate_no, lower(o.predicate) as predicate, o.aspect, o.has_sie, coalesce(l.labels, []) as labels from occ o left join lab l on l.sent_id = o.sent_id and l.predicate_no = o.predicate_no),
    ca as (select distinct predicate, aspect, has_sie, labels from oc)"""
MATCH = f"""wan as (select ca.predicate, ca.aspect, ca.has_sie, ca.labels, cand.frame_id, unnest(case when len(ca.labels) = 0 then [null] else ca.labels end) as label from ca join cand on cand.predicate = ca.predicate and cand.aspect = ca.aspect and cand.has_sie = ca.has_sie),
    mat as (select w.predicate, w.aspect, w.has_sie, w.labels, w.frame_id, w.label, min(s.slot) as slot from wan w left join slo s on s.frame_id = w.frame_id and list_contains({_real_sql('w.label')}, s.realization) group by all)"""


@query(f"with {OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH} select predicate, aspect, has_sie, array_to_string(labels, ' ') as labels, frame_id, label, slot from mat")
def o49_slot_match_first(spark, d):
    cases = V.occurrence_cases(C.occurrences(t := _tokens(spark, d)), C.arguments(t)).where("predicate is not null")
    return V.matched_slots(cases, _frames(spark, d)).withColumn("labels", F.array_join("labels", " "))


@query(f"select distinct t.label, r as realization from (select distinct nullif(argument_type, '') as label from tokens) t, unnest({_real_sql('t.label')}) as u(r)")
def o110_label_realizations(spark, d):
    labels = table(spark, d, "tokens").select(F.nullif("argument_type", F.lit("")).alias("label")).distinct()
    return labels.select("label", F.explode(L.realizations(F.col("label"), F.lit(""))).alias("realization")).distinct()


@query(f"""with {OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH},
    cnt as (select predicate, aspect, has_sie, labels, frame_id, count(slot) as n_matched from mat group by all),
    best as (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by n_matched desc, frame_id) as r, count(*) over (partition by predicate, aspect, has_sie, labels, n_matched) as same,
                    count(*) over (partition by predicate, aspect, has_sie, labels) as n_candidates from cnt)
    select oc.sent_id, oc.predicate_no, b.frame_id, b.n_matched, b.n_candidates from best b join oc on oc.predicate = b.predicate and oc.aspect = b.aspect and oc.has_sie = b.has_sie and oc.labels = b.labels
    where r = 1 and same = 1 and n_matched > 0""")
def o117_max_unique(spark, d):
    """Frame per occurrence with the single largest number of matched labels: chosen per case, then joined back."""
    cases = V.occurrence_cases(C.occurrences(t := _tokens(spark, d)), C.arguments(t)).where("predicate is not null")
    best = V.max_frames(cases, _frames(spark, d))
    return cases.join(best, ["predicate", "aspect", "has_sie", "labels"]).select("sent_id", "predicate_no", "frame_id", "n_matched", "n_candidates")


_SAME = lambda a, b: f"{a}.predicate = {b}.predicate and {a}.aspect = {b}.aspect and {a}.has_sie = {b}.has_sie and {a}.labels = {b}.labels"
PASS = f"""{OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH},
    sfl as (select frame_id, slot, bool_or(contains(realization, 'lex') or contains(realization, 'comprep')) as lex, bool_or(starts_with(realization, 'infp')) as inf from slo group by 1, 2),
    ffl as (select frame_id, bool_or(lex) as has_lex, bool_or(inf) as has_inf from sfl group by 1),
    met as (select m.predicate, m.aspect, m.has_sie, m.labels, m.frame_id, list_sort(list_distinct(list(m.label) filter (m.slot is not null))) as met, coalesce(bool_or(s.lex), false) as lex, coalesce(bool_or(s.inf), false) as inf
            from mat m left join sfl s on s.frame_id = m.frame_id and s.slot = m.slot group by 1, 2, 3, 4, 5),
    pas as (select m.predicate, m.aspect, m.has_sie, m.labels, m.frame_id, coalesce(met, []) as met from met m left join ffl f on f.frame_id = m.frame_id where (not coalesce(has_lex, false) or lex) and (not coalesce(has_inf, false) or inf))"""


@query(f"with {PASS} select oc.sent_id, oc.predicate_no, p.frame_id, len(met)::bigint as n_met from pas p join oc on {_SAME('oc', 'p')}")
def o120_passing_frames(spark, d):
    """Every candidate frame that passes the filters, for each occurrence."""
    cases = V.occurrence_cases(C.occurrences(t := _tokens(spark, d)), C.arguments(t)).where("predicate is not null")
    return cases.join(V.passing_frames(cases, _frames(spark, d)), ["predicate", "aspect", "has_sie", "labels"]).select("sent_id", "predicate_no", "frame_id", F.size("met").cast("bigint").alias("n_met"))


@query(f"""with recursive {PASS},
    num as (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by frame_id) as r from pas),
    step as (select distinct predicate, aspect, has_sie, labels, 0::bigint as r, null::bigint as frame_id, []::varchar[] as seen from num
             union all select n.predicate, n.aspect, n.has_sie, n.labels, n.r,
                    case when list_has_all(met, seen) and len(met) > len(seen) then n.frame_id when len(seen) = 0 or (list_has_all(seen, met) and len(seen) > len(met)) then s.frame_id end,
                    case when list_has_all(met, seen) and len(met) > len(seen) then met else seen end
             from step s join num n on {_SAME('s', 'n')} and n.r = s.r + 1),
    fin as (select * from step qualify row_number() over (partition by predicate, aspect, has_sie, labels order by r desc) = 1)
    select oc.sent_id, oc.predicate_no, f.frame_id, len(seen)::bigint as n_met from fin f join oc on {_SAME('oc', 'f')} where f.frame_id is not null""")
def o117_growing_set(spark, d):
    """Frame per occurrence by the scan for a growing set of met labels."""
    cases = V.occurrence_cases(C.occurrences(t := _tokens(spark, d)), C.arguments(t)).where("predicate is not null")
    return cases.join(V.growing_frames(cases, _frames(spark, d)), ["predicate", "aspect", "has_sie", "labels"]).select("sent_id", "predicate_no", "frame_id", "n_met")


@query(f"""with {OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH},
    cnt as (select predicate, aspect, has_sie, labels, frame_id, count(slot) as n from mat group by all),
    vot as (select a.predicate, a.aspect, a.has_sie, a.labels, a.frame_id, count(*) filter (a.n > b.n) as wins from cnt a join cnt b on a.predicate = b.predicate and a.aspect = b.aspect and a.has_sie = b.has_sie and a.labels = b.labels and a.frame_id <> b.frame_id group by 1, 2, 3, 4, 5),
    r as (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by wins desc, frame_id) as r, count(*) over (partition by predicate, aspect, has_sie, labels, wins) as same from vot)
    select predicate, aspect, has_sie, array_to_string(labels, ' ') as labels, frame_id, wins from r where r = 1 and same = 1""")
def o54_pairwise_votes(spark, d):
    """Wins of each candidate over the others of its case, the single best one. How many rivals a frame beats follows from the
    counts of candidates per score: no pairs are built."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    cases = V.occurrence_cases(C.occurrences(t := _tokens(spark, d)), C.arguments(t)).where("predicate is not null")
    counts = V.matched_slots(cases, _frames(spark, d)).groupBy(*keys, "frame_id").agg(F.count("slot").alias("n"))
    levels = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("m"), F.min("frame_id").alias("frame_id"))
    below = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    scored = levels.withColumn("wins", F.coalesce(F.sum("m").over(below), F.lit(0))).withColumn("all", F.sum("m").over(Window.partitionBy(*keys)))
    top = scored.withColumn("top", F.max("n").over(Window.partitionBy(*keys))).where("n = top and m = 1 and all > 1")
    return top.select("predicate", "aspect", "has_sie", F.array_join("labels", " ").alias("labels"), "frame_id", "wins")


@query(f"""with {FRAMES}, b as (select distinct predicate, body from fr where predicate is not null and body is not null), n as (select predicate, count(*) as n from b group by 1)
    select a.predicate, o.predicate as other, n as n_bodies from b a join b o on a.body = o.body and a.predicate <> o.predicate join n on n.predicate = a.predicate group by a.predicate, o.predicate, n having count(*) = n""")
def o55_frame_swappers(spark, d):
    return V.frame_swappers(_frames(spark, d))


@query(f"""with {TOK} select a.sent_id, a.word_no, min(b.word_no) as noun_no from tok a join tok b on a.sent_id = b.sent_id and b.word_no between a.word_no + 1 and a.word_no + 3
    where split_part(a.ctag, ':', 1) = 'prep' and split_part(b.ctag, ':', 1) = 'subst' group by 1, 2""")
def o56_nearby_noun(spark, d):
    """The first noun within three tokens right of a preposition: a band search over a window of three leads."""
    order = Window.partitionBy("sent_id").orderBy("word_no")
    at = F.when(L.pos(F.col("ctag")) == "subst", F.col("word_no"))
    marked = _tokens(spark, d).withColumn("noun_at", at)
    near = F.coalesce(*[F.when(F.lead("noun_at", i).over(order) <= F.col("word_no") + 3, F.lead("noun_at", i).over(order)) for i in (1, 2, 3)])
    return marked.select("sent_id", "word_no", "ctag", near.alias("noun_no")).where((L.pos(F.col("ctag")) == "prep") & F.col("noun_no").isNotNull()).select("sent_id", "word_no", "noun_no")


@query(f"""with {TOK}, n as (select sent_id, word_no, label,
      last_value(case when {VERB} then word_no end ignore nulls) over (partition by sent_id order by word_no rows between unbounded preceding and 1 preceding) as l,
      first_value(case when {VERB} then word_no end ignore nulls) over (partition by sent_id order by word_no rows between 1 following and unbounded following) as r from tok)
    select sent_id, word_no, label, case when l is null or r - word_no <= word_no - l then r else l end as nearest from n where label is not null""")
def o91_nearest_predicate(spark, d):
    return C.nearest_predicate(_tokens(spark, d))


@query(f"with {FRAMES}, x as (select frame_id, arguments from fr where arguments is not null) select frame_id from x where not list_contains(flatten(list_transform(arguments, lambda a: list_transform(a.realizations, lambda r: starts_with(r, 'lex(')))), true)")
def o58_no_lexical_slot(spark, d):
    """Frames without a lexical slot: anti join of the frames with the exploded lexical slots."""
    f = _frames(spark, d).where("arguments is not null")
    lexical = V.frame_slots(f).where(F.col("realization").startswith("lex(")).select("frame_id")
    return f.select("frame_id").join(lexical, "frame_id", "left_anti")


_EDGES = "e as (select distinct child_id as c, parent_id as p from synset_relations where relation_type = 11 and child_id in (select synset_id from synsets) and parent_id in (select synset_id from synsets))"
_UNITS = "un as (select distinct synset_id, unnest(lex_units) as unit from synsets)"


@query(f"""with recursive {_EDGES}, up as (select c as node, p as anc from e union select up.node, e.p from up join e on up.anc = e.c), {_UNITS},
    tops as (select node, anc as top from up where anc not in (select c from e) union all select synset_id, synset_id from (select distinct synset_id from synsets) where synset_id not in (select c from e))
    select distinct unit, top as top_synset from un join tops on un.synset_id = tops.node where unit is not null""")
def o59_top_synsets(spark, d):
    """Top hypernyms of every lexical unit; a synset without hypernym is its own top."""
    synsets = table(spark, d, "synsets")
    edges = synset_edges(spark, d)
    known = synsets.select(F.col("synset_id").alias("node")).where("node is not null").distinct()
    tops = root_levels(edges).select("node", F.col("root").alias("top_synset"))
    lone = known.join(edges.select(F.explode(F.array("child", "parent")).alias("node")), "node", "left_anti")
    tops = tops.unionByName(lone.select("node", F.col("node").alias("top_synset")))
    units = synsets.select(F.col("synset_id").alias("node"), F.explode("lex_units").alias("unit")).where("unit is not null").distinct()
    return units.join(tops, "node").select("unit", "top_synset").distinct()


@query("select unit, array_to_string(list_sort(list(distinct domain)), ' ') as domains from (select unnest(lex_units) as unit, domain from synsets) where unit is not null and domain is not null group by 1")
def o60_domains(spark, d):
    units = table(spark, d, "synsets").where("domain is not null").select(F.explode("lex_units").alias("unit"), "domain").where("unit is not null")
    return units.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set("domain")), " ").alias("domains"))


# --- corpus of selectional preferences ---------------------------------------------------------------------------


SR = f"{OCC}, sr as (select lower(o.predicate) as predicate, label as slot, a.base as head, a.sent_id, a.word_no from arg a join occ o on o.sent_id = a.sent_id and o.predicate_no = a.predicate_no where o.predicate is not null)"


def _sr(spark, d):
    """(predicate, slot, head) of every attached argument: the corpus of selectional preferences."""
    t = _tokens(spark, d)
    occ = C.occurrences(t).where("predicate is not null").select("sent_id", "predicate_no", F.lower("predicate").alias("predicate"))
    return C.arguments(t).join(occ, ["sent_id", "predicate_no"]).select("predicate", F.col("label").alias("slot"), F.col("base").alias("head"), "sent_id", "word_no")


_CHOSEN = f"""{OCC}, {FRAMES}, {CAND}, {SLOTS}, {CASE}, {MATCH},
    cnt as (select predicate, aspect, has_sie, labels, frame_id, count(slot) as n_matched from mat group by all),
    best as (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by n_matched desc, frame_id) as r, count(*) over (partition by predicate, aspect, has_sie, labels, n_matched) as same from cnt),
    cho as (select oc.*, b.frame_id from best b join oc on {_SAME('oc', 'b')} where r = 1 and same = 1 and n_matched > 0),
    txt as (select c.sent_id, c.predicate_no, c.frame_id, m.label, f.arguments[m.slot + 1].text as slot_text from cho c join mat m on {_SAME('m', 'c')} and m.frame_id = c.frame_id and m.slot is not null join fr f on f.frame_id = c.frame_id)"""
_PLAIN = lambda c: f"translate(coalesce({c}, ''), chr(9) || chr(10), '  ')"


def _chosen(spark, d, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences with the frame of the single largest number of matches and its text, and the text of the slot of each of their labels."""
    frames = _frames(spark, d)
    cases = V.occurrence_cases(C.occurrences(t), C.arguments(t)).where("predicate is not null")
    keys = ["predicate", "aspect", "has_sie", "labels"]
    best = V.max_frames(cases, frames).select(*keys, "frame_id")
    texts = frames.select("frame_id", "frame_text", F.col("arguments.text").alias("texts"))
    chosen = cases.join(best, keys).join(texts, "frame_id")
    slots = V.matched_slots(cases, frames).where("slot is not null").select(*keys, "frame_id", "label", "slot")
    matched = chosen.join(slots, [*keys, "frame_id"]).select("sent_id", "predicate_no", "label", F.get("texts", F.col("slot")).alias("slot_text"))
    return chosen.select("sent_id", "predicate_no", "frame_text"), matched


def _plain(c):
    return F.translate(F.coalesce(c, F.lit("")), "\t\n", "  ")


@query(f"""with {_CHOSEN}, hd as (select sent_id, syntactic_head as word_no, min(semantic_head) as head_no from nkjp_groups where syntactic_head is not null and semantic_head is not null group by 1, 2)
    select concat_ws(chr(9), {_PLAIN('f.frame_text')}, {_PLAIN('p.orth')}, {_PLAIN('h.base')}, {_PLAIN('h.orth')}, {_PLAIN('x.slot_text')}) as line
    from txt x join arg a on a.sent_id = x.sent_id and a.predicate_no = x.predicate_no and a.label = x.label join fr f on f.frame_id = x.frame_id join tok p on p.sent_id = x.sent_id and p.word_no = x.predicate_no
    left join hd on hd.sent_id = a.sent_id and hd.word_no = a.word_no join tok h on h.sent_id = a.sent_id and h.word_no = coalesce(hd.head_no, a.word_no)""")
def o24_sr_corpus_lines(spark, d):
    """Lines of frame text, predicate, lemma and form of the semantic head (of the phrase group where one is known), and slot, for every argument that the chosen frame has a slot for."""
    t = _tokens(spark, d)
    chosen, matched = _chosen(spark, d, t)
    groups = table(spark, d, "nkjp_groups").where("syntactic_head is not null and semantic_head is not null").groupBy("sent_id", F.col("syntactic_head").alias("word_no")).agg(F.min("semantic_head").alias("head_no"))
    args = C.arguments(t).select("sent_id", "word_no", "label", "predicate_no").join(matched, ["sent_id", "predicate_no", "label"]).join(groups, ["sent_id", "word_no"], "left")
    rows = args.withColumn("head_no", F.coalesce("head_no", "word_no")).join(t.select("sent_id", F.col("word_no").alias("head_no"), F.col("orth").alias("head_orth"), F.col("base").alias("head_base")), ["sent_id", "head_no"])
    rows = rows.join(chosen, ["sent_id", "predicate_no"]).join(t.select("sent_id", F.col("word_no").alias("predicate_no"), "orth"), ["sent_id", "predicate_no"])
    return rows.select(F.concat_ws("\t", *[_plain(F.col(c)) for c in ("frame_text", "orth", "head_base", "head_orth", "slot_text")]).alias("line"))


@query(f"""with {_CHOSEN}
    select c.sent_id, c.predicate_no, t.word_no, concat_ws(chr(9), coalesce(nullif(orth, ''), '_'), coalesce(nullif(base, ''), '_'), coalesce(nullif(t.ctag, ''), '_'), case when t.predicate_no = c.predicate_no then coalesce(t.label, '_') else '_' end,
      coalesce(x.slot_text, '_'), case when t.word_no = c.predicate_no then 'predicate' else '_' end, case when t.word_no = c.predicate_no then coalesce(f.frame_text, '_') else '_' end) as line
    from cho c join tok t on t.sent_id = c.sent_id join fr f on f.frame_id = c.frame_id left join txt x on x.sent_id = c.sent_id and x.predicate_no = c.predicate_no and t.predicate_no = c.predicate_no and x.label = t.label""")
def o25_conll_tokens(spark, d):
    """CoNLL lines of seven columns (form, lemma, tag, label, slot, predicate mark, frame): one copy of the sentence per occurrence with a chosen frame."""
    t = _tokens(spark, d)
    chosen, matched = _chosen(spark, d, t)
    field = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("_"))
    slots = matched.select("sent_id", F.col("predicate_no").alias("p"), "label", "slot_text", F.col("predicate_no").alias("own_no"))
    rows = chosen.select("sent_id", F.col("predicate_no").alias("p"), "frame_text").join(t, "sent_id")
    rows = rows.withColumn("own_no", F.when(F.col("predicate_no") == F.col("p"), F.col("p"))).join(slots, ["sent_id", "p", "own_no", "label"], "left")
    mine = F.when(F.col("predicate_no") == F.col("p"), F.coalesce("label", F.lit("_"))).otherwise("_")
    at = F.col("word_no") == F.col("p")
    line = F.concat_ws("\t", field("orth"), field("base"), field("ctag"), mine, F.coalesce("slot_text", F.lit("_")), F.when(at, "predicate").otherwise("_"), F.when(at, F.coalesce("frame_text", F.lit("_"))).otherwise("_"))
    return rows.select("sent_id", F.col("p").alias("predicate_no"), "word_no", line.alias("line"))


@query(f"with {SR} select predicate, count(*) as n from sr group by 1")
def o61_predicate_counts(spark, d):
    return _sr(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SR} select predicate, slot, count(*) as n, count(distinct head) as n_heads from sr group by 1, 2")
def o61_predicate_slot_counts(spark, d):
    return _sr(spark, d).groupBy("predicate", "slot").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("head").alias("n_heads"))


@query(f"with {SR} select distinct predicate from sr")
def o61_limiter(spark, d):
    return _sr(spark, d).select("predicate").distinct()


# --- evaluation -------------------------------------------------------------------------------------------------


@query(f"with {RES} select classifier, count(*) as chosen, count(*) filter (value = 1) as correct from res where value is not null and classifier is not null group by 1")
def o63_by_classifier(spark, d):
    r = _results(spark, d).where("value is not null and classifier is not null")
    return r.groupBy("classifier").agg(F.count(F.lit(1)).alias("chosen"), F.count_if(F.col("value") == 1).alias("correct"))


@query(f"""with {RES}, g as (select sent_id, predicate, count(*) as n, max((value = 1)::int) as has_gold from res where value is not null and predicate is not null group by 1, 2)
    select predicate, round(sum(case when has_gold = 1 then 1.0 / n else 0 end), 6) as expected, count(*) as n_groups from g group by 1""")
def o64_random_baseline(spark, d):
    """Expected right answers of a random choice among a group's candidates."""
    g = _results(spark, d).where("value is not null and predicate is not null").groupBy("sent_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("value") == 1).cast("int")).alias("gold"))
    return g.groupBy("predicate").agg(F.round(F.sum(F.when(F.col("gold") == 1, 1 / F.col("n")).otherwise(0.0)), 6).alias("expected"), F.count(F.lit(1)).alias("n_groups"))


@query(f"with {RES} select predicate, classifier, count(value) as n, round(avg(value), 6) as mean_value, sum(value) as sum_value from res where value is not null group by 1, 2")
def o65_predicate_classifier(spark, d):
    return _results(spark, d).where("value is not null").groupBy("predicate", "classifier").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.sum("value").alias("sum_value"))


@query(f"""with {RES}, n as (select *, count(*) over (partition by sent_id, predicate) as candidates from res where predicate is not null)
    select count(*) as total, count(value) as not_none, count(*) filter (value = 1) as correct, count(*) filter (value is not null and candidates = 1) as easy,
      round(count(*) filter (value = 1) / count(*), 6) as accuracy, round(count(*) filter (value = 1) / count(value), 6) as precision,
      round((count(*) filter (value = 1) - count(*) filter (value is not null and candidates = 1)) / (count(value) - count(*) filter (value is not null and candidates = 1)), 6) as ambiguous_precision from n""")
def o66_metrics(spark, d):
    r = _results(spark, d).where("predicate is not null")
    per = r.groupBy("sent_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("not_none"), F.count_if(F.col("value") == 1).alias("correct"))
    return S.choice_metrics(per.withColumn("easy", F.when(F.col("n") == 1, F.col("not_none")).otherwise(0)))


@query(f"""with {TOK}, g as (select sent_id, syntactic_head as word_no, min(nullif(arg_type, '')) as gold from nkjp_groups where syntactic_head is not null group by 1, 2),
    x as (select coalesce(label, '_') as predicted, coalesce(gold, '_') as gold from tok left join g on g.sent_id = tok.sent_id and g.word_no = tok.word_no)
    select count(*) filter (predicted <> '_') as predicted, count(*) filter (gold <> '_') as gold, count(*) filter (predicted = gold and gold <> '_') as correct,
      round(count(*) filter (predicted = gold and gold <> '_') / count(*) filter (predicted <> '_'), 6) as precision, round(count(*) filter (predicted = gold and gold <> '_') / count(*) filter (gold <> '_'), 6) as recall from x""")
def o67_label_scores(spark, d):
    gold = table(spark, d, "nkjp_groups").where("syntactic_head is not null").groupBy("sent_id", F.col("syntactic_head").alias("word_no")).agg(F.min(F.nullif("arg_type", F.lit(""))).alias("gold"))
    return S.label_scores(_tokens(spark, d).join(gold, ["sent_id", "word_no"], "left"), "label", "gold")


@query(f"""with {TOK}, n as (select sent_id, word_no, label, predicate_no,
      last_value(case when {VERB} then word_no end ignore nulls) over (partition by sent_id order by word_no rows between unbounded preceding and 1 preceding) as l,
      first_value(case when {VERB} then word_no end ignore nulls) over (partition by sent_id order by word_no rows between 1 following and unbounded following) as r from tok),
    x as (select *, coalesce(case when l is null or r - word_no <= word_no - l then r else l end, -1) = coalesce(predicate_no, -1) as ok from n where label is not null),
    s as (select sent_id, bool_and(ok) as ok, count(*) as n, count(*) filter (ok) as right_ from x group by 1)
    select sum(n) as n_args, sum(right_) as correct, round(sum(right_) / sum(n), 6) as accuracy, round(avg(ok::int), 6) as sentence_accuracy from s""")
def o68_assignment_scores(spark, d):
    t = _tokens(spark, d)
    x = C.nearest_predicate(t).join(C.arguments(t).select("sent_id", "word_no", "predicate_no"), ["sent_id", "word_no"])
    return S.assignment_scores(x.withColumn("ok", F.coalesce("nearest", F.lit(-1)) == F.col("predicate_no")))


@query(f"""with {OCC} select label, n_args, n_preds, count(*) as n from (select a.sent_id, a.label, s.n_args, s.n_preds from arg a join (select sent_id, count(*) as n_args, count(distinct predicate_no) as n_preds from arg group by 1) s using (sent_id))
    group by grouping sets ((label), (n_args), (n_preds))""")
def o69_breakdowns(spark, d):
    """Arguments by label, by arguments and by predicates of their sentence, in one pass with grouping sets."""
    a = C.arguments(_tokens(spark, d))
    s = a.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n_args"), F.countDistinct("predicate_no").alias("n_preds"))
    x = a.join(s, "sent_id")
    x = x.select("label", "n_args", "n_preds").alias("x")
    one, two, three = F.col("x.label"), F.col("x.n_args"), F.col("x.n_preds")
    return x.groupingSets([[one], [two], [three]], one, two, three).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {TOK}, g as (select distinct sent_id, syntactic_head as word_no, nullif(arg_type, '') as slot from nkjp_groups where syntactic_head is not null and nullif(arg_type, '') is not null),
    x as (select g.slot, (t.label = g.slot)::int as ok from g left join tok t on t.sent_id = g.sent_id and t.word_no = g.word_no)
    select slot, count(*) as n, count(*) - sum(coalesce(ok, 0)) as errors, round((count(*) - sum(coalesce(ok, 0))) / (select count(*) - sum(coalesce(ok, 0)) from x), 6) as error_share from x group by 1 having count(*) > 10""")
def o70_slot_errors(spark, d):
    gold = table(spark, d, "nkjp_groups").where("syntactic_head is not null and nullif(arg_type, '') is not null").select("sent_id", F.col("syntactic_head").alias("word_no"), F.col("arg_type").alias("slot")).distinct()
    x = gold.join(_tokens(spark, d).select("sent_id", "word_no", "label"), ["sent_id", "word_no"], "left").withColumn("ok", F.coalesce((F.col("label") == F.col("slot")).cast("int"), F.lit(0)))
    return S.error_shares(x, "slot", "ok", 10)


@query("""with g as (select distinct sent_id, group_no, group_type, syntactic_head, semantic_head from nkjp_groups where semantic_head is not null)
    select coalesce(group_type, '') as group_type, count(*) as n, count(*) filter (syntactic_head = semantic_head) as correct, round(count(*) filter (syntactic_head = semantic_head) / count(*), 6) as accuracy from g group by 1 having count(*) > 10""")
def o71_semantic_heads(spark, d):
    """Accuracy of taking the syntactic head for the semantic one, per kind of group."""
    g = table(spark, d, "nkjp_groups").where("semantic_head is not null").select("sent_id", "group_no", "group_type", "syntactic_head", "semantic_head").distinct()
    hit = F.count_if(F.col("syntactic_head") == F.col("semantic_head"))
    return g.groupBy(F.coalesce("group_type", F.lit("")).alias("group_type")).agg(F.count(F.lit(1)).alias("n"), hit.alias("correct"), F.round(hit / F.count(F.lit(1)), 6).alias("accuracy")).where("n > 10")


@query(f"""with {RES}, f as (select value, (row_number() over (order by md5(result_id::varchar), result_id) - 1) % 10 as fold from (select result_id, max(value) as value from res where value is not null group by 1)),
    a as (select fold, avg(value) as accuracy from f group by 1) select round(avg(accuracy), 6) as mean, round(var_pop(accuracy), 9) as variance, round(stddev_pop(accuracy), 6) as deviation from a""")
def o72_fold_mean_variance(spark, d):
    r = _results(spark, d).where("value is not null").groupBy("result_id").agg(F.max("value").alias("value")).withColumn("draw", F.md5(F.col("result_id").cast("string")))
    a = C.folds(r, ["draw", "result_id"], 10).groupBy("fold").agg(F.avg("value").alias("accuracy"))
    return a.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.var_pop("accuracy"), 9).alias("variance"), F.round(F.stddev_pop("accuracy"), 6).alias("deviation"))


@query("with f as (select doc_id, ((row_number() over (order by md5(doc_id::varchar), doc_id) - 1) % 10)::int as fold from documents where doc_id is not null) select doc_id, fold from f")
def o73_folds(spark, d):
    """Documents shuffled by a hash and dealt to ten folds."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("draw"))
    return C.folds(docs, ["draw", "doc_id"], 10).select("doc_id", "fold")


@query(f"with {SR}, c as (select predicate, slot, count(*) as n from sr group by 1, 2) select predicate, slot, n, r from (select *, row_number() over (partition by predicate order by n desc, slot)::int as r from c) where r <= 3")
def o76_top_slots(spark, d):
    """The three most frequent slots of each predicate; aggregated first, so the window sees one row per slot."""
    c = _sr(spark, d).groupBy("predicate", "slot").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("n"), "slot"))).where("r <= 3")


@query("select o_orderpriority as grp, round(v[1 + (5 * len(v)) // 100], 2) as low, round(v[1 + (95 * len(v)) // 100], 2) as high from (select o_orderpriority, list_sort(list(distinct o_totalprice)) as v from orders group by 1)")
def o77_percentile_bounds(spark, d):
    return S.percentile_bounds(table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x")), "grp", "x", (5, 95)).select("grp", F.round("p5", 2).alias("low"), F.round("p95", 2).alias("high"))


@query("select grp, p, round(v[1 + (p * len(v)) // 100], 2) as bound from (select o_orderstatus as grp, list_sort(list(distinct o_totalprice)) as v from orders group by 1), (select unnest(range(100))::int as p)")
def o78_percentile_array(spark, d):
    return S.percentile_rows(table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("x")), "grp", "x", range(100)).select("grp", "p", F.round("bound", 2).alias("bound"))


@query("select label, i, round(avg(x), 5) as mean from (select label, unnest(range(64))::int as i, unnest(embedding::double[]) as x from embeddings) group by 1, 2")
def o79_centroids(spark, d):
    return S.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", "i", F.round("mean", 5).alias("mean"))


@query("""with x as (select vec_id, label, unnest(range(64)) as i, unnest(embedding::double[]) as x from embeddings), c as (select label, i, avg(x) as m from x group by 1, 2)
    select vec_id, x.label, round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 4) as cosine from x join c on c.label = x.label and c.i = x.i group by 1, 2""")
def o134_cosine_to_centroid(spark, d):
    return S.cosine_to_centroid(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("vec_id", "label", F.round("cosine", 4).alias("cosine"))


@query("""with s as (select distinct doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) as w from documents where text is not null)
    select doc_id, len(w) as n_words, len(list_intersect(w, ['i', 'w', 'na', 'się', 'nie'])) as n_common, len(list_intersect(w, ['i', 'w'])) = 2 as has_both from s""")
def o81_set_algebra(spark, d):
    """Set operations on the words of each document: distinct, intersection, containment."""
    w = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    s = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w")).distinct()
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return s.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_intersect("w", words("i", "w", "na", "się", "nie"))).cast("long").alias("n_common"), (F.size(F.array_except(words("i", "w"), "w")) == 0).alias("has_both"))


@query(f"""with {FRAMES}, k as (select frame_id, array_to_string(list_sort(list_transform(list_transform(arguments, lambda a: a.text), lambda s: regexp_replace(s, '\\s+', '', 'g'))), '+') as k from fr where frame_text is not null and arguments is not null)
    select k as comparable, count(*) as n_frames, min(frame_id) as first_frame from k group by 1""")
def o82_equal_frames(spark, d):
    """Frames equal but for the order of slots and blanks."""
    f = _frames(spark, d).where("frame_text is not null and arguments is not null").select("frame_id", V.comparable(F.col("frame_text")).alias("comparable"))
    return f.groupBy("comparable").agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame_id").alias("first_frame"))


_FEAT = "coalesce(nullif(translate({}, ' ' || chr(9) || chr(10), ''), ''), '_')"
_POS = "split_part(ctag, ':', 1)"
_PART = lambda n: f"(case when len(string_split(ctag, ':')) > {n} then split_part(ctag, ':', {n + 1}) end)"


@query(f"""with {TOK}, o as (select *, case when {_POS} = 'prep' then {_PART(1)} when {_POS} = 'subst' then {_PART(2)} end as oc from tok)
    select sent_id, word_no, {_FEAT.format('orth')} as f_orth, {_FEAT.format('base')} as f_base, {_FEAT.format(_POS)} as f_pos,
      coalesce(case when {_POS} in {_IN(L.CASE_THIRD)} then {_PART(2)} when {_POS} in {_IN(L.CASE_SECOND)} then {_PART(1)} end, '_') as f_case,
      coalesce(case when {_POS} = 'inf' then {_PART(1)} end, '_') as f_aspect,
      case when oc is not null and list_contains([{', '.join(f'lag(oc, {i}) over w' for i in range(1, 6))}], oc) then oc else '_' end as f_case_nearby from o window w as (partition by sent_id order by word_no)""")
def o84_token_features(spark, d):
    return C.token_features(_tokens(spark, d))


@query(f"""with {TOK}, x as (select a.sent_id, a.word_no, a.predicate_no, count(*) filter (coalesce(split_part(b.ctag, ':', 1), '') in ('subst', 'psubst')) as n from tok a join tok p on p.sent_id = a.sent_id and p.word_no = a.predicate_no
      join tok b on b.sent_id = a.sent_id and b.word_no between least(a.word_no, a.predicate_no) and greatest(a.word_no, a.predicate_no) where a.label is not null group by 1, 2, 3)
    select sent_id, word_no, predicate_no, case when n > 5 then 'subst-far-away' else 'subst-' || n end as distance from x""")
def o87_predicate_distance(spark, d):
    return C.predicate_distance(_tokens(spark, d), "subst", ("subst", "psubst"))


# --- models -----------------------------------------------------------------------------------------------------


_NB = f"""{SR}, sl as (select slot, predicate, count(*) as c from sr group by 1, 2), pr as (select predicate, sum(c) as n from sl group by 1), k as (select count(distinct slot) as k from sl), t as (select sum(n) as t, count(*) as p from pr),
    post as (select slot, pr.predicate, ln((n + 0.1) / (t + 0.1 * p)) + ln((c + 0.1) / (n + 0.1 * k)) as s from sl join pr using (predicate), k, t)"""


@query(f"with {_NB}, m as (select slot, max(s) as m from post group by 1), z as (select slot, sum(exp(s - m)) as z from post join m using (slot) group by 1) select post.slot, predicate, round(exp(s - m) / z, 6) as posterior from post join m using (slot) join z using (slot)")
def o132_bayes_posterior(spark, d):
    """Posterior of the predicate given one slot, over the predicates seen with it."""
    return S.bayes_posterior(_sr(spark, d), "predicate", "slot").select("slot", "predicate", F.round("posterior", 6).alias("posterior"))


@query(f"""with {_NB}, m as (select slot, max(s) as m from post group by 1), z as (select slot, sum(exp(s - m)) as z from post join m using (slot) group by 1),
    q as (select post.slot, predicate, exp(s - m) / z as p, row_number() over (partition by post.slot order by s desc, predicate) as r from post join m using (slot) join z using (slot)),
    d as (select a.slot, a.predicate, a.p, coalesce(b.p, -1) as second from q a left join q b on b.slot = a.slot and b.r = 2 where a.r = 1)
    select slot, predicate, round(p, 6) as posterior from d where p - second > 0.01 or p / second > 1.5""")
def o122_bayes_choice(spark, d):
    """The top predicate of a slot where its lead is large enough in difference or ratio."""
    return S.decide_by_gap(S.bayes_posterior(_sr(spark, d), "predicate", "slot"), "slot", "predicate", "posterior", 0.01, 1.5).select("slot", "predicate", F.round("posterior", 6).alias("posterior"))


_CHOICES = f"""{PASS},
    num as (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by frame_id) as r from pas),
    step as (select distinct predicate, aspect, has_sie, labels, 0::bigint as r, null::bigint as frame_id, []::varchar[] as seen from num
             union all select n.predicate, n.aspect, n.has_sie, n.labels, n.r,
                    case when list_has_all(met, seen) and len(met) > len(seen) then n.frame_id when len(seen) = 0 or (list_has_all(seen, met) and len(seen) > len(met)) then s.frame_id end,
                    case when list_has_all(met, seen) and len(met) > len(seen) then met else seen end
             from step s join num n on {_SAME('s', 'n')} and n.r = s.r + 1),
    grow as (select predicate, aspect, has_sie, labels, frame_id from (select * from step qualify row_number() over (partition by predicate, aspect, has_sie, labels order by r desc) = 1) where frame_id is not null),
    cnt as (select predicate, aspect, has_sie, labels, frame_id, count(slot) as n_matched from mat group by all),
    uniq as (select predicate, aspect, has_sie, labels, frame_id from (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by n_matched desc, frame_id) as r, count(*) over (partition by predicate, aspect, has_sie, labels, n_matched) as same from cnt) where r = 1 and same = 1 and n_matched > 0),
    lone as (select predicate, aspect, has_sie, labels, min(frame_id) as frame_id from pas group by 1, 2, 3, 4 having count(*) = 1)"""


def _choices(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cases, and the frames that the table choosers give them: the scan for a growing set, the single largest number of matches, the only frame that passes the filters."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    cases = V.occurrence_cases(C.occurrences(t := _tokens(spark, d)), C.arguments(t)).where("predicate is not null")
    frames = _frames(spark, d)
    lone = V.passing_frames(cases, frames).groupBy(*keys).agg(F.min("frame_id").alias("frame_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    pick = lambda df: df.select(*keys, "frame_id")
    return cases, {"grow": pick(V.growing_frames(cases, frames)), "uniq": pick(V.max_frames(cases, frames)), "lone": pick(lone)}


@query(f"""with recursive {_CHOICES},
    v as (select predicate, aspect, has_sie, labels, frame_id, sum(w) as votes from (select *, 8 as w from grow union all select *, 10 from uniq union all select *, 7 from lone) group by 1, 2, 3, 4, 5),
    b as (select *, row_number() over (partition by predicate, aspect, has_sie, labels order by votes desc, frame_id) as r from v)
    select oc.sent_id, oc.predicate_no, b.frame_id, (votes / 10)::double as votes from b join oc on {_SAME('oc', 'b')} where r = 1 and votes >= 10""")
def o129_vote(spark, d):
    """Weighted votes of three choosers per occurrence (0.8, 1.0 and 0.7); the frame with the most if that is at least 1, of two equal ones the first."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    cases, choices = _choices(spark, d)
    votes = None
    for name, weight in (("grow", 8), ("uniq", 10), ("lone", 7)):
        own = choices[name].withColumn("w", F.lit(weight))
        votes = own if votes is None else votes.unionByName(own)
    votes = votes.groupBy(*keys, "frame_id").agg(F.sum("w").alias("votes"))
    top = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("minus"), "frame_id")).alias("x")).where("x.minus <= -10")
    return cases.join(top, keys).select("sent_id", "predicate_no", "x.frame_id", (-F.col("x.minus") / 10).alias("votes"))


@query(f"""with recursive {_CHOICES}
    select oc.sent_id, oc.predicate_no, coalesce(g.frame_id, u.frame_id, l.frame_id) as frame_id, case when g.frame_id is not null then 0 when u.frame_id is not null then 1 else 2 end as stage
    from oc left join grow g on {_SAME('oc', 'g')} left join uniq u on {_SAME('oc', 'u')} left join lone l on {_SAME('oc', 'l')} where oc.predicate is not null""")
def o130_cascade(spark, d):
    """The first of three choosers that decides, for every occurrence; the last one's number and no frame where all abstain."""
    keys = ["predicate", "aspect", "has_sie", "labels"]
    cases, choices = _choices(spark, d)
    for name, df in choices.items():
        cases = cases.join(df.withColumnRenamed("frame_id", name), keys, "left")
    stage = F.when(F.col("grow").isNotNull(), 0).when(F.col("uniq").isNotNull(), 1).otherwise(2)
    return cases.select("sent_id", "predicate_no", F.coalesce("grow", "uniq", "lone").alias("frame_id"), stage.alias("stage"))


@query(f"""with {SR}, c as (select predicate, slot, head, count(*) as n from sr where head is not null group by 1, 2, 3), ps as (select predicate, slot, sum(n) as n_ps from c group by 1, 2), hs as (select slot, head, sum(n) as n_h from c group by 1, 2), s as (select slot, sum(n) as n_s from c group by 1)
    select predicate, slot, head, round((n / n_ps) * ln((n / n_ps) / (n_h / n_s)), 6) as association from c join ps using (predicate, slot) join hs using (slot, head) join s using (slot)""")
def o124_selectional_association(spark, d):
    """Selectional association of heads: p(head | predicate, slot) weighted log ratio to p(head | slot)."""
    return S.selectional_association(_sr(spark, d), "predicate", "slot", "head").select("predicate", "slot", "head", F.round("association", 6).alias("association"))


# --- annotation and models, which SQL can't express --------------------------------------------------------------


def _sie_verbs(spark, d) -> frozenset:
    """Lemmas that the valency dictionary has with ``się`` (a dictionary's headwords: thousands, however large the corpus)."""
    lemma = F.regexp_extract(tidy("predicate"), r"(?U)^(.+?)\s+się$", 1).alias("lemma")
    return frozenset(r[0] for r in table(spark, d, "frames").select(lemma).distinct().collect() if r[0])


@query()
def o99_attachment_ablation(spark, d):
    """Accuracy of every ensemble of rules and both baselines against the corpus's attachments (O-91 to O-100)."""
    s = A.with_dictionary(A.nested_sentences(_tokens(spark, d)), _frames(spark, d))
    x = A.attach_arguments(s, [*E.ENSEMBLES, "nearest", "nearest_argument"], _sie_verbs(spark, d), heads=False)
    return x.groupBy("rules").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicate_no") == F.col("gold")).alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6))


@query()
def o101_attached_arguments(spark, d):
    """Predicate and semantic head of every argument by the production rules."""
    s = A.with_dictionary(A.nested_sentences(_tokens(spark, d)), _frames(spark, d))
    return A.attach_arguments(s, ["production"], _sie_verbs(spark, d)).drop("rules", "gold")


def _labelled_sentences(spark, d) -> DataFrame:
    """Sentences with all that the labeller looks at."""
    t = K.chunk_heads(_tokens(spark, d), table(spark, d, "nkjp_groups"))
    keys = cut(K.preposition_keys(_tokens(spark, d)))
    return A.nested_sentences(t.join(K.pp_attachment_noun(keys, K.attachment_statistics(keys)), ["sent_id", "word_no"], "left"))


@query()
def o102_label_folds(spark, d):
    """Precision and recall of the labeller on ten folds of the sentences."""
    s = _labelled_sentences(spark, d)
    ids = s.select("sent_id").withColumn("draw", F.xxhash64("sent_id"))
    return A.label_folds(cut(s.join(C.folds(ids, ["draw", "sent_id"], 10).select("sent_id", "fold"), "sent_id")))


@query()
def o104_extracted_arguments(spark, d):
    """Arguments labelled by a CRF, attached and headed, over all sentences."""
    s = A.with_dictionary(cut(_labelled_sentences(spark, d)), _frames(spark, d))
    return A.extract_arguments(s, A.train_labeller(s), sie_verbs=_sie_verbs(spark, d))


#: Stages of the cascade, in the order and with the thresholds that must match, without those that need trained scorers.
CASCADE = "max:false,lex:true,maxNoXP:true,bayes:true:0.1:20.0:false,negbayes:true:0.4:50.0:false,cost,vec:random:0.1,vote:1.5:bayes:true:0.2:50.0:false@1.0;max:true@0.8;maxNoXP:false@0.7"


@query()
def o130_frame_choices(spark, d):
    """The frame of every occurrence by a cascade, null where all stages abstain. Bayes counts the frames and matched slots of the occurrences that maximal matching decides."""
    t, frames = _tokens(spark, d), _frames(spark, d)
    args = cut(C.arguments(t))
    occurrences = C.occurrences(t).withColumn("lemma", F.lower("predicate"))
    lemmas = frames.select(F.explode(F.array("predicate", F.regexp_replace("predicate", " się$", ""))).alias("lemma")).where("lemma is not null").distinct().withColumn("known", F.lit(True))
    occurrences = cut(occurrences.join(lemmas, "lemma", "left").drop("lemma"))
    known = occurrences.where("known").drop("known")  # the others have no candidates: nothing to look at
    counts, slots = (cut(x) for x in V.maximal_counts(V.occurrence_cases(known, args), args.select("label").distinct(), frames))
    mine = t.join(known.select("sent_id").distinct(), "sent_id", "left_semi")
    rows = cut(A.occurrence_rows(mine, known, args, C.extended_arguments(mine).select("sent_id", "predicate_no", "word_no", "label")))
    none = occurrences.where("known is null").select("sent_id", "predicate_no", F.lit(None).cast("string").alias("frame_text"), F.lit(len(CASCADE.split(",")) - 1).alias("stage"), F.lit(0).alias("n_candidates"))
    return A.choose_frames(rows, frames, CASCADE, counts, slots).unionByName(none)


@query()
def o135_logistic_scores(spark, d):
    """Each embedding under the model of its own label against the rest: 2p - 1."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    labels = sorted(r[0] for r in e.select("label").where("label is not null").distinct().collect())  # a class label: ten in the tables
    pairs = e.withColumn("target", F.explode(F.array(*[F.lit(x) for x in labels]))).withColumn("y", (F.col("label") == F.col("target")).cast("int"))
    models = M.logistic_models(pairs, "target", "x", "y", "vec_id")
    return e.join(models, e.label == models.target).select("vec_id", "label", F.round(M.logistic_score(F.col("x"), F.col("weights")), 4).alias("score"))


@query()
def o137_forest_scores(spark, d):
    """Probability of being right for every decision on a frequent predicate, by a forest per predicate."""
    r = _results(spark, d).where("predicate is not null and value is not null").groupBy("predicate", "result_id").agg(F.max("value").alias("value"), F.max("classifier").alias("classifier"), F.max("sent_id").alias("sent_id"))
    t = _tokens(spark, d).groupBy("sent_id").agg(F.count(F.lit(1)).alias("n_words"), F.count("label").alias("n_args"))
    x = r.join(t, "sent_id", "left").withColumn("x", F.array(F.col("classifier").cast("double"), F.col("n_words").cast("double"), F.col("n_args").cast("double")))
    return M.forest_scores(x, "predicate", "x", "value", "result_id").withColumn("prob", F.round("prob", 4))


@query()
def o139_cascade_search(spark, d):
    """The best cascade of the classifiers found by annealing, with its scores."""
    r = _results(spark, d).where("predicate is not null")
    found, accuracy, precision = X.anneal(X.outcome_patterns(r, ["sent_id", "predicate"], "classifier", "value"))
    return spark.createDataFrame([(";".join("+".join(map(str, s)) for s in found), round(accuracy, 6), round(precision, 6))], "cascade string, accuracy double, precision double")


@query()
def o140_random_expectation(spark, d):
    """Accuracy of the first classifier, abstentions counted as a random choice would score."""
    r = _results(spark, d).where("predicate is not null")
    base = o64_random_baseline(spark, d).agg((F.sum("expected") / F.sum("n_groups")).alias("b")).first()[0] or 0.0
    accuracy, precision = X.cascade_score(X.outcome_patterns(r, ["sent_id", "predicate"], "classifier", "value"), [(0,)], base)
    return spark.createDataFrame([(round(base, 6), round(accuracy, 6))], "baseline double, accuracy double")
