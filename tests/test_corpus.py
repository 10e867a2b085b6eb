"""Relational operators against their SQL over the smallest tables, and the linguistic ones against hand-made cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from frameloom.functions import attachment as E
from frameloom.functions import labeling as B
from frameloom.functions import labels as L
from frameloom.functions import preferences as Q
from frameloom.functions import slots as T
from frameloom.functions.attachment import Word
from frameloom.operators import corpus as C
from frameloom.operators import models as M
from frameloom.operators import search as X
from frameloom.operators import statistics as S
from frameloom.operators import tokens as K
from frameloom.plans import corpus, features, general

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("tokens", "nkjp_groups", "frames", "pred_results", "synsets", "synset_relations", "sentences", "documents", "orders", "embeddings", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(corpus.SQL | general.SQL | features.SQL))
def test_against_sql(spark, duck, name):
    queries = corpus.QUERIES | general.QUERIES | features.QUERIES
    df = queries[name](spark, SF)
    want = duck.sql((corpus.SQL | general.SQL | features.SQL)[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def words(text: str) -> list[Word]:
    """``form/lemma/tag`` separated by blanks."""
    return [Word(*w.split("/", 2)) for w in text.split(" ")]


SHOP = words("Ona/on/ppron3:sg:nom poszła/pójść/praet:sg:f:perf do/do/prep:gen sklepu/sklep/subst:sg:gen:m3 ,/,/interp żeby/żeby/comp kupić/kupić/inf:perf chleb/chleb/subst:sg:acc:m3 ././interp")


@pytest.mark.parametrize("label", ["prepnp(do,dop)", "prepnp(do,bier)"])
def test_semantic_heads(label):
    labels = ["subj", "_", label, "_", "_", "sentp(żeby)", "_", "np(bier)", "_"]
    assert E.semantic_heads(SHOP, labels) == [0, None, 3, None, None, 6, None, 7, None]


def test_predicates_and_auxiliaries():
    s = words("Jutro/jutro/adv będzie/być/bedzie:sg:ter:imperf pisał/pisać/praet:sg:m1:imperf list/list/subst:sg:acc:m3")
    assert E.Layout(s, ["_"] * 4).predicates == [2]
    s = words("pisał/pisać/praet:sg:m1:imperf był/być/praet:sg:m1:imperf dom/dom/subst")
    assert E.Layout(s, ["_"] * 3).predicates == [0, 1]  # the second token never looks at the first


def test_rules():
    labels = ["subj", "_", "prepnp(do,dop)", "_", "_", "sentp(żeby)", "_", "np(bier)", "_"]
    assert E.attach(SHOP, labels) == [1, None, 1, None, None, 1, None, 6, None]
    for name in E.ENSEMBLES:
        assert E.attach(SHOP, labels, name)[7] == 6
    tie = words("je/jeść/fin:sg:ter:imperf dom/dom/subst pije/pić/fin:sg:ter:imperf")
    assert E.attach(tie, ["_", "np(bier)", "_"], ["word"])[1] == 2  # equally near: the right one
    assert E.attach(tie, ["_", "np(bier)", "_"], ["argument"])[1] is None  # equally near: no answer
    assert E.attach(tie, ["_", "np(bier)", "_"], ["argument"], keep_unattached=True)[1] == -1
    assert E.attach_nearest(tie, ["_", "np(bier)", "_"])[1] == 0
    tools = E.Tools({"bać"}, {"jeść": [("imperf", {"np(acc)"})], "pić": [("_", {"np(dat)"})]})
    assert E.attach(tie, ["_", "np(bier)", "_"], ["dict"], tools)[1] == 0
    sie = words("boi/bać/fin:sg:ter:imperf się/się/qub robić/robić/inf:imperf")
    assert E.attach(sie, ["_", "sie", "_"], ["sie"], tools)[1] == 0
    assert E.attach(sie, ["_", "sie", "_"], ["sie"], E.Tools())[1] == 2
    assert E.attach([], []) == []
    infinitive = words("dom/dom/subst chce/chcieć/fin:sg:ter:imperf spać/spać/inf:imperf")
    assert E.Layout(infinitive, ["subj", "_", "infp(nd)"]).main_predicates == [1]


def test_nearest_predicate_table(spark):
    s = [(1, i, w.orth, w.base, w.ctag, lab, None) for i, (w, lab) in enumerate(zip(SHOP, ["subj", None, "p", None, None, "s", None, "np", None]))]
    t = spark.createDataFrame(s, "sent_id long, word_no int, orth string, base string, ctag string, label string, predicate_no int")
    got = {r["word_no"]: r["nearest"] for r in C.nearest_predicate(t).collect()}
    assert got == {0: 1, 2: 1, 5: 6, 7: 6}


def test_cost_rule_table_agrees_with_sentences(spark):
    """The window form of the cost rule and the form of one sentence at a time."""
    t = C.tokens_once(spark.read.parquet(f"{SF}/tokens.parquet"))
    got = {(r["sent_id"], r["word_no"]): r["predicate"] for r in K.nearest_by_argument(t).collect()}
    seen = 0
    sentences: dict = {}
    for r in t.orderBy("sent_id", "word_no").collect():
        sentences.setdefault(r["sent_id"], []).append(r)
    for sid, rows in sentences.items():
        ws = [Word(r["orth"] or "", r["base"] or "", r["ctag"] or "") for r in rows]
        found = E.attach(ws, [r["label"] or "_" for r in rows], ["argument"])
        for r, p in zip(rows, found):
            if r["label"]:
                assert got[sid, r["word_no"]] == (None if p is None else rows[p]["word_no"])
                seen += 1
    assert seen == len(got) > 100


BRIDGE = [
    ("np(bier)", ["np(acc)"], True), ("np(bier)", ["np(str)"], True), ("np(dop)", ["np(part)"], True), ("np(cel)", ["np(str)"], False), ("adjp(narz)", ["adjp(pred)"], True),
    ("prepnp(do,dop)", ["prepnp(do,gen)"], True), ("prepnp(na,bier)", ["prepnp(na,str)"], True), ("prepnp(jako,mian)", ["prepnp(jako,str)"], True), ("sentp(że)", ["cp(żeby2)"], True),
    ("sentp(pz)", ["cp(int)"], True), ("infp(dk)", ["infp(_)"], True), ("advp", ["xp(mod)"], True), ("sie", ["refl"], True), ("nonch", ["nonch"], True), ("prepadjp(po,miej)", ["prepadjp(po,postp)"], True), ("_", ["np(acc)"], False),
]


@pytest.mark.parametrize("label,realizations,fits", BRIDGE)
def test_label_bridge(label, realizations, fits):
    assert T.base_match(label, T.Slot("", (), tuple(realizations)), "co") is fits


def test_label_bridge_column(spark):
    labels = sorted({b[0] for b in BRIDGE} | {"subj", "refl", "np(xx)", "prepnp(do", "sentp(czy)", "infp(x)", ""})
    df = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("r", L.realizations(F.col("label"), F.lit("co")))
    for r in df.collect():
        assert list(r["r"]) == T.label_realizations(r["label"], "co"), r["label"]


def test_dictionary_lines():
    f = T.parse_frame("﻿kupić: pewny: _: : perf: subj{np(str)} + obj{np(str)} + {prepnp(dla,gen); lex(np(inst),sg,'ręka',natr)}")
    assert (f.predicate, f.status, f.aspect) == ("kupić", "pewny", "perf")
    assert [(s.modifiers, s.realizations) for s in f.slots] == [(("subj",), ("np(str)",)), (("obj",), ("np(str)",)), ((), ("prepnp(dla,gen)", "lex(np(inst),sg,'ręka',natr)"))]
    assert T.parse_frame("% comment") is None and T.parse_frame("a:b:c") is None and T.parse_frame("") is None
    assert T.split_outside("a(b+c)+{d+e}+f", "+") == ["a(b+c)", "{d+e}", "f"]
    types = T.parse_phrase_types(["xp(abl)-->", "  advp(abl) [pewny]", "  skąd", "advp(abl)-->", "   skąd"])
    assert types == {"xp(abl)": ["advp(abl)", "skąd"], "advp(abl)": ["skąd"]}
    assert T.member_types(types)["skąd"] == ["xp(abl)", "xp(abl)", "advp(abl)"]
    assert T.parse_lex("lex(prepnp(w,loc),sg,'ręka',natr)") == T.LexSpec("prepnp(w,loc)", "sg", ("ręka",))
    assert T.parse_lex("lex(compar(jako),np(nom))") == T.LexSpec("np(nom)", "compar", ("jako",))
    assert T.parse_lex("lex(infp(imperf),'spać',,natr)").heads == ("spać",)
    assert T.parse_lex("lex(np(acc),pl,OR('oko';'ucho'),natr)").heads == ("oko", "ucho")


def test_gold_arguments():
    gold = T.parse_gold_arguments("[subj{np(str)} <np(nom)>] + [{prepnp(do,gen); xp(adl)} <prepnp(do,gen); xp(adl)>]")
    assert [(g.slot, g.realizations) for g in gold] == [("subj{np(str)}", ("np(nom)",)), ("{prepnp(do,gen); xp(adl)}", ("prepnp(do,gen)", "xp(adl)"))]
    frame = T.parse_frame("iść: pewny: _: : imperf: subj{np(str)} + {prepnp(do,gen);xp(adl)}")
    assert T.covers(frame, [g.slot for g in gold]) and not T.covers(frame, ["obj{np(str)}"]) and T.covers(frame, [])
    assert T.parse_gold_arguments("") == []


def test_preferences():
    up = {1: {10, 100}, 2: {10, 100}, 3: {20, 100}}
    p = Q.Preferences({("jeść", "obj", "jabłko"): 30, ("jeść", "obj", "gruszka"): 10, ("jeść", "obj", "stół"): 2, ("widzieć", "obj", "stół"): 30, ("widzieć", "obj", "jabłko"): 5},
                      {"jabłko": {1}, "gruszka": {2}, "stół": {3}, "śliwka": {2}}, up)
    for score in (p.association, p.split_sum, p.class_estimate):
        assert score("jeść", "obj", "gruszka") > score("jeść", "obj", "stół")
        assert score("jeść", "obj", "śliwka") is not None  # an unseen word scores by its class
        assert score("jeść", "obj", "nieznane") is None and score("nic", "obj", "stół") is None
    assert p.split_sum("jeść", "obj", "jabłko") > 0 > p.split_sum("jeść", "obj", "stół") and set(p.scorers()) == {"selassoc", "clark", "splitsum"}
    bounds = p.percentiles("jeść", "obj", p.split_sum)
    assert len(bounds) == 100 and bounds == sorted(bounds) and p.percentiles("nic", "obj", p.split_sum) == [0.0]


def test_slot_matching():
    frame = T.parse_frame("kupić: pewny: _: : perf: subj{np(str)} + obj{np(str)} + {lex(prepnp(do,gen),sg,'sklep',natr)} + {fixed('chleb')}")
    m = T.SlotMatcher(SHOP)
    got = m.match_frame([[("subj", 0)], [], [("prepnp(do,dop)", 3)], [], [], [], [], [("np(bier)", 7)], []], frame)
    assert [x and x.slot.text for x in got] == ["subj{np(str)}", None, "{lex(prepnp(do,gen),sg,'sklep',natr)}", None, None, None, None, "{fixed('chleb')}", None]
    that = words("myśli/myśleć/fin o/o/prep:loc tym/to/subst:sg:loc:n ,/,/interp że/że/comp śpi/spać/fin")
    slot = T.parse_slot("{prepncp(o,loc,że)}")
    assert T.SlotMatcher(that).correlative(1, "prepnp(o,miej)", slot) and T.SlotMatcher(that).correlative(4, "sentp(że)", slot)
    assert not T.SlotMatcher(SHOP).correlative(2, "prepnp(do,dop)", slot)
    types = {"xp(abl)": ["prepnp(z,gen)", "skąd"], "xp(mod)": ["fixed('byle jak')"]}
    x = T.SlotMatcher(words("z/z/prep:gen domu/dom/subst:sg:gen skąd/skąd/adv byle/byle/adv jak/jak/adv"), types)
    assert x.adverbial(0, "prepnp(z,dop)", 1, T.parse_slot("{xp(abl)}")) and x.adverbial(2, "advp", None, T.parse_slot("{xp(abl)}"))
    assert x.adverbial(0, "prepnp(z,dop)", 1, T.parse_slot("{xp(adl[prepnp(z,gen)])}")) and not x.adverbial(1, "np(dop)", 1, T.parse_slot("{xp(abl)}"))
    assert x.fixed(3, T.parse_slot("{xp(mod)}")) and not x.fixed(2, T.parse_slot("{xp(mod)}"))


def test_codecs_and_fillers():
    w = Word("do", "do", "prep:gen")
    for spec, label, short in (("prep", "prepnp(do,dop)", "prepnp(_,dop)"), ("p2", "prepnp(do,dop)", "prepnp(do,_)"), ("q1", "prepadjp(do,dop)", "prepadjp(_,dop)"), ("n", "np(dop)", "np(_)"), ("i", "np(dop)", "np(dop)"), ("prep,n", "np(dop)", "np(_)")):
        c = B.codec(spec)
        assert B.simplify(c, w, label) == short and B.recover(c, w, short) == label
    assert B.simplify(B.codec("s"), w, "sentp(pz)") == "sentp(pz)" and B.recover(B.codec("s"), Word("iż", "iż", "comp"), "sentp(_)") == "sentp(że)"
    s = words("kto/kto/subst przyszedł/przyjść/praet i/i/conj co/co/subst i/i/conj siebie/siebie/siebie:acc")
    none = [[("_", 0.95)]] * len(s)
    assert B.fill_questions(s, none)[0] == [("sentp(pz)", 9.0), ("sentp(kto)", 0.9)] and B.fill_questions(s, none)[3] == none[3]
    assert B.fill_nonch(s, none)[3][0] == ("nonch", 1.0) and B.fill_siebie(s, none)[5][0] == ("refl", 1.0)
    assert B.fill_jako(words("jako/jako/prep dom/dom/subst"), none[:2])[0] == [("prepnp(jako,str)", 1.0)]
    kept = B.keep_labels(s[:3], [[("a", 0.95), ("_", 0.05)], [("_", 0.5), ("b", 0.3), ("c", 0.2)], [("_", 0.6)]], fillers=())
    assert kept == [[("a", 0.95)], [("b", 0.3), ("c", 0.2)], [("_", 1.0)]]


def test_crf_learns_identity():
    data = [([[t] for t in "abcab"], list("abcab")), ([[t] for t in "cba"], list("cba"))]
    crf = B.ChainCRF.train(data, "U01:%x[0,0]\nB\n# no more", rounds=40)
    for rows, gold in data:
        p = crf.predict(rows)
        assert [x[0][0] for x in p] == gold and all(abs(sum(v for _, v in x) - 1) < 1e-9 for x in p)
    assert crf.predict([]) == [] and len(crf.predict([["?"]])[0]) == 3
    assert B.Template("U02:%x[-1,0]/%x[1,0]").features([["x"], ["y"]], 0) == ["U02:_B-1/y"]


def test_folds_and_index(spark):
    df = spark.range(10).withColumnRenamed("id", "k").repartition(3)
    assert sorted(r["index"] for r in C.global_index(df, ["k"]).collect()) == list(range(10))
    sizes = {r["fold"]: r["count"] for r in C.folds(df, ["k"], 3).groupBy("fold").count().collect()}
    assert sorted(sizes.values()) == [3, 3, 4]
    assert C.global_index(df.limit(0), ["k"]).count() == 0


def test_models(spark):
    rows = [(k, i, [float(i % 7), float(i % 3)], int(i % 7 > 3)) for k in ("a", "b") for i in range(400)] + [("rare", i, [0.0, 1.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, id long, x array<double>, y int")
    weights = {r["key"]: r["weights"] for r in M.logistic_models(df, "key", "x", "y", "id").collect()}
    assert set(weights) == {"a", "b"} and weights["a"][0] > 0
    scored = M.forest_scores(df, "key", "x", "y", "id").collect()
    assert {r["key"] for r in scored} == {"a", "b"} and len(scored) == 800
    truth = {(k, i): y for k, i, _, y in rows}
    assert sum((r["prob"] > 0.5) == truth[r["key"], r["id"]] for r in scored) / 800 > 0.95
    a, b = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert abs(a["c"] - 0.5**0.5) < 1e-12 and b["c"] == 0


def test_search():
    patterns = {(2, 1, 0): 5, (0, 2, 1): 4, (0, 0, 2): 3, (0, 1, 2): 2, (1, 2, 2): 1}
    best, accuracy, precision = X.anneal(patterns, steps=400)
    assert accuracy >= X.cascade_score(patterns, [(0,), (1,), (2,)])[0] and best[0] == (0,)
    assert X.anneal(patterns, steps=400) == (best, accuracy, precision)
    assert X.cascade_score(patterns, [(0,)]) == (5 / 15, 5 / 6) and X.cascade_score(patterns, [(0,)], 0.5)[0] == (5 + 4.5) / 15
    assert X.anneal({}) == ([], 0.0, 0.0)
