"""Readers, sinks and frame choosers on hand-made inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import choosers as H
from frameloom.functions.attachment import Word
from frameloom.functions.slots import parse_frame
from frameloom.operators import annotate as A
from frameloom.sources import documents as D
from frameloom.sources import store as K
from frameloom.sources import text as R

CCL = """<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE chunkList SYSTEM "ccl.dtd"><chunkList><chunk id="c" type="p"><sentence id="s1">
<tok><orth>Ala</orth><lex disamb="1"><base>Ala</base><ctag>subst:sg:nom:f</ctag></lex><ann chan="np" head="1">1</ann><ann chan="vp">0</ann></tok>
<tok><orth>zła</orth><lex><base>x</base><ctag>ign</ctag></lex><ann chan="np">1</ann></tok>
<tok><orth>ma</orth><lex disamb="1"><base>mieć</base><ctag>fin:sg:ter:imperf</ctag></lex><ann chan="vp" head="1">1</ann></tok>
<tok><orth>kota</orth><lex disamb="1"><base>kot</base><ctag>subst:sg:acc:m2</ctag></lex><ann chan="np">2</ann></tok><ns/>
<tok><orth>&amp;</orth><lex disamb="1"><base>&amp;</base><ctag>interp</ctag></lex></tok></sentence><sentence id="s2"></sentence></chunk></chunkList>"""


def test_ccl(spark, tmp_path):
    (s,) = D.parse_ccl(CCL.encode())
    assert [(w["orth"], w["base"], w["nps"]) for w in s["words"]] == [("Ala", "Ala", False), ("ma", "mieć", False), ("kota", "kot", True), ("&", "&", False)]
    assert s["text"] == "Ala ma kota&" and sorted((c["type"], c["number"], c["head"], tuple(c["words"])) for c in s["chunks"]) == [("np", 1, 0, (0,)), ("np", 2, None, (2,)), ("vp", 1, 1, (1,))]
    assert D.parse_ccl(b"<broken") == []
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.chunked").write_text(CCL)
    (tmp_path / "other.xml").write_text("<a/>")
    df = D.read_ccl(spark, str(tmp_path))
    assert df.count() == 1 and D.chunks_of(df).count() == 3
    again = D.parse_ccl(K.ccl_xml([("s1", s["words"])]).encode())
    assert again[0]["words"] == s["words"]
    K.write_ccl(df, str(tmp_path / "out"))
    assert "<orth>kota</orth>" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    written = [D.parse_ccl(p.read_bytes()) for p in (tmp_path / "out").glob("part*") if p.stat().st_size]
    assert [x["words"] for found in written for x in found] == [s["words"]]
    odd = spark.createDataFrame([(7, [("a\nb", None, "x", None)]), (None, None)], "sent_id long, words array<struct<orth string, base string, ctag string, nps boolean>>")
    K.write_xces(odd.coalesce(1), str(tmp_path / "xces"))
    text = "".join(p.read_text() for p in (tmp_path / "xces").glob("part*"))
    assert text.count('<chunk type="s">') == 2 and text.rstrip().endswith("</cesAna>") and "<base></base>" in text
    K.write_ccl(df.limit(0), str(tmp_path / "empty"))
    assert "&amp;" in K.xces_xml([s["words"]]) and K.plain_tag("padv:x") == "adv:x"


def _node(nid, a, b, category="", features=(), terminal=None, kids=()):
    f = "".join(f'<f type="{k}">{v}</f>' for k, v in features)
    inside = f"<terminal><orth>{terminal[0]}</orth><base>{terminal[1]}</base>{f}</terminal>" if terminal else f"<nonterminal><category>{category}</category>{f}</nonterminal>"
    children = '<children chosen="true">' + "".join(f'<child nid="{k}" head="{str(h).lower()}"/>' for k, h in kids) + "</children>" if kids else ""
    return f'<node nid="{nid}" from="{a}" to="{b}" chosen="true">{inside}{children}</node>'


def test_treebank(spark, tmp_path):
    word = lambda nid, i, orth, base, tag: _node(nid, i, i + 1, terminal=(orth, base), features=[("tag", tag)])
    nodes = [
        _node(0, 0, 6, "zdanie", kids=[(1, False), (2, True), (3, False), (4, False)]),
        _node(1, 0, 1, "fw", [("tfw", "subj")], kids=[(10, True)]),
        _node(2, 1, 2, "ff", [("rekcja", "[subj,np(bier)]")], kids=[(11, True)]),
        _node(3, 2, 5, "fw", [("tfw", "np( bier)")], kids=[(5, False), (13, True), (6, False)]),
        _node(4, 5, 6, "fl", kids=[(7, True)]),
        _node(5, 2, 3, "fno", [("przypadek", "bier")], kids=[(12, True)]),
        _node(6, 4, 5, "fno", [("przypadek", "bier")], kids=[(14, True)]),
        _node(7, 5, 6, "fps", kids=[(15, True)]),
        word(10, 0, "Ala", "Ala", "subst:sg:nom:f"), word(11, 1, "lubi", "lubić", "fin:sg:ter:imperf"), word(12, 2, "psy", "pies", "subst:pl:acc:m2"),
        word(13, 3, "i", "i", "conj"), word(14, 4, "koty", "kot", "subst:pl:acc:m2"), word(15, 5, "bardzo", "bardzo", "adv:pos"),
    ]
    xml = '<forest sent_id="x"><text>Ala lubi psy i koty bardzo</text><answer-data><base-answer type="FULL"/></answer-data>' + "".join(nodes) + "</forest>"
    s = D.parse_tree(xml)
    assert [w["orth"] for w in s["words"]] == ["Ala", "lubi", "psy", "i", "koty", "bardzo"]
    (entry,) = s["argument_structures"]
    assert entry["pred"] == {"left_ix": 1, "right_ix": 2}
    assert [(a["argument_type"], a["span"]["left_ix"], a["syntactic_head"]) for a in entry["args"]] == [("subj", 0, 0), ("np(bier)", 2, 2), ("np(bier)", 4, 4)]
    assert [(a["argument_type"], a["syntactic_head"]) for a in s["free_phrases"][0]["args"]] == [("advp", 5)]
    assert D.parse_tree(xml.replace("FULL", "NO")) is None and D.parse_tree("<x") is None
    assert D.parse_rection("[subj,np(mian),adjp(mian),prepnp(z,dop),advp]") == ["adjp(mian)", "advp", "np(mian)", "prepnp(z,dop)", "subj"]
    (tmp_path / "t.xml").write_text(xml)
    (tmp_path / "u.xml").write_text("<forest/>")
    assert D.read_treebank(spark, str(tmp_path)).count() == 1
    ask = {"words": [{"orth": w, "base": w, "ctag": t} for w, t in (("czy", "qub"), ("śpi", "fin:sg"))], "free_phrases": [],
           "argument_structures": [{"pred": None, "args": [{"argument_type": "sentp(pz)", "syntactic_head": 1}, {"argument_type": "subj", "syntactic_head": 0}]}]}
    assert D.move_question_heads(ask)["argument_structures"][0]["args"] == [{"argument_type": "sentp(pz)", "syntactic_head": 0}]


def test_vectors_and_network(spark, tmp_path):
    data = b"3 4\n" + b"".join(w.encode() + b" " + np.array(v, "<f4").tobytes() for w, v in (("kot", [3, 0, 4, 0]), ("\nżaba", [0, 2, 0, 0]), ("zero", [0, 0, 0, 0])))
    words, v = D.parse_vectors(data)
    assert words == ["kot", "żaba", "zero"] and np.allclose(v[0], [0.6, 0, 0.8, 0]) and not v[2].any()
    (tmp_path / "v.bin").write_bytes(data)
    assert [r["word"] for r in D.read_vectors(spark, str(tmp_path)).collect()] == words
    (tmp_path / "net.xml").write_text('<array-list><lexical-unit id="1" name="kot" variant="1" pos="n" domain="zw"/><lexical-unit id="2" name="pies" variant="1" pos="n" domain="zw"/>'
                                      '<synset id="10"><unit-id>1</unit-id><unit-id>2</unit-id></synset><synset id="11"><unit-id>2</unit-id></synset><synsetrelations relation="11" parent="11" child="10"/><synsetrelations relation="12" parent="10" child="11"/></array-list>')  # fmt: skip
    net = D.read_wordnet(spark, str(tmp_path / "net.xml"))
    assert net["units"].count() == 2 and net["synsets"].count() == 3
    assert [tuple(r) for r in net["hypernyms"].collect()] == [(10, 11)]


def test_text_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    pp = file("pp", "0.2\t0.8\t2\t0\t0:iść\t0:dom\tdo\tgen\t_\t_\tx y\n\n0.9\t0.1\t1\t0\t0:iść\t0:dom\tdo\tgen\t_\t_\tz\n")
    assert [tuple(r) for r in R.read_pp_attachment(spark, pp).collect()] == [("iść", "dom", "do", "gen", 0.9, 0.1, 1)]
    frames = R.read_frames(spark, file("d", "% note\n\nmyć się: pewny: _: : imperf: subj{np(str)} + {refl}\nbad line\nmyć: pewny: _: : _: subj{np(str)} + obj{np(str); xp(abl)}\n"))
    assert [(r["predicate"], len(r["arguments"])) for r in frames.orderBy("ord").collect()] == [("myć się", 2), ("myć", 2)]
    flat = {tuple(r) for r in R.flat_dictionary(frames).collect()}
    assert ("myć", "imperf", "sie") in flat and ("myć", "_", "xp(abl)") in flat and ("myć", "_", "subj:np(str)") in flat
    types = R.read_phrase_types(spark, file("p", "xp(abl)-->\n  advp(abl) [pewny]\n  skąd\nadvp(abl)-->\n  stąd\n"))
    assert {tuple(r) for r in types.collect()} == {("xp(abl)", "advp(abl)"), ("xp(abl)", "skąd"), ("advp(abl)", "stąd")}
    assert {tuple(r) for r in R.member_types(types).where("member = 'stąd'").collect()} == {("stąd", "advp(abl)"), ("stąd", "xp(abl)")}
    assert [r["value"] for r in R.read_lines(spark, file("l", " bać \n\nśmiać\n")).collect()] == ["bać", "śmiać"]
    assert [tuple(r) for r in R.read_frequencies(spark, file("f", "być,10\nmieć,7\nx,y\n")).collect()] == [("być", 10), ("mieć", 7)]
    gold = R.read_gold(spark, file("g", "haslo\tramka\tcomment1\nmyć\tsubj\nmieć\tobj\tniejedn\n")).collect()
    assert gold[0]["gold"] == {"haslo": "myć", "ramka": "subj"} and gold[1]["gold"]["comment1"] == "niejedn"
    w = spark.createDataFrame([("Ala[Ala>subst:sg] AT&T[at>xxx] broken",)], "t string").select(R.parse_tagged(F.col("t")).alias("w")).first()["w"]
    assert [(x["orth"], x["base"], x["ctag"]) for x in w] == [("Ala", "Ala", "subst:sg"), ("AT&amp;T", "at", "ign")]
    line = [{"words": [{"orth": "w", "interp": ["w", "prep:loc"], "nps": False}, {"orth": "domu", "interp": ["dom", "subst:sg:loc:m3"], "nps": True}], "groups": [{"group_type": t, "sem_head": 1, "syn_head": h} for t, h in (("PrepNG", 0), ("NG", 1), ("AdvG", 1), ("CG", 0), ("KG", 0), ("DisG", 0), ("Odd", 0))]}]
    n = R.read_nkjp(spark, file("n", json.dumps(line) + "\n{broken\n[]\n")).collect()
    assert len(n) == 1 and [g["arg_type"] for g in n[0]["groups"]] == ["prepnp(w,miej)", "np(miej)", "advp", "sentp(w)", "sentp(int)", "disg"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "i int, s string")
    path = str(tmp_path / "kept")
    assert K.kept(spark, path, lambda: df).count() == 3
    assert K.kept(spark, path, lambda: 1 / 0).count() == 3
    (tmp_path / "kept/_SUCCESS").unlink()
    assert K.kept(spark, path, lambda: df.limit(1)).count() == 1
    K.write_lines(df, "s", ["i"], str(tmp_path / "lines"), single=True)
    assert "".join(p.read_text() for p in (tmp_path / "lines").glob("part*")) == "a\nb\n\n"
    K.write_csv(df, str(tmp_path / "csv"), "$")
    assert "i$s" in next((tmp_path / "csv").glob("part*")).read_text()
    K.write_training_rows(df.withColumn("p", F.lit("myć")).withColumn("f", F.lit("x:y")), str(tmp_path / "ml"), "p", "f")
    assert spark.read.csv(str(tmp_path / "ml/rows"), header=True).count() == 3 and list((tmp_path / "ml/rows").rglob("*.csv.gz"))
    v = spark.createDataFrame([(1, [0.0, 2.5, 1.0])], "y int, x array<double>").select(K.libsvm_line(F.col("y"), F.col("x")).alias("l")).first()["l"]
    assert v == "1 1:2.5 2:1.0"
    t = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "np"), (2, 0, "c", None)], "s int, i int, f string, g string")
    assert [r["line"] for r in K.feature_lines(t, ["f"], "g", "s", "i").orderBy("s", "i").collect()] == ["a\t_", "b\tnp\n", "c\t_\n"]
    with pytest.raises(Exception, match="white space"):
        K.feature_lines(t.withColumn("f", F.lit("a b")), ["f"], "g", "s", "i").collect()
    toks = spark.createDataFrame([(1, i, f"w{i}") for i in range(9)], "sent_id int, word_no int, orth string")
    dec = spark.createDataFrame([(1, 6, "iść", "dom", "do", "gen", "verb")], "sent_id int, word_no int, verb string, noun string, prep string, case_ string, decision string")
    assert K.pp_lines(toks, dec).first()["line"] == "iść\tdom\tdo\tgen\tverb\tw1 w2 w3 w4 w5 w6 w7 w8"
    assert 'background:#cfc">True' in K.html_report([{"a": "<", "ok": True}], ["a", "ok"], "ok")


# --- choosers ----------------------------------------------------------------------------------------------------

HEAD = "robić: pewny: _: : imperf: "
OBJ, DAT, LEX, XP = (HEAD + x for x in ("subj{np(str)} + obj{np(str)}", "subj{np(str)} + {np(dat)}", "subj{np(str)} + {lex(np(acc),sg,'dom',natr)}", "subj{np(str)} + {xp(mod)}"))
S = [Word("Ala", "Ala", "subst:sg:nom:f"), Word("robi", "robić", "fin:sg:ter:imperf"), Word("stół", "stół", "subst:sg:acc:m3"), Word("psu", "pies", "subst:sg:dat:m2")]


def case(frames, labels=("subj", None, "np(bier)", None), know=None, base="robić", words=S):
    args = [[(x, i)] if x else [] for i, x in enumerate(labels)]
    k = H.Knowledge(**(know or {}))
    for t in frames:
        f = parse_frame(t)
        k.frames.setdefault(f.predicate, []).append(f)
    return H.Case(base, "imperf", words, args, args, k)


def pick(spec, *a, **k):
    f = H.make(spec)(case(*a, **k))
    return f and f.text


def test_candidates():
    refl = "robić: pewny: _: : _: subj{np(str)} + {refl}"
    sie = "robić się: pewny: _: : imperf: subj{np(str)}"
    perf = "robić: pewny: _: : perf: subj{np(str)}"
    either = HEAD + "controller{or}"
    assert [f.text for f in case([OBJ, refl, sie, perf, either]).candidates] == [OBJ, refl]
    assert [f.text for f in case([OBJ, refl, sie, perf], ("sie", None, None, None)).candidates] == [sie, refl]


def test_maximal():
    assert pick("max:false", [OBJ, DAT]) == OBJ and pick("max:false", [DAT, OBJ]) == OBJ
    assert pick("max:false", [OBJ, OBJ.replace("pewny", "inny")]) is None
    assert pick("max:false", [DAT, DAT.replace("pewny", "inny"), OBJ]) == OBJ  # a later superset recovers
    assert pick("max:false", []) is None and pick("max:false", [LEX]) is None  # a lexical slot must be matched
    both = HEAD + "subj{np(str)} + {prepnp(bez,gen)}"
    assert pick("max:false", [XP, both], ("subj", None, None, None)) is None
    assert pick("maxNoXP:false", [HEAD + "{xp(mod)}", HEAD + "{advp(misc)}"], (None, None, None, "advp")) == HEAD + "{xp(mod)}"
    assert pick("max:false", [HEAD + "{xp(mod)}", HEAD + "{advp(misc)}"], (None, None, None, "advp")) is None


def test_lexical_and_cost():
    house = [*S[:2], Word("dom", "dom", "subst:sg:acc:m3"), S[3]]
    assert pick("lex:true", [OBJ, LEX], words=house) == LEX and pick("lex:true", [OBJ, LEX]) is None
    assert pick("cost", [OBJ, DAT]) == OBJ and pick("cost", [OBJ, OBJ.replace("pewny", "inny")]) is None and pick("cost", []) is None


def test_bayes():
    know = {"frame_counts": {OBJ: 90.0, DAT: 10.0}, "slot_counts": {(OBJ, "subj{np(str)}"): 90.0, (OBJ, "obj{np(str)}"): 80.0, (DAT, "subj{np(str)}"): 10.0, (DAT, "{np(dat)}"): 9.0}}
    only = ("subj", None, None, None)
    assert pick("bayes:false:0.1:1000:false", [OBJ, DAT], only, know) == OBJ
    assert pick("bayes:false:0.999:1000:false", [OBJ, DAT], only, know) is None
    assert pick("bayes:false:0.999:2:false", [OBJ, DAT], only, know) == OBJ  # by ratio
    assert pick("bayes:false:0.1:5:false", [OBJ], only, know) == OBJ and pick("bayes:false:0.1:5:false", [], only, know) is None
    assert pick("negbayes:false:0.1:5:false", [OBJ, DAT], only, know) in (OBJ, DAT, None)
    c = case([OBJ, DAT], only, know)
    p = H.bayes_scores(c, c.candidates, {f.text: {"subj{np(str)}"} for f in c.candidates})
    assert abs(sum(p.values()) - 1) < 1e-12 and p[OBJ] > p[DAT]
    assert abs(sum(H.bayes_scores(c, c.candidates, {f.text: set() for f in c.candidates}, compat=True).values()) - 1) < 1e-12


def test_preferences():
    score = lambda f, s, h: 1.0 if f == OBJ else 0.2
    know = {"slot_counts": {(t, s): 100.0 for t in (OBJ, DAT) for s in ("subj{np(str)}", "obj{np(str)}", "{np(dat)}")}, "scorers": {n: score for n in ("clark", "splitsum", "selassoc")}}
    only = ("subj", None, None, None)
    assert pick("sr:clark;splitsum:false:0.1:false", [OBJ, DAT], only, know) == OBJ
    assert pick("sr:clark:false:5.0:false", [OBJ, DAT], only, know) is None and pick("sr:clark:false:0.1:false", [], only, know) is None
    rare = {**know, "slot_counts": {k: 20.0 for k in know["slot_counts"]}}
    assert pick("sr:clark:false:0.1:false", [OBJ, DAT], only, rare) is None  # slots seen too seldom don't vote
    two, obj = [OBJ, HEAD + "obj{np(str)} + {np(dat)}"], (None, None, "np(bier)", None)
    one = {**know, "bounds": {(t, "obj{np(str)}"): [i / 100 for i in range(100)] for t in two}, "slot_counts": {(t, s): 10.0 for t in two for s in ("subj{np(str)}", "obj{np(str)}", "{np(dat)}")}}
    assert pick("srone:splitsum:30:90", two, obj, one) == OBJ
    assert pick("srone:splitsum:30:90", two, obj, {**one, "slot_counts": {}}) is None
    prep = [HEAD + "{prepnp(do,gen)}", HEAD + "{prepnp(do,gen)} + {np(dat)}"]
    pk = {"bounds": {(t, "{prepnp(do,gen)}"): [i / 100 for i in range(100)] for t in prep}, "scorers": {"splitsum": lambda f, s, h: 0.9 if f == prep[1] else 0.1}}
    assert pick("srperc:splitsum:0.2", prep, (None, None, "prepnp(do,dop)", None), pk) == prep[1]
    assert pick("srperc:splitsum:0.95", prep, (None, None, "prepnp(do,dop)", None), pk) is None


def test_vectors_models_votes():
    know = {"similarity": {"cos": lambda f, s, h: 0.9 if f == OBJ else 0.3}, "frame_counts": {OBJ: 30.0, DAT: 30.0}}
    only = ("subj", None, None, None)
    assert pick("vec:cos:0.1", [OBJ, DAT], only, know) == OBJ and pick("vec:cos:0.7", [OBJ, DAT], only, know) == OBJ
    assert pick("vec:cos:0.7", [DAT, OBJ], only, know) is None  # the lead counts against what was displaced
    assert pick("vec:cos:0.1:50", [OBJ, DAT], only, know) is None and pick("vec:cos:0.95", [OBJ], only, know) is None
    assert pick("vec:cos:0.95", [OBJ], (None,) * 4, know) == OBJ  # no matched slot passes
    model = {"probability": lambda f, c: 0.9 if f.text == OBJ else 0.2}
    assert pick("http:0.1:0.8", [OBJ, DAT], only, model) == OBJ and pick("http:0.8:0.8", [OBJ, DAT], only, model) is None
    assert pick("http:0.1:0.8", [OBJ], only, model) is None and pick("http:0.1:0.8", [OBJ, DAT], only) is None
    assert pick("vote:1.5:max:false;cost@0.7", [OBJ, DAT]) == OBJ and pick("vote:1.8:max:false;cost@0.7", [OBJ, DAT]) is None
    cascade = H.Cascade("lex:true,max:false,cost")
    assert cascade.choose(case([OBJ, DAT])) == (parse_frame(OBJ), 1) and cascade.choose(case([])) == (None, 2)
    with pytest.raises(ValueError):
        H.Cascade("max:false,nothing")


def test_swappers():
    other = {t: t.replace("robić", "czynić") for t in (OBJ, DAT)}
    c = case([OBJ, DAT, *other.values(), OBJ.replace("robić", "pleść")], know={"frame_counts": {other[OBJ]: 50.0}})
    (swap,) = H.swappers(c, c.candidates)
    assert swap(OBJ) == other[OBJ] and H.swappers(c, []) [0](OBJ) == OBJ


def test_every_chooser_in_one_cascade():
    """One stage of every kind; all of them abstain on two like frames but for the last, which draws by a score."""
    stages = ["max:true", "maxNoXP:true:false:true", "cost", "lex:true", "bayes:false:0.9:900:true", "negbayes:false:0.9:900:false", "sr:selassoc;clark:true:0.5:true", "srone:splitsum:10:80:false", "srperc:splitsum:0.7", "model:0.2:0.9", "vote:3:cost@2;lex:true@2", "vec:random:0"]
    zero = lambda f, s, h: 0.0
    know = {"scorers": {n: zero for n in ("clark", "splitsum", "selassoc")}, "similarity": {"random": H.random_similarity()}}
    cascade = H.Cascade(",".join(stages))
    assert len(cascade.stages) == len(stages) and {x.split(":")[0] for x in stages} | {"http"} == set(H.MAKERS)
    f, stage = cascade.choose(case([OBJ, OBJ.replace("pewny", "inny")], know=know))
    assert stage < len(stages) and (f is None or f.predicate == "robić")


def test_choose_frames_table(spark):
    item = "struct<word_no:int,orth:string,base:string,ctag:string,label:string,predicate_no:int>"
    toks = [(i, w.orth, w.base, w.ctag, "_", -1) for i, w in enumerate(S)]
    own = [(0, "subj"), (2, "np(bier)")]
    rows = spark.createDataFrame([(1, 1, "robić", "imperf", False, own, own, toks), (2, 1, "nieznany", "imperf", False, None, None, toks)],
                                 f"sent_id long, predicate_no int, predicate string, aspect string, has_sie boolean, own array<struct<word_no:int,label:string>>, ext array<struct<word_no:int,label:string>>, tokens array<{item}>")
    frames = spark.createDataFrame([(i, "robić", "imperf", t, False) for i, t in enumerate((OBJ, DAT))], "frame_id long, predicate string, aspect string, frame_text string, has_refl boolean")
    counts = spark.createDataFrame([(OBJ, 3)], "frame_text string, n long")
    slots = spark.createDataFrame([(OBJ, "obj{np(str)}", 3)], "frame_text string, slot string, n long")
    found = sorted(tuple(r[c] for c in ("sent_id", "frame_text", "stage", "n_candidates")) for r in A.choose_frames(rows, frames, "lex:true,max:false", counts, slots).collect())
    assert found == [(1, OBJ, 1, 2), (2, None, 1, 0)]  # an occurrence without candidates comes out undecided
    with pytest.raises(ValueError):
        A.choose_frames(rows, frames, "max:false,vec:cos:0.1")
