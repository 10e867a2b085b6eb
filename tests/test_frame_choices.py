"""Frame choices and slot features over whole tables: long sentences, many frames of one predicate, repeated positions."""

import re

import duckdb

from frameloom.functions import choosers as H
from frameloom.functions.attachment import Word
from frameloom.functions.slots import parse_frame
from frameloom.operators import annotate as A
from frameloom.operators import corpus as C
from frameloom.plans import corpus, features

TOKEN = "sent_id bigint, word_no int, orth string, base string, ctag string, label string, predicate_no int"


def test_occurrences_of_long_sentences(spark):
    """An occurrence in a sentence of more than 100 words comes out like any other."""
    rows = []
    for sid, n in ((1, 3), (2, 101), (3, 250)):
        rows += [(sid, i, f"w{i}", "robić" if i == 1 else f"b{i}", "fin:sg:ter:imperf" if i == 1 else "subst:sg:acc:m", "np(acc)" if i == n - 1 else None, 1 if i == n - 1 else None) for i in range(n)]
    t = spark.createDataFrame(rows, TOKEN)
    extended = C.extended_arguments(t).select("sent_id", "predicate_no", "word_no", "label")
    found = A.occurrence_rows(t, C.occurrences(t), C.arguments(t), extended).collect()
    assert sorted((r["sent_id"], len(r["tokens"]), r["own"][0]["word_no"], r["ext"][0]["word_no"]) for r in found) == [(1, 3, 2, 2), (2, 101, 100, 100), (3, 250, 249, 249)]


def test_slot_features_of_repeated_positions(spark, tmp_path):
    """Positions with two lemmas or two forms against SQL: one row per slot, as in its grouping; and pairs of occurrences and slots are shuffled for such positions only."""
    frame = "struct<text:string,modifiers:array<string>,realizations:array<string>>"
    slot = lambda r, *m: (f"x{{{r}}}", list(m), [r])
    frames = [(1, "robić", "imperf", [slot("np(str)", "subj"), slot("np(str)", "obj"), slot("np(dat)")]), (2, "robić", "_", [slot("np(acc)"), slot("np(acc)")]), (3, "robić się", "_", [slot("np(str)", "subj")]),
              (4, "czynić", "_", [slot("refl"), slot("np(acc)")]), (5, "czynić", "perf", []), (6, None, "_", [slot("np(acc)")])]
    frames = [(i, p, None, a, f"{p}: pewny: _: : {a}: x", x) for i, p, a, x in frames]
    tok = lambda s, w, base, ctag, label=None, p=None: (s, w, f"{base}{w}", base, ctag, label, p)
    args = lambda s, *labels: [tok(s, 2 + i, f"b{i % 2}", "subst:sg:acc:m", x, 1) for i, x in enumerate(labels)]
    tokens = [tok(1, 1, "robić", "fin:sg:ter:imperf"), *args(1, "subj", "np(bier)", "np(bier)")]
    tokens += [tok(2, 1, "Robić", "fin:sg:ter:imperf"), *args(2, "sie", "np(bier)")]
    tokens += [tok(3, 1, "czynić", "fin:sg:ter:perf"), tok(3, 1, "robić", "fin:sg:ter:imperf"), *args(3, "sie", "np(bier)", "np(cel)")]
    tokens += [tok(4, 1, "robić", "fin:sg:ter:imperf"), tok(4, 1, "robić", "fin:pl:ter:imperf"), tok(4, 1, "robić", "praet:sg:perf"), *args(4, "np(bier)", "subj")]
    spark.createDataFrame(tokens, "sent_id bigint, word_no int, orth string, base string, ctag string, argument_type string, predicate_no int").write.parquet(f"{tmp_path}/tokens.parquet")
    spark.createDataFrame(frames, f"frame_id bigint, predicate string, status string, aspect string, frame_text string, arguments array<{frame}>").write.parquet(f"{tmp_path}/frames.parquet")
    con = duckdb.connect()
    for t in ("tokens", "frames"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ("sent_id", "predicate_no", "frame_id", "slot", "has_", "n_", "selassoc_")
    want = con.sql(f"select {', '.join(columns)} from ({features.SQL['o136_slot_features']})").fetchall()
    df = features.o136_slot_features(spark, str(tmp_path))
    tidy = lambda rows: sorted(tuple(r)[:6] + (None if r[6] is None else round(r[6], 5),) for r in rows)
    assert tidy(df.select(*columns).collect()) == tidy(want) and len(want) == len({r[:4] for r in want})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[sent_id#\d+L?, predicate_no#\d+, frame_id#\d+L?, slot#\d+\]", plan)) == 1 and not re.search(r"Join.*slot#\d+ = slot#\d+.*sent_id|Join.*sent_id.*slot#\d+ = slot#\d+", plan)


def test_frame_choices_plan_is_small(spark):
    """The driver plans a handful of exchanges: what several joins read is written once."""
    df = corpus.o130_frame_choices(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 12


def test_alike_cases_choose_as_alone():
    """Cases that share matches choose like cases of their own, also where words next to an argument or heads decide."""
    frames = [parse_frame(f"robić: pewny: _: : imperf: {x}") for x in ("subj{np(str)} + obj{np(str)}", "subj{np(str)} + {np(dat)}", "{lex(np(acc),sg,'kot',natr)}", "{xp(mod)} + obj{np(str)}", "{np(acc)}", "{comprepnp(w czasie)} + {np(acc)}")]
    know = H.Knowledge({"robić": frames}, {}, {frames[0].text: 3.0}, {(frames[0].text, "obj{np(str)}"): 3.0}, similarity={"random": H.random_similarity()})
    alike, cascade = H.Alike(frames), H.Cascade("max:false,lex:true,bayes:true:0.1:20.0:false,cost,vec:random:0.1")
    found = []
    for labels in (("subj", "np(bier)"), ("np(bier)",), ("np(cel)",), ("subj", "advp")):
        for lead in ([], ["w"], ["w", "czasie"], ["a", "b", "c"]):
            for noun in ("pies", "kot", "dom"):
                words = [Word(x, x, "subst:sg:acc:m") for x in (*lead, "robić", *[noun] * len(labels), "nic")]
                args = [[] for _ in words]
                for i, x in enumerate(labels):
                    args[len(lead) + 1 + i] = [(x, len(lead) + 1 + i)]
                case = H.Case("robić", "imperf", words, args, args, know)
                alone = H.Case("robić", "imperf", words, args, args, know)
                assert cascade.choose(alike.case(case)) == cascade.choose(alone), (labels, lead, noun)
                found.append(case)
    assert len(alike.first) < len(found)
