"""Column files of tokens and labels, and stretches after ``jako``."""

import random

from pyspark.sql import functions as F

from frameloom.functions import labeling as B
from frameloom.functions.attachment import Word
from frameloom.operators import tokens as K
from frameloom.sources.text import labels_with_probabilities, read_conll, read_old_frames


def test_read_conll(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# a note\nala\tsubst\tnp\nma\tfin\t_\n\n\n\nkota\tsubst\t# x\n\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    rows = [[(list(t["columns"]), t["label"]) for t in r["rows"]] for r in read_conll(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted([[(["ala", "subst", "np"], "np"), (["ma", "fin", "_"], "_")], [(["kota", "subst", "# x"], "# x")]])
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "c.txt").write_text("ala\tsubst\tnp/0.75\t_/0.25\n", encoding="utf-8")
    (row,) = read_conll(spark, str(tmp_path / "v"), 2).select(labels_with_probabilities(F.col("rows")[0]["labels"]).alias("x")).collect()
    assert [tuple(x) for x in row["x"]] == [("np", 0.75), ("_", 0.25)]


def test_jako_against_a_scan():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 12)
        words = [Word("x", "jako" if rng.random() < 0.3 else "y", rng.choice(["subst:sg", "adj:sg", "fin:sg", "adv", "prep:gen"])) for _ in range(n)]
        tops = [rng.choice(["_", "subj", "np(bier)", "advp", "x"]) for _ in range(n)]
        labels = [[(t, 0.5)] for t in tops]
        got = B.fill_jako(words, labels)
        for i in range(n):
            if words[i].base != "jako":
                assert got[i] == labels[i]
                continue
            stretch = []
            for j in range(i + 1, min(n, i + 6)):
                if tops[j] == "_" or words[j].pos == "fin":
                    break
                stretch.append(j)
            stop = i + 1 + len(stretch)
            kinds = [words[j].pos for j in stretch]
            adj = "adj" in kinds and "subst" not in kinds and (stop >= n or tops[stop] not in ("subj", "np(bier)"))
            assert got[i] == [("prepadjp(jako,str)" if adj else "prepnp(jako,str)", 1.0)]


def test_jako_columns(spark):
    """The window form gives what the filler gives where labels are sure or absent."""
    rng, rows, want = random.Random(9), [], set()
    for sid in range(120):
        words = [Word("x", "jako" if rng.random() < 0.3 else "y", rng.choice(["subst:sg", "adj:sg", "fin:sg", "adv", "prep:gen"])) for _ in range(rng.randrange(1, 11))]
        tops = [None if rng.random() < 0.3 else rng.choice(["subj", "np(bier)", "advp"]) for _ in words]
        rows += [(sid, 3 * i, w.orth, w.base, w.ctag, t, None) for i, (w, t) in enumerate(zip(words, tops))]
        filled = B.fill_jako(words, [[(t or "_", 1.0)] for t in tops])
        want |= {(sid, 3 * i, filled[i][0][0]) for i, w in enumerate(words) if w.base == "jako" and tops[i] is None}
    tokens = spark.createDataFrame(rows, "sent_id long, word_no int, orth string, base string, ctag string, label string, predicate_no int")
    got = {tuple(r) for r in K.jako_fillers(tokens).collect()}
    assert got == want and {x[2] for x in want} == {"prepadjp(jako,str)", "prepnp(jako,str)"}


def test_old_dictionary(spark, tmp_path):
    (tmp_path / "old.txt").write_text("\ufeff% a note\n\nbać się: pewny: : imperf: subj{np(str)}+{cp(że); np(dop)} + controller, obj{infp(_)}\nkrótki: pewny\nżyć: pewny: : _: zły\n", encoding="utf-8")
    rows = {r["predicate"]: (r["aspect"], [(list(a["modifiers"]), list(a["realizations"])) for a in r["arguments"]]) for r in read_old_frames(spark, str(tmp_path)).collect()}
    assert rows == {"bać się": ("imperf", [(["subj"], ["np(str)"]), ([], ["cp(że)", "np(dop)"]), (["controller", "obj"], ["infp(_)"])]), "żyć": ("_", [])}
