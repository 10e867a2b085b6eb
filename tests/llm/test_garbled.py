"""Encoding repair: exact round trips, held-out accuracy on synthetic garbling, and fine texts that must stay."""

import random

import pytest

from frameloom.llm import garbled as G

SF = "/root/testdata/sf0.01"


def test_round_trips():
    for text in ("Zażółć gęślą jaźń, „ŁÓDŹ” – süß «niño» cœur.", "plain", ""):
        for chain in G.chains():
            seen = G.garble(text, chain)
            if seen is not None:
                assert G.restore(seen, chain) == text
    assert G.restore("Åsta", ("utf-8", "cp1252", 1)) is None
    assert G.restore("дом", ("utf-8", "cp1252", 1)) is None


@pytest.fixture(scope="module")
def clean(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    return [(r["lang"], r["text"]) for r in rows if r["text"] and r["lang"] in G.LETTERS and len(r["text"]) < 3000 and not G._ODD.search(r["text"])]


def test_held_out_accuracy(clean):
    model = G.ChainModel.train(clean[::2])
    rng = random.Random(5)
    held = [t for _, t in clean[1::2]]
    kinds = [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1250", 2), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("cp1250", "cp1252", 1), ("iso8859-2", "latin-1", 1), ("iso8859-2", "cp1250", 1), ("cp852", "cp1250", 1)]
    found = exact = total = 0
    for text in held:
        chain = rng.choice(kinds)
        seen = G.garble(text, chain)
        if seen is None or sum(a != b for a, b in zip(seen, text)) < 2 or not G._ODD.search(seen):
            continue
        total += 1
        result = G.examine(seen, model)
        found += result is not None
        exact += result is not None and result[2] == text
    assert total > 100 and found / total > 0.97 and exact / total > 0.85
    assert sum(G.examine(t, model) is not None for t in held) <= 0.01 * len(held)
    for fine in ("Podano w m³ i km², 7 ¼ str.", "Nazwy zmyślone: Åsta, Ørje, Þorvik.", "Ĺ i Ą to dwie różne litery.", "Croÿ-sur-Vent, œuvre, cœur.", "Skład: „Š”, „Ž”, „Ÿ” i «ß».", "├── zdanie\n│   └── ff", "Пример: дом стоит у реки.", "", "   ", "ascii"):
        assert G.examine(fine, model) is None, fine
    whole = G.examine("Dobry dom. " + G.garble("Zwykła droga śledzi łódź.", ("utf-8", "cp1252", 1)) + " Żółta gęś.", model)
    assert whole[1:] == (True, "Dobry dom. Zwykła droga śledzi łódź. Żółta gęś.")
    long = "łódź" * 300_000
    assert G.examine(G.garble(long, ("utf-8", "cp1252", 1)), model)[2] == long and G.examine(long, model) is None
    assert G.examine("Zna� drog�.", model)[:2] == ("replaced", False)


def test_find_garbled_table(spark, clean):
    bad = G.garble("Zwykła łódź śledzi żółtą gęś.", ("utf-8", "cp1252", 1))
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate(clean[:200])] + [(1000, bad, "pl", "x"), (1000, bad, None, "x"), (1001, None, "pl", "x"), (1002, "", None, "x"), (None, bad, "pl", "x"), (1003, bad * 3000, "pl", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, chain string")
    out = G.find_garbled(df, "doc_id", "text", "lang").collect()
    assert sorted([r["doc_id"] for r in out if r["doc_id"] is None or r["doc_id"] >= 1000], key=str) == [1000, 1000, 1003, None]
    assert all(r["restorable"] and r["restored"].startswith("Zwykła łódź śledzi żółtą gęś.") for r in out if r["doc_id"] in (1000, 1003))
    assert G.find_garbled(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_only_polish_letters_result(clean):
    """Spanish and French read as cp1250 often hold no odd letter but Polish ones; fine texts that cite Polish words stay."""
    model = G.ChainModel.train(clean[::2])
    text = "¿Qué año nuevo empieza mañana en España?"
    for read in ("cp1250", "iso8859-2"):
        seen = G.garble(text, ("cp1252", read, 1))
        assert not G._ODD.search(seen) and G.examine(seen, model, "es")[2] == text and G.examine(seen, model)[2] == text
        held = [(t, G.garble(t, ("cp1252", read, 1)), lang) for lang, t in clean[1::2] if lang in ("es", "fr")]
        held = [(t, seen, lang) for t, seen, lang in held if seen not in (None, t)]
        assert len(held) >= 6 and sum(G.examine(seen, model, lang) is not None for _, seen, lang in held) >= 0.95 * len(held)
    for fine, lang in (("El koń y la łódź son palabras polacas.", "es"), ("Le mot łódź et le mot gęś sont polonais.", "fr"), ("The word “gęś” is Polish — like “koń”.", "en")):
        assert G.examine(fine, model, lang) is None, fine


def test_unexplained_words_beside_garbled_ones(clean):
    model = G.ChainModel.train(clean)
    text = "Zwykła droga śledzi żółtą łódź, a gęś łowi rybę."
    for chain in (("cp1250", "cp1252", 1), ("iso8859-2", "latin-1", 1), ("cp852", "cp1250", 1)):
        for extra in ("Pole 5 km² ", "Około ½ roku ", "Napis дом "):
            assert G.examine(extra + G.garble(text, chain), model, "pl")[1:] == (True, extra + text), (chain, extra)
    assert G.examine("Podano w m³, cm³, dm³ i km².", model, "pl") is None


def test_chains_of_low_rank(clean):
    """A chain that the model ranks ninth or later is tried when no other fits."""
    model = G.ChainModel.train(clean)
    text = "Zwykła droga śledzi żółtą łódź, a gęś łowi rybę."
    chain = ("cp1250", "cp1252", 1)
    number = model.chains.index(chain)
    likely = model.order
    model.order = lambda seen: [c for c in likely(seen) if c < 0 or model.chains[c][0] == "utf-8"][:12] + [number]
    assert G.examine(G.garble(text, chain), model, "pl")[1:] == (True, text)
