"""Reflexive verbs of the whole dictionary, and the dictionary within extract_arguments."""

from frameloom.operators import annotate as A
from frameloom.plans import corpus as P

SF = "/root/testdata/sf0.001"


def test_reflexive_verbs_of_the_dictionary(spark):
    got = P._sie_verbs(spark, SF)
    names = [r[0] for r in spark.read.parquet(f"{SF}/frames.parquet").select("predicate").distinct().collect() if r[0]]
    want = {" ".join(n.lower().split())[: -len(" się")] for n in names if n.lower().split()[-1:] == ["się"] and len(n.split()) > 1}
    assert got == want and len(got) > 6


def test_extraction_uses_the_dictionary(spark):
    sf = SF.replace("0.001", "0.01")
    s = A.nested_sentences(P._tokens(spark, sf))
    model = A.train_labeller(s, most_sentences=60, rounds=6)
    full = A.with_dictionary(s, P._frames(spark, sf))
    attached = [{tuple(r) for r in A.extract_arguments(x, model, ensemble="5", sie_verbs=P._sie_verbs(spark, sf)).select("sent_id", "word_no", "label", "rank", "predicate_no").collect()} for x in (s, full)]
    assert attached[0] != attached[1] and {x[:4] for x in attached[0]} == {x[:4] for x in attached[1]}
