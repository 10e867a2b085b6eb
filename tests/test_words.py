"""Words whose own form is complete JSON keep it."""

from frameloom.plans.general import p1_words


def test_words_that_look_like_json(spark, tmp_path):
    schema = "sent_id long, words array<struct<orth string, base string, ctag string, nps boolean>>, argument_structures array<struct<pred struct<left_ix int, right_ix int>>>, ccl string"
    words = [("[]", "{}", "interp", False), ("[1]", '{"words": [{"orth": "x"}]}', "num", None)]
    spark.createDataFrame([(1, words, None, None)], schema).write.parquet(str(tmp_path / "sentences.parquet"))
    rows = sorted(tuple(r) for r in p1_words(spark, str(tmp_path)).collect())
    assert rows == [(1, i, *w) for i, w in enumerate(words)]
