"""Every synset has a row of paths: roots and lone ones at depth 0, those that lead only into a cycle without root."""

from frameloom.plans.general import p5_paths


def test_paths_of_every_synset(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6, None)], "synset_id long").write.parquet(str(tmp_path / "synsets.parquet"))
    edges = [(2, 1, 11), (3, 2, 11), (3, 1, 11), (4, 5, 11), (5, 5, 11), (6, 1, 7)]
    spark.createDataFrame(edges, "child_id long, parent_id long, relation_type int").write.parquet(str(tmp_path / "synset_relations.parquet"))
    rows = sorted((tuple(r) for r in p5_paths(spark, str(tmp_path)).collect()), key=str)
    assert rows == [(1, 1, 0, "1"), (2, 1, 1, "1/2"), (3, 1, 1, "1/3"), (4, None, None, None), (5, None, None, None), (6, 6, 0, "6")]
