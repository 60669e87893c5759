"""Frames of GIFs without their canvases."""

from pyspark.sql import functions as F

from tidejoin.llm import gif as G


def test_frames_without_canvases_are_the_same(spark):
    texts = [(1, "a" * 3000), (2, ""), (3, "é\x00z" * 700), (4, None)]
    media = G.animations(spark.createDataFrame(texts, "doc_id long, text string"))
    bad = spark.createDataFrame([(9, bytearray(b"no gif")), (10, None)], "doc_id long, media binary")
    every = media.unionByName(bad)
    whole, thin = G.frame_table(every, "doc_id", "media"), G.frame_table(every, "doc_id", "media", canvas=False)
    assert thin.columns == [c for c in whole.columns if c != "rgba"]
    got = sorted(map(tuple, thin.collect()))
    assert got == sorted(map(tuple, whole.drop("rgba").collect())) and {r[0] for r in got} == {1, 2, 3, 4}
    for r in whole.where(F.col("doc_id") == 3).collect():
        assert len(r.rgba) == 4 * r.width * r.height and sum(r.histogram) == r.width * r.height
