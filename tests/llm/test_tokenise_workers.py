"""Encoding and decoding take one Python worker a task."""

import corpus_pipeline
from duskline.llm import pieces
from duskline.llm.queries import piece_model


def test_one_pass_there_and_back(spark, odd_rows):
    model = piece_model()
    plans = [pieces.tokenise(odd_rows, model), corpus_pipeline.tokenise(spark, odd_rows, "")]
    assert [p._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for p in plans] == [1, 1]
    rows = odd_rows.select("doc_id", pieces.filled("text").alias("text"))
    want = pieces.decode(pieces.encode(rows, model), model)
    assert sorted(map(str, pieces.there_and_back(rows, model).collect())) == sorted(map(str, want.collect()))
