"""Softmax of whole vectors."""

import math

import numpy as np

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_softmax_takes_the_whole_vector(spark):
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()}
    got = entry.queries()["f30_softmax_whole"](spark, DATA).collect()
    assert len(got) == len(vectors) > 0
    for r in got:
        e = np.exp(vectors[r.vec_id] - vectors[r.vec_id].max())
        assert len(e) == 64
        assert math.isclose(r.first_p, e[0] / e.sum(), abs_tol=2e-9) and math.isclose(r.top_p, e.max() / e.sum(), abs_tol=2e-9)
