"""Leaves of near-copies that no split divides."""

import numpy as np

from tidebar.llm import embedding_dedup


def test_a_leaf_that_cannot_be_split_is_compared_as_it_is(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal(16)
    rows = [(i, [float(x) for x in base + draw.standard_normal(16) * 1e-3], 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(docs, sample_rows=60, overfull=80, leaf=40).collect()
    assert len(got) == 240 and {(r.n_links, r.component_id) for r in got} == {(239, 0)}
