"""Operator 5 on tables of few rows, with the production fraction."""

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")


@pytest.mark.parametrize("n", [4, 7, 10, 13])
def test_few_rows(spark, n):
    from tidemark.llm.ann import neighbours

    x = np.random.default_rng(n).normal(size=(n, 64))
    # the first id has as many rows as there are others
    ids = [*range(n), *[0] * (n - 1)]
    rows = spark.createDataFrame([(i, (x[i] + 0.01 * k).tolist()) for k, i in enumerate(ids)], "vec_id long, embedding array<double>")
    for table, least in ((rows.limit(n), n - 1), (rows, n - 1)):
        got = neighbours(table, table).collect()
        assert all(r["query_id"] != r["vec_id"] for r in got)
        for q in range(n):
            assert len([r for r in got if r["query_id"] == q]) == min(5, least + (n - 1 if q and table is rows else 0))
