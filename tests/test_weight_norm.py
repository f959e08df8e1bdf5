"""The norm of count weights from counted slots."""

import __spark_entry__ as entry
from glossa.operators import corpus as C
from glossa.operators import learn as L


def test_weight_norm_is_that_of_feature_rows_and_joins_no_tokens(spark):
    data = "/root/testdata/sf0.001"
    found = entry.queries()["weight_norm"](spark, data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "feature_rows" not in plan and "mapInArrow" in plan.replace("MapInArrow", "mapInArrow")
    counts = [int(r.w) for r in L.count_weights(L.feature_rows(C.silver(spark.read.parquet(f"{data}/documents.parquet")))).collect()]
    assert found.dtypes == [("squared_norm", "bigint"), ("n_weights", "bigint")]
    assert [tuple(r) for r in found.collect()] == [(sum(n * n for n in counts), len(counts))]
