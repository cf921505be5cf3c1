"""Plan audit of every query of the analytics catalogue (guards the scale properties)."""

import os
import re

import pytest

from crashlens import catalog

SF = os.environ.get("CRASHLENS_ORACLE_SF", "/root/testdata/sf0.01")
BATCH = [n for n in catalog.queries() if not n.startswith("stream")]
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas"]
# look-back keys: their scan must carry the created_at bound and prune dates
LOOKBACK = ["q02", "q03", "q07", "q13", "q14", "q15", "q16", "q17", "q18", "q19", "q20",
            "q25", "q26", "q27", "q28", "q29", "r01", "r02", "r03", "r04", "r05", "r06",
            "r07", "r08", "c1", "c2", "c3", "c4"]


def executed(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")  # untruncated filter lists
    df = catalog.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_forbidden_operators(spark, name):
    plan = executed(spark, name)
    assert not [op for op in FORBIDDEN if op in plan]
    assert plan.count("FileScan") <= 2 or name.startswith(("c2", "cube_", "sketch_", "rollup_", "spikes_", "daily_"))


@pytest.mark.parametrize("name", [n for n in BATCH if n.split("_")[0] in LOOKBACK])
def test_lookback_reaches_the_scan(spark, name):
    plan = executed(spark, name)
    assert re.search(r"PartitionFilters: \[[^\]]*created_date", plan), name
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan(OrEqual)?\(created_at,", plan), name
