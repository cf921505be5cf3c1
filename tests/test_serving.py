"""Page index, day masks of errors, and SQL table functions against the plans they stand for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crashlens import plans as P
from crashlens.operators.error_days import advance_error_days, build_error_days, new_errors_of_day, read_error_days
from crashlens.plans.paging import page_at, refresh_page_index
from crashlens.sources.fixture import AS_OF, crash_table
from crashlens.sources.reports import register_views
from crashlens.sources.sql_functions import FUNCTIONS, register_functions
from tests.conftest import SF_SMALL


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def facts(spark):
    return crash_table(spark, SF_SMALL)


@pytest.fixture(scope="module")
def index(facts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    refresh_page_index(facts, path)
    return path


@pytest.mark.parametrize("days,limit,offset,version", [(30, 100, 0, None), (30, 7, 93, None), (9, 50, 40, "v1.1.0"), (1, 100, 0, None),
                                                       (30, 100, 5000, None), (365, 1, 0, "none")])
def test_pages_equal_the_full_sort(facts, index, days, limit, offset, version):
    kw = dict(app="app-1", as_of="2024-01-29 11:17:03", days=days, limit=limit, offset=offset, version=version)
    page = page_at(facts, index, **kw)
    assert page.rows.collect() == P.read_page(facts, **kw).collect()  # same rows in the same order
    info = P.page_info(facts, **kw)
    assert (page.total, page.has_more) == (info["total"], info["has_more"])


def test_a_deep_page_reads_the_dates_it_lies_in(facts, index):
    page = page_at(facts, index, app="app-1", as_of=AS_OF, days=30, limit=3, offset=150)
    assert len(page.dates) <= 2 and page.rows.count() == 3
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and str(page.dates[0]) in plan.replace("'", "")


def test_index_bounds_and_refresh(facts, spark, tmp_path):
    with pytest.raises(ValueError):
        page_at(facts, str(tmp_path), app="a", as_of=AS_OF, limit=101)
    path = str(tmp_path / "i")
    refresh_page_index(facts.where(F.col("id") % 2 == 0), path)
    refresh_page_index(facts, path, [str(r[0]) for r in facts.select("created_date").distinct().collect()])
    kw = dict(app="app-2", as_of=AS_OF, days=30, limit=10, offset=20)
    assert page_at(facts, path, **kw).total == P.page_info(facts, **kw)["total"]


def brute_new(data, day, history=30):
    """data: {(prefix, date): n}."""
    past = {day - dt.timedelta(days=i) for i in range(1, history + 1)}
    return sorted((p, n) for (p, d), n in data.items() if d == day and not any((p, x) in data for x in past))


@pytest.fixture(scope="module")
def sparse(spark):
    """Prefixes seen 1, 29, 30, 31, 32 and 60 days apart, over 95 days; NULL messages; text beyond the prefix."""
    first = dt.date(2024, 1, 1)
    data = {}
    for gap in (1, 29, 30, 31, 32, 60):
        for k in range(0, 95, gap):
            data[f"every {gap}", first + dt.timedelta(days=k)] = 1 + gap % 3
    data["once", first + dt.timedelta(days=40)] = 2
    rows_ = [(p + " " * (20 - len(p)) + "tail", d) for (p, d), n in data.items() for _ in range(n)] + [(None, first)]
    return data, spark.createDataFrame(rows_, "error_message string, created_date date").repartition(4).cache(), first


def test_masks_advance_day_by_day(spark, sparse, tmp_path):
    data, facts, first = sparse
    path = str(tmp_path / "masks")
    start = first + dt.timedelta(days=28)
    build_error_days(facts, path, start, width=20)
    for k in range(29, 36):
        day = first + dt.timedelta(days=k)
        advance_error_days(facts, path, day, width=20)
        advance_error_days(facts, path, day, width=20)  # a repeat changes nothing
        got = sorted((r.new_error.strip(), r.occurrences) for r in new_errors_of_day(facts, path, day, width=20).collect())
        assert got == brute_new(data, day), day
    build_error_days(facts, str(tmp_path / "other"), first + dt.timedelta(days=35), width=20)
    assert rows(read_error_days(spark, path, first + dt.timedelta(days=35))) == rows(
        read_error_days(spark, str(tmp_path / "other"), first + dt.timedelta(days=35)))


@pytest.mark.parametrize("gap", [2, 30, 31, 59])
def test_masks_over_a_gap(sparse, tmp_path, gap):
    """Days without any report between two snapshots."""
    data, facts, first = sparse
    a, b = first + dt.timedelta(days=1), first + dt.timedelta(days=1 + gap)
    quiet = facts.where((F.col("created_date") <= F.lit(a)) | (F.col("created_date") == F.lit(b)))
    path = str(tmp_path / "masks")
    build_error_days(quiet, path, a, width=20)
    advance_error_days(quiet, path, b, previous=a, width=20)
    left = {(p, d): n for (p, d), n in data.items() if d <= a or d == b}
    got = sorted((r.new_error.strip(), r.occurrences) for r in new_errors_of_day(quiet, path, b, width=20).collect())
    assert got == brute_new(left, b)


def test_mask_bounds(sparse, tmp_path):
    _, facts, first = sparse
    with pytest.raises(ValueError):
        new_errors_of_day(facts, str(tmp_path), first, history_days=31)
    with pytest.raises(ValueError):
        advance_error_days(facts, str(tmp_path), first, previous=first)


def test_table_functions_prune_dates(spark, facts):
    register_views(spark, facts)
    register_functions(spark)
    for name in FUNCTIONS:
        assert spark.catalog.functionExists(name)
    df = spark.sql(f"SELECT * FROM hourly_trend(TIMESTAMP_NTZ '{AS_OF}', 3) WHERE crashes > 0")
    assert rows(df) == rows(P.hourly_trend(facts, as_of=AS_OF, days=3))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan and "PartitionFilters: [isnotnull(created_date" in scan
