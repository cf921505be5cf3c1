"""The corpus pipeline stage by stage against plain versions, each stage on what its predecessor kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from crashlens.llm.decontaminate import contaminated
from crashlens.llm.quality import judge
from tests.llm import brute
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again as ``run`` does."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    root = tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_stages_and_their_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]


def test_quality_rules_drop_what_the_operator_rejects(stages):
    before, after = stages["quality_rules"]
    assert after.columns == COLUMNS
    kept = {r.doc_id for r in judge(before).where("q.kept").select("row.doc_id").collect()}
    assert rows(after) == [r for r in rows(before) if r[0] in kept]
    assert all(brute.base_quality(r[1])[0] >= 50 for r in rows(after)) and 100 < len(kept) < 200


def test_near_dedup_keeps_the_first_of_each_group(stages):
    before, after = stages["near_dedup"]
    groups = brute.near_groups([(r[0], r[1]) for r in rows(before)])
    assert rows(after) == [r for r in rows(before) if groups[r[0]][1] == r[0]]
    assert len(rows(after)) < len(rows(before))


def test_decontamination_drops_documents_with_an_item(spark, stages):
    before, after = stages["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = [" ".join(r.text.split()) for r in items.collect()]
    found = {r.doc_id for r in contaminated(before, items).collect()}
    assert {r[0] for r in rows(before) if any(x in " ".join(r[1].split()) for x in plain)} <= found
    assert rows(after) == [r for r in rows(before) if r[0] not in found] and found


def test_mixing_meets_the_targets(stages):
    before, after = stages["mixing"]
    assert after.columns == COLUMNS
    size = {r[0]: len(brute.words(r[1])) for r in rows(before)}
    sizes, taken, copies = defaultdict(int), Counter(), Counter(r[0] for r in rows(after))
    for r in rows(before):
        sizes[r[3]] += size[r[0]]
        taken[r[3]] += size[r[0]] * copies[r[0]]
    assert set(rows(after)) <= set(rows(before)) and max(copies.values()) <= 2
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(size[r[0]] for r in rows(before) if r[3] == source)


def test_sharding_places_every_copy_once(stages):
    before, after = stages["sharding"]
    placed = after.collect()
    assert Counter(r[0] for r in rows(before)) == Counter(r.doc_id for r in placed)
    load, slots = Counter(), defaultdict(list)
    for r in placed:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load[s] for s in range(16)) <= 2 * max(r.size for r in placed)


@pytest.mark.parametrize("kind", ["empty", "null", "odd"])
def test_every_stage_on_edge_tables(spark, edge_rows, kind):
    """No rows, rows of nulls, and odd rows with extra columns of clashing names: no stage fails, and each of the
    filters returns rows of its input."""
    data = {"empty": [], "null": [(None,) * 5] * 3, "odd": [(i, t, "en", None, None) for i, t in edge_rows]}[kind]
    docs = spark.createDataFrame(data, DOC_SCHEMA)
    if kind == "odd":
        docs = docs.selectExpr("*", "'x' as q", "'x' as m", "'x' as row", "'x' as copy")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns and set(map(str, out.collect())) <= set(map(str, docs.collect()))
        else:
            assert out.count() == docs.count()
