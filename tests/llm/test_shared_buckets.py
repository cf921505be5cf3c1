"""Many buckets with the same largest component meet as one, and no link is lost."""

import random

from pyspark.sql import functions as F

from crashlens.llm import minhash as M
from tests.llm import brute
from tests.llm.conftest import prose


def family(copies, far):
    """Texts that differ in one word from another, so form one component, and texts too far from these and each other."""
    r, words, rows = random.Random(5), prose(77, 150).split(), []
    for i in range(copies + far):
        text = list(words)
        for at in r.sample(range(len(text)), 1 if i < copies else 9):
            text[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    return rows


def test_places_of_a_family(make_docs, monkeypatch):
    rows, places = family(80, 60), []
    in_cells = M.in_cells

    def counted(cells):
        places.append((cells.count(), cells.select("node").distinct().count()))
        return in_cells(cells)

    monkeypatch.setattr(M, "in_cells", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(make_docs(rows)).collect()}
    assert got == brute.near_groups(rows)
    (signatures, nodes), (sets, _) = places
    assert nodes > 100 and signatures <= 4 * nodes and sets <= 4 * nodes


def test_gathered_keeps_every_pair(spark, tmp_path):
    """Each pair of different components that shares a bucket still shares one; buckets that would cost more stay apart."""
    r = random.Random(3)
    comp = {n: 0 if n < 30 else n // 3 for n in range(90)}
    buckets = {k: r.sample(range(90), r.randrange(2, 30)) for k in range(40)}
    buckets |= {100 + k: [200 + 2 * k, 201 + 2 * k, 500, 501] for k in range(20)}  # few nodes in common
    comp |= {n: 500 if n >= 500 else n for n in (*range(200, 240), 500, 501)}
    rows = [(k, n, comp[n], 1) for k, nodes in buckets.items() for n in nodes]

    class Here:
        def save(self, df, name):
            df.write.parquet(str(tmp_path / name))
            return spark.read.parquet(str(tmp_path / name))

    met = M.gathered(spark.createDataFrame(rows, "key long, node long, comp long, weight long"), Here())
    found = {r.key: set(r.nodes) for r in met.groupBy("key").agg(F.collect_list("node").alias("nodes")).collect()}
    pairs = lambda all_of: {(a, b) for nodes in all_of for a in nodes for b in nodes if a < b and comp[a] != comp[b]}
    assert pairs(buckets.values()) <= pairs(found.values())
    assert min(found) < 0 and {100 + k for k in range(20)} <= set(found)
    assert met.count() == sum(map(len, found.values())) < len(rows)
