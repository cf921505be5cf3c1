"""Near-duplicate groups: b-bit MinHash signatures, multi-index Hamming join, exact check.

A signature is ``CHUNKS`` chunks of four 14-bit minima.  Two signatures that differ in
fewer than ``2 * CHUNKS`` minima have, by pigeonhole, a chunk with at most one
differing minimum; enumerating the allowed error (each of the four places left out)
turns that into equality of one of ``4 * CHUNKS`` keys, so every such pair meets.  Sets
with a similarity of 0.75 miss all keys with probability 3e-8.

Buckets with the same members count as one.  Pairs in a bucket are never all listed: in
each round a node is compared with one hub of another component, the one that it meets in
most buckets, and what is linked becomes one component.  Then only members outside a
bucket's largest component are compared with the others, first by signature: nodes of different
components within ``DISTANCE`` differing minima, and with sizes that allow the similarity, form
groups.  Buckets with the same largest component meet as one, each node once, wherever that compares
no more pairs; in the others a pair counts in the first of its buckets alone, which both signatures
tell.  So few groups hold a node; their full sets are compared in blocks of bounded size that return
links alone.  Every link is one of full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.llm.scratch import Scratch
from crashlens.llm.words import LONGS, Words, lists, longs, mix, record, slices

SHINGLE = 5
CHUNKS = 13
LANES, LANE_BITS, VALUE_BITS = 4, 15, 14
#: Signatures of a pair within this many differing minima are compared in full.  A similarity of
#: 0.75 leaves more than 29 of 52 differing with a probability of 5e-7, a higher one less often.
DISTANCE = 29
#: Signatures of a block; a bucket of fewer nodes is one cell.
SIGNATURES = 1 << 14
#: Rows of a cell compared with all its columns at a time.
STRIP = 64
#: Shingles of a block of sets, each set counted with ``EXTRA`` more, so that a block has
#: 1,024 short sets at most on average.
BLOCK, EXTRA = 1 << 18, 256
#: Columns of the 0/1 matrices whose product counts what two blocks share.
COLUMNS = 4096
#: What a set is in a cell: a row (an outsider), a column, or both.
ROW, COLUMN = 1, 2
BROADCAST_ROWS = 1_000_000

_SEEDS = mix(np.arange(1, 2 * CHUNKS * LANES + 1, dtype=np.uint64))
_FACTOR, _SHIFT = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted: values, offsets, sizes."""
    w = Words(texts, lower=True)
    n = len(w.count)
    x, whole = w.windows(SHINGLE)
    values, docs = [x[whole]], [w.doc[:len(x)][whole]]
    for k in range(1, SHINGLE):
        rows = np.flatnonzero(w.count == k)
        if len(rows):
            values.append(w.windows(k)[0][w.offset[rows]])
            docs.append(rows)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, size = value[new], np.bincount(doc[new], minlength=n)
    return value, np.concatenate([[0], np.cumsum(size)]), size


_LONG = T.LongType()


@F.arrow_udf(record(n=_LONG, k1=_LONG, k2=_LONG, sig=LONGS))
def signature(texts: pa.Array) -> pa.Array:
    """Size, 128-bit digest and packed signature of each row's shingle set."""
    parts = []
    for lo, hi in slices(texts):
        value, offset, size = shingles(texts.slice(lo, hi - lo))
        some = np.flatnonzero(size)
        at = offset[some]
        packed = np.zeros((len(some), CHUNKS), np.uint64)
        digests = np.zeros((2, len(size)), np.uint64)
        if len(some):
            for i in range(CHUNKS * LANES):
                least = np.minimum.reduceat(value * _FACTOR[i] + _SHIFT[i], at)
                packed[:, i // LANES] |= (mix(least) >> np.uint64(64 - VALUE_BITS)) << np.uint64(LANE_BITS * (i % LANES))
            digests[0, some] = np.add.reduceat(mix(value), at)
            digests[1, some] = np.add.reduceat(mix(value ^ _SEEDS[0]), at)
        sig_at = np.concatenate([[0], np.cumsum((size > 0) * CHUNKS)])
        parts.append(pa.StructArray.from_arrays(
            [pa.array(size.astype(np.int64)), pa.array(longs(digests[0])), pa.array(longs(digests[1])),
             lists(longs(packed.ravel()), sig_at)], ["n", "k1", "k2", "sig"]))
    return pa.concat_arrays(parts)


@F.arrow_udf(LONGS)
def shingle_set(texts: pa.Array) -> pa.Array:
    """Each row's full shingle set."""
    parts = []
    for lo, hi in slices(texts):
        value, offset, _ = shingles(texts.slice(lo, hi - lo))
        parts.append(lists(longs(value), offset))
    return pa.concat_arrays(parts)


def index_keys(sig: str) -> Column:
    """The ``4 * CHUNKS`` keys: chunk number, place left out, the other three minima."""
    keys = []
    for c in range(CHUNKS):
        chunk = F.col(sig)[c]
        for out in range(LANES):
            below = chunk.bitwiseAND(F.lit((1 << LANE_BITS * out) - 1))
            above = F.shiftleft(F.shiftright(chunk, LANE_BITS * (out + 1)), LANE_BITS * out)
            tag = (c * LANES + out) << LANE_BITS * (LANES - 1)
            keys.append(below.bitwiseOR(above).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp): smallest node reachable, for all nodes of ``links`` (a, b).

    Each step takes the least label among neighbours, then follows that label once.
    """
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    label = scratch.save(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("a"), F.min("b")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(label, both["b"] == label["node"]).select(F.col("a").alias("node"), "comp")
        least = label.union(near).groupBy("node").agg(F.min("comp").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        old = label.select("node", F.col("comp").alias("old"))
        new = (least.join(jump, "comp", "left").join(old, "node")
               .select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old"))
        new = scratch.save(new, f"{name}-{step}")
        moved = new.where("comp <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        label = new.select("node", "comp")
        if not moved:
            return label


def buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, weight): members of all buckets of two or more nodes.

    Of buckets with the same members one is kept; ``weight`` is their number.  Digests of members
    are taken after the buckets of one node are gone, so that what is shuffled for each key is a count.
    """
    keys = nodes.select(F.explode(index_keys("sig")).alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    met = scratch.save(keys.join(shared, "key"), "met")
    return scratch.save(once(met), "members")


def once(members: DataFrame) -> DataFrame:
    """``members`` of one of all buckets with the same nodes, with the number of these as ``weight``."""
    shape = members.groupBy("key").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    kept = shape.groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    return members.join(kept.select("key", "weight"), "key")


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with ``comp``, which is the node itself where it has no link."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Each node with the hub of another component that most of its buckets have."""
    hubs = members.groupBy("key").agg(
        F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("r"), F.col("node").alias("hub"),
                       F.col("comp").alias("hub_comp"))).alias("h"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "h.hub", "h.hub_comp")
    met = members.join(hubs, "key").where("comp <> hub_comp").groupBy("node", "hub").agg(F.sum("weight").alias("c"))
    best = met.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("h"))
    return best.select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.75 or more."""
    a, b = sets.toDF("a", "s_a"), sets.toDF("b", "s_b")
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"),
                                                  shared.alias("i"))
    return both.where("100 * i >= 75 * (n_a + n_b - i)").select("a", "b")


def gathered(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, comp): members of buckets with several components, few buckets for a node.

    A large component is the largest one of hundreds of buckets, which hold much the same nodes.  Buckets
    with the same largest component become one, with each of their nodes once and ``~component``, which
    is below 0, as key, if (outsiders) x (members) is then no more than the sum of this over the buckets.
    All pairs of a bucket are among those of the one that it becomes part of.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("c"),
                                     F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("key", F.col("main.comp").alias("main"), "c")
    met = scratch.save(members.join(mixed, "key").select("key", "main", "c", "node", "comp"), "mixed")
    outside = F.col("comp") != F.col("main")
    once_each = met.groupBy("main", "node", "comp").agg(F.sum("c").alias("c"))
    one = once_each.groupBy("main").agg(F.count("*").alias("all"), F.count_if(outside).alias("out"),
                                        F.sum(F.when(outside, F.col("c"))).alias("apart"))
    one = scratch.save(one.where(F.col("out") * F.col("all") <= F.col("apart")).select("main", F.lit(True).alias("one")), "one")
    one = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
    key = F.when(F.col("one"), F.bitwise_not("main")).otherwise(F.col("key"))
    return met.join(one, "main", "left").select(key.alias("key"), "node", "comp").distinct()


def dealt(members: DataFrame, weight: Column, block: int) -> DataFrame:
    """(key, i, j, role, node, comp): places of the members of buckets with several components.

    The outsiders (members outside their bucket's largest component) and all members of a bucket
    are dealt by a hash into blocks of about ``block`` by ``weight``; each block of outsiders meets
    each block of members in one cell, a bounded piece of work.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("main"), F.sum("w").alias("w"),
                                    F.count("*").alias("parts")).where("parts > 1")
    shape = main.select("key", F.col("main.comp").alias("main"), F.ceil((F.col("w") - F.col("main.w")) / block).alias("rows"),
                        F.ceil(F.col("w") / block).alias("columns"))
    i, j = F.pmod(F.xxhash64("node"), F.col("rows")), F.pmod(F.xxhash64("node"), F.col("columns"))
    as_row = F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1),
                         lambda k: F.struct(i.alias("i"), k.alias("j"), F.when(k == j, ROW + COLUMN).otherwise(ROW).alias("role")))
    as_column = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1),
                            lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(COLUMN).alias("role")))
    elsewhere = F.filter(as_column, lambda place: place["i"] != i)  # its own cell has it as a row already
    places = F.when(F.col("comp") != F.col("main"), F.concat(as_row, elsewhere)).otherwise(as_column)
    return (members.join(shape, "key").select("key", "node", "comp", F.explode(places).alias("place"))
            .select("key", "place.*", "node", "comp"))


def in_cells(cells: DataFrame) -> DataFrame:
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_groups(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, comp, n): groups of a bucket's nodes that signatures do not tell apart, as new keys.

    Within a cell, outsiders and members of other components that lie within ``DISTANCE`` are joined
    into groups; a node near none of another component is in none.  At most one row a place.
    A pair's first bucket (the least key that both have) is among ``members``: of buckets with
    the same members the least key was kept.  If it became part of another, the pair counts there.
    """
    places = scratch.save(gathered(members, scratch), "gathered")
    cells = dealt(places, F.lit(1), SIGNATURES).join(nodes.select("node", "n", "sig"), "node")
    found = in_cells(cells).mapInArrow(_near, "key long, i long, j long, least long, node long, comp long, n long")
    return found.select(F.xxhash64("key", "i", "j", "least").alias("key"), "node", "comp", "n")


def block_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of members outside their group's largest component with members of other components."""
    cells = dealt(groups, F.col("n") + EXTRA, BLOCK).join(sets, "node")
    return in_cells(cells).mapInArrow(_linked, "a long, b long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run with equal (key, i, j)."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
            if lo == hi:
                continue
            if held and last != tuple(cell[lo]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tuple(cell[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in _cells(batches):
        yield from _cell_groups(cell)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in _cells(batches):
        yield from _cell_links(cell)


def _find(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x


def _cell_groups(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """Groups of a cell's rows and columns of other components within ``DISTANCE``."""
    role = cell["role"].to_numpy()
    a, b = np.flatnonzero(role & ROW), np.flatnonzero(role & COLUMN)
    if not len(a) or not len(b):
        return
    comp, size = cell["comp"].to_numpy(), cell["n"].to_numpy()
    chunk = cell["sig"].chunk(0).flatten().to_numpy().reshape(-1, CHUNKS)
    minima = np.stack([(chunk >> LANE_BITS * k) & ((1 << VALUE_BITS) - 1) for k in range(LANES)], 2).astype(np.uint16)
    right = np.ascontiguousarray(minima[b].transpose(1, 2, 0))
    key = cell["key"][0].as_py()
    # chunk and place left out; below 0 are buckets of one component, where every pair counts
    own, out = divmod(key >> LANE_BITS * (LANES - 1), LANES) if key >= 0 else (0, 0)
    root: dict[int, int] = {}
    label, met = np.arange(len(role)), np.zeros(len(role), bool)
    for lo in range(0, len(a), STRIP):
        rows = a[lo:lo + STRIP]
        equal, first = np.zeros((len(rows), len(b)), np.uint8), np.ones((len(rows), len(b)), bool)
        for c in range(CHUNKS):
            alike = sum((minima[rows, c, k][:, None] == right[c, k]).view(np.uint8) for k in range(LANES))
            equal += alike
            if c < own or c == own and out:
                first &= alike < LANES - (c < own)
        small = np.minimum(size[rows][:, None], size[b])
        large = np.maximum(size[rows][:, None], size[b])
        near = (first & (equal >= CHUNKS * LANES - DISTANCE) & (100 * small >= 75 * large)
                & (comp[rows][:, None] != comp[b]))
        for x, hit in zip(rows[near.any(axis=1)], near[near.any(axis=1)]):
            met[x] = True
            met[b[hit]] = True
            for other in np.unique(label[b[hit]]):
                p, q = _find(root, int(x)), _find(root, int(other))
                root[max(p, q)] = min(p, q)
        label = np.array([_find(root, x) for x in range(len(role))])
    at = np.flatnonzero(met)
    if len(at):
        places = [pa.array(cell[c].to_numpy()[at].astype(np.int64)) for c in ("key", "i", "j")]
        node = cell["node"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [*places, *(pa.array(x) for x in (node[label[at]], node[at], comp[at], size[at]))],
            ["key", "i", "j", "least", "node", "comp", "n"])


def _cell_links(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of a cell, without those that close a circle."""
    role = cell["role"].to_numpy()
    a, b = np.flatnonzero(role & ROW), np.flatnonzero(role & COLUMN)
    if not len(a) or not len(b):
        return
    node, comp, sets = cell["node"].to_numpy(), cell["comp"].to_numpy(), cell["s"].chunk(0)
    size, value = pc.list_value_length(sets).to_numpy().astype(np.int64), sets.flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    common, times = np.unique(value, return_counts=True)
    common = common[times > 1]
    if not len(common):
        return
    column = np.searchsorted(common, value)
    column[column == len(common)] = 0
    hit = common[column] == value
    row, column = row[hit], column[hit]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(a), len(b)))
    for lo in range(0, len(common), COLUMNS):
        s, e = np.searchsorted(column, [lo, lo + COLUMNS])
        holds = np.zeros((len(size), min(COLUMNS, len(common) - lo)), np.float32)
        holds[row[s:e], column[s:e] - lo] = 1
        shared += holds[a] @ holds[b].T
    linked = (100 * shared >= 75 * (size[a][:, None] + size[b] - shared)) & (comp[a][:, None] != comp[b])
    root: dict[int, int] = {}
    kept = []
    for x, y in zip(*np.nonzero(linked)):
        p, q = _find(root, int(comp[a[x]])), _find(root, int(comp[b[y]]))
        if p != q:
            root[p] = q
            kept.append((node[a[x]], node[b[y]]))
    if kept:
        ends = np.array(kept, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def node_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, s): the full shingle set of each node in a bucket."""
    need = members.select("node").distinct().join(nodes, "node").select("node", "id", "t")
    need = scratch.save(need, "need")
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    text = docs.withColumn("_t", F.xxhash64("_text"))
    found = text.join(need, text["_id"].eqNullSafe(need["id"]) & (text["_t"] == need["t"]))
    return scratch.save(found.dropDuplicates(["node"]).select("node", shingle_set("_text").alias("s")), "sets")


def linked_nodes(docs: DataFrame, nodes: DataFrame, rounds: int, scratch: Scratch) -> DataFrame | None:
    """(node, comp) of all nodes with a link; None if there are no links."""
    members = buckets(nodes, scratch)
    sets = node_sets(docs, nodes, members, scratch)
    links: DataFrame | None = None
    labels: DataFrame | None = None
    first, step, hubs = 0, 0, True
    while True:
        hubs = hubs and step < rounds
        here = labelled(members, labels)
        if hubs:
            made = confirmed(hub_pairs(here, step), sets)
        else:
            groups = scratch.save(near_groups(here, nodes, scratch), "near")
            made = block_links(groups, sets)
        made = scratch.save(made, f"links-{step}")
        found = made.count()
        if found:
            links = made if links is None else links.union(made)
            labels = components(links, scratch, f"labels-{step}")
        if not hubs:
            return labels
        first, step = first or found, step + 1
        hubs = 10 * found > first  # the blocks find what is left


def near_duplicates(docs: DataFrame, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text",
                    keep_row: bool = False) -> DataFrame:
    """Groups of documents linked by a shingle-set similarity of 0.75 or more.

    Output, one row for each input row: id, n_shingles, component_id (smallest id of
    the group), kept (id = component_id), first (true for exactly one row of each group)
    and, with ``keep_row``, ``row`` (a struct of all columns of ``docs``).  A text without words, or null, has an empty set, is linked with nothing
    and kept.  Rows with equal sets are one node, so copies are never paired.  A group of
    rows that all lack an id has a null component_id and is kept; ``first`` still picks one.
    Empty table: no rows.  Extra columns of any name are ignored or stay
    in ``row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       *([F.struct("*").alias("row")] if keep_row else []))
    made = base.withColumn("_s", signature("_text"))
    rows = scratch.save(made.select(
        F.col("_id").alias("id"), F.xxhash64("_text").alias("t"), F.monotonically_increasing_id().alias("rid"),
        "_s.*", *(["row"] if keep_row else [])), "rows")
    whole = rows.where("n > 0")
    # null ids sort last: a struct compares its fields in turn
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "rid", "t")
    classes = (whole.groupBy("k1", "k2").agg(F.min(lead).alias("lead"), F.first("n").alias("n"), F.first("sig").alias("sig"))
               .select("k1", "k2", "n", "sig", "lead.*"))
    nodes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = linked_nodes(base.select("_id", "_text"), nodes, rounds, scratch)
    of = labelled(nodes.select("k1", "k2", "node", "none", "id", "rid"), labels)
    top = of.groupBy("comp").agg(F.min(F.struct("none", "id", "rid")).alias("top"))
    groups = of.join(top, "comp").select("k1", "k2", F.col("top.id").alias("component_id"), F.col("top.rid").alias("lead_rid"))
    groups = scratch.save(groups, "groups")
    empty = rows.where("n = 0").withColumns({"component_id": F.col("id"), "lead_rid": F.col("rid")})
    out = whole.join(groups, ["k1", "k2"]).unionByName(empty)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("rid") == F.col("lead_rid")).alias("first"),
        *(["row"] if keep_row else []))
