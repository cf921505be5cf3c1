"""Merkle dataset manifest by nested-struct rollup.

Rows are ranked inside their group; the digits of the rank are grouped away one by one inside
bounded blocks, so that a block becomes one row whose struct nests its children.  Block roots
are the leaves of the next round, until one node a group is left.  Proofs are emitted by
walking each nested struct down with ``transform`` and one ``explode``: no leaf is joined with
its siblings.  Only rows that stand for whole blocks meet the path above them in a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch

#: Columns of a leaf, in the order in which they are hashed.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits of the rank inside one block: a block nests at most ARITY ** BLOCK_DIGITS leaves.
ARITY, BLOCK_DIGITS = 2, 10
#: Bits of a row's place inside its write task, as ``monotonically_increasing_id`` lays them out.
_PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation (digests enter as hex text)."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row's ``LEAF_COLUMNS``; ``replaced`` gives other values for some of them."""
    return digest(*[framed(replaced.get(c, F.col(c))) for c in LEAF_COLUMNS])


def tampered(id_col: str = "doc_id") -> Column:
    """Rows whose unsigned crc32 of the decimal id is a multiple of 7 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, F.lit(False))


@dataclass
class _Tree:
    """Stored blocks of every round, the lowest first, and the digits that each round rolled up."""

    blocks: list[DataFrame] = field(default_factory=list)
    digits: list[int] = field(default_factory=list)


class _Rollup:
    """Trees over the rows of each ``group``; at most ``arity`` nodes become one."""

    def __init__(self, scratch: Scratch, arity: int, block_digits: int):
        if arity < 2 or block_digits < 1:
            raise ValueError("arity must be at least 2 and block_digits at least 1")
        self.scratch, self.arity, self.block_digits = scratch, arity, block_digits

    def ranked(self, rows: DataFrame, order: list[str], name: str) -> DataFrame:
        """``rows`` (with ``group``) plus ``index``, the 0-based rank in the group, and ``levels``, the
        height of the group's tree.

        Rows are dealt by ranges of (group, order) and written in order, with their place in the
        write task.  Counts of each (range, group) then give every range its start, so no group
        is ever ranked in one task.
        """
        ranges = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
        stored = self.scratch.save(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
        run = F.shiftright("_at", _PLACE_BITS)
        runs = stored.groupBy("group", run.alias("_run")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        in_group = Window.partitionBy("group")
        earlier = in_group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        starts = runs.select(F.col("group").alias("_group"), F.col("_run").alias("_range"), "_first",
                             F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                             F.sum("_n").over(in_group).alias("_total"))
        met = (F.col("group").eqNullSafe(F.col("_group"))) & (run == F.col("_range"))
        height = sum((F.col("_total") > F.lit(self.arity ** i)).cast("int") for i in range(self._highest()))
        out = stored.join(starts, met).withColumns(
            {"index": F.col("_before") + F.col("_at") - F.col("_first"), "levels": height})
        return out.drop("_at", "_group", "_range", "_first", "_before", "_total")

    def _highest(self) -> int:
        """Levels that any count of rows below 2 ** 62 can need."""
        i = 0
        while self.arity ** i < 1 << 62:
            i += 1
        return i

    def climb(self, nodes: DataFrame, name: str) -> tuple[DataFrame, _Tree]:
        """Roll ``nodes`` (group, index, levels, node: a struct with ``hash``) up to one row a group.

        Returns (group, hash) of the roots and the stored blocks.
        """
        tree = _Tree()
        height = nodes.agg(F.max("levels")).first()[0] or 0
        while True:
            digits = max(1, min(self.block_digits, height))
            blocks = self.scratch.save(self._blocks(nodes, digits), f"{name}-{len(tree.blocks)}")
            tree.blocks.append(blocks)
            tree.digits.append(digits)
            height -= digits
            nodes = blocks.select("group", F.col("block").alias("index"), "levels", F.struct("node.hash").alias("node"))
            if height <= 0:
                return nodes.select("group", "node.hash"), tree

    def _blocks(self, nodes: DataFrame, digits: int) -> DataFrame:
        """(group, block, levels, node): one row a block, its node nesting ``digits`` levels of children.

        All groupings share the one shuffle by (group, block).  A level above the top of a
        group's tree has a single node a group, which passes unchanged (``hashed`` false).
        """
        size = self.arity ** digits
        names = [f"d{i}" for i in range(digits)]  # d0: the lowest digit
        place = F.col("index") % size
        keys = {f"d{i}": (F.floor(place / self.arity ** i) % self.arity).cast("int") for i in range(digits)}
        rows = nodes.withColumns({"block": F.floor(F.col("index") / size), **keys})
        rows = rows.select("group", "block", "levels", *names, "node").repartition("group", "block")
        for i in range(digits):
            grouped = rows.groupBy("group", "block", "levels", *names[i + 1:]).agg(
                F.array_sort(F.collect_list(F.struct(names[i], "node"))).alias("_kids"))
            hashed = F.col("levels") > i
            above = F.when(hashed, digest(F.array_join(F.col("_kids.node.hash"), ""))).otherwise(F.col("_kids")[0]["node"]["hash"])
            rows = grouped.select("group", "block", "levels", *names[i + 1:], F.struct(
                above.alias("hash"), hashed.alias("hashed"), F.col("_kids.node").alias("kids")).alias("node"))
        return rows.withColumn("levels", F.greatest(F.col("levels") - digits, F.lit(0)))

    def descend(self, tree: _Tree, tops: DataFrame) -> DataFrame:
        """Leaves (group, node, path, and the other columns of ``tops``) of all groups.

        ``tops`` has one row a group: group, ``path`` (from its root upwards) and any columns that
        the leaves should carry.  A path is an array of (before, after): the siblings' digests on
        either side, lowest level first.
        """
        carried = [c for c in tops.columns if c not in ("group", "path")]
        paths = tops.withColumn("index", F.lit(0).cast("long"))
        for blocks, digits in reversed(list(zip(tree.blocks, tree.digits, strict=True))):
            above = paths.select(F.col("group").alias("_group"), F.col("index").alias("_index"), "path", *carried)
            met = F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_index"))
            here = blocks.select("group", "block", "node").join(above, met)
            found = F.array(F.struct(F.col("node"), F.col("path"), F.lit(0).cast("long").alias("at")))
            for _ in range(digits):
                found = F.flatten(F.transform(found, self._step))
            flat = here.select("group", "block", *carried, F.explode(found).alias("_leaf"))
            paths = flat.select("group", (F.col("block") * self.arity ** digits + F.col("_leaf.at")).alias("index"),
                                "_leaf.node", "_leaf.path", *carried)
        return paths

    def _step(self, above: Column) -> Column:
        """A nested node's children, each with its path, now one entry longer."""
        kids, hashed = above["node"]["kids"], above["node"]["hashed"]

        def child(kid: Column, i: Column) -> Column:
            hashes = F.transform(kids, lambda k: k["hash"])
            sides = F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"),
                             F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "").alias("after"))
            longer = F.when(hashed, F.concat(F.array(sides), above["path"])).otherwise(above["path"])
            return F.struct(kid.alias("node"), longer.alias("path"), (above["at"] * self.arity + i).alias("at"))

        return F.transform(kids, child)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", tamper: Column | None = None,
             arity: int = ARITY, block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path, claimed (the leaf after tampering).

    A leaf is the digest of ``LEAF_COLUMNS``.  In each group (a null group is one of its own)
    leaves ascend by id; every ``arity`` consecutive nodes, the last run maybe fewer, become their
    digest until one is left: the subroot; a lone leaf is its own subroot.  Subroots, by group
    with null first and UTF-8 bytewise, likewise give the root.  ``tamper`` marks rows whose claimed
    leaf has 1 added to n_chars (null stays null); other rows claim their leaf.

    Null and equal ids: nulls come first, equal ids are ordered by leaf; rows alike in every leaf
    column are interchangeable but each is a leaf.  Empty texts have byte count 0, unlike null
    ones; texts of any length only enter their digest.  An empty table gives no rows.  Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    rollup = _Rollup(scratch, arity, block_digits)
    leaf = leaf_digest()
    changed = leaf_digest(n_chars=F.col("n_chars") + 1)
    rows = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("_id"), leaf.alias("_leaf"),
                       F.when(tamper, changed).alias("_changed") if tamper is not None else F.lit(None).cast("string").alias("_changed"))
    # stored once: digests are not computed again, and each row has a number that parts equal rows
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    ranked = rollup.ranked(rows, ["_id", "_leaf", "_row"], "ranked")
    node = F.struct(F.col("_leaf").alias("hash"), F.col("_changed").alias("changed"), F.col("_id").alias("id"))
    subroots, tree = rollup.climb(ranked.select("group", "index", "levels", node.alias("node")), "blocks")

    named = subroots.select(F.lit(0).alias("group"), F.col("group").alias("_name"), "hash")
    tops = rollup.ranked(named, ["_name"], "groups")
    top = F.struct("hash", F.col("_name").alias("name"))
    roots, crown = rollup.climb(tops.select("group", "index", "levels", top.alias("node")), "crown")
    start = F.array().cast("array<struct<before:string,after:string>>")
    upper = rollup.descend(crown, roots.select("group", start.alias("path"), F.col("hash").alias("root")))
    upper = scratch.save(upper.select(F.col("node.name").alias("group"), F.col("node.hash").alias("subroot"), "root", "path"), "upper")
    leaves = rollup.descend(tree, upper)
    return leaves.select(F.col("node.id").alias(id_col), F.col("node.hash").alias("leaf"), "subroot", "root", "path",
                         F.coalesce("node.changed", "node.hash").alias("claimed"))
