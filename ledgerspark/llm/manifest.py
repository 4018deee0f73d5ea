"""Merkle manifest of a dataset, and what each change of one row would make of it.

Rows are leaves; the leaves of a group, in order, carry a tree of runs of eight, and the groups'
roots carry another one up to the manifest's root. A tree is cut into aligned blocks of
``8 ** LEVELS`` consecutive nodes. A task builds one block at a time and gives its root, which is
a node of the next round, until each tree is one node: a handful of rounds for any size, and no
task ever holds more than a block.

The tree is persistent: a changed leaf makes a version that shares every node with the
original but the leaf's ancestors. Inside its block the version copies just these, beside
the siblings that it shares; above, it goes on along the path that the rounds hand down, one
row per block and round, so that the versions of a block are continued where the block is
and no upper node has to gather the versions of all leaves below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import lower_ascii, stored

#: Fixed value: nodes of a run.
RUN = 8
#: A block has RUN ** LEVELS nodes at its foot.
LEVELS = 3

NODES = "tree string, pos long, total long, digest binary"
PATHS = "tree string, block long, subroot binary, path array<binary>"


def field_bytes(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; numbers in decimal."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_bytes, columns)), 256))


def _joined(digests: list[bytes]) -> bytes:
    return b"".join(digests).hex().encode()


def parent(children: bytes) -> bytes:
    """The digest above a run, given its digests as hex text."""
    return sha256(children).digest()


class Block:
    """All nodes above some consecutive ones, as far as the block or its tree goes."""

    def __init__(self, digests: list[bytes], total: int, levels: int) -> None:
        self.levels = [digests]
        while total > 1 and len(self.levels) <= levels:
            below = self.levels[-1]
            self.levels.append([parent(_joined(below[i : i + RUN])) for i in range(0, len(below), RUN)])
            total = -(-total // RUN)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def shared(self, at: int) -> list[tuple[bytes, bytes]]:
        """What a version that changes node ``at`` shares, level by level: its siblings left and right."""
        out = []
        for level in self.levels[:-1]:
            start = at - at % RUN
            out.append((_joined(level[start:at]), _joined(level[at + 1 : start + RUN])))
            at //= RUN
        return out


def copied(digest: bytes, shared: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The new nodes of a version above its changed leaf, from its parent up."""
    out = []
    for left, right in shared:
        digest = parent(left + digest.hex().encode() + right)
        out.append(digest)
    return out


def _pairs(path: list[bytes]) -> list[tuple[bytes, bytes]]:
    return list(zip(path[::2], path[1::2], strict=True))


def placed(entries: DataFrame, order: list[str]) -> DataFrame:
    """``entries`` with ``pos`` in their ``tree`` and the tree's ``total``; any tree may hold all rows.

    Ranges of (tree, order) are sorted apart and raised by the rows of the ranges before, a
    running sum over one small row per range and tree. ``order`` must be total.
    """
    sorted_ranges = entries.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    runs = stored(sorted_ranges.withColumn("at", F.monotonically_increasing_id()), "manifest-runs")
    runs = runs.withColumn("part", F.shiftright("at", 33))
    spans = runs.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        "tree",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("rows").over(tree).alias("total"),
    )
    met = runs.join(offsets, ["tree", "part"])
    return met.withColumn("pos", F.col("at") + F.col("offset")).drop("at", "part", "offset")


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", 3 * levels))


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("pos")


def _raise(key: tuple, nodes: pa.Table, levels: int) -> pa.Table:
    total = nodes["total"][0].as_py()
    block = Block(_ordered(nodes)["digest"].to_pylist(), total, levels)
    above = -(-total // RUN**levels)
    return pa.table(
        {
            "tree": pa.array([key[0].as_py()], pa.string()),
            "pos": pa.array([key[1].as_py()], pa.int64()),
            "total": pa.array([above], pa.int64()),
            "digest": pa.array([block.root], pa.binary()),
        }
    )


def _hand_down(key: tuple, nodes: pa.Table, paths: pa.Table, levels: int) -> pa.Table:
    """The path above each node of a block: its siblings here, then the block's own path."""
    nodes, above = _ordered(nodes), paths["path"][0].as_py()
    block = Block(nodes["digest"].to_pylist(), nodes["total"][0].as_py(), levels)
    out = [[x for pair in block.shared(i) for x in pair] + above for i in range(nodes.num_rows)]
    return pa.table(
        {
            "tree": nodes["tree"],
            "block": nodes["pos"],
            "subroot": pa.array([paths["subroot"][0].as_py()] * nodes.num_rows, pa.binary()),
            "path": pa.array(out, pa.list_(pa.binary())),
        }
    )


@dataclass
class Forest:
    """The rounds of all trees: nodes of each round, and the root of each tree with its last round."""

    levels: int
    rounds: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None

    def paths(self, top: DataFrame) -> DataFrame:
        """(tree, block) rows for the blocks of the first round; ``top``: tree, subroot, path, round."""
        levels = self.levels

        def hand_down(key: tuple, nodes: pa.Table, paths: pa.Table) -> pa.Table:
            return _hand_down(key, nodes, paths, levels)

        paths = None
        for number in range(len(self.rounds) - 1, -1, -1):
            own = top.where(F.col("round") == number)
            own = own.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
            paths = own if paths is None else own.unionByName(paths)
            if number:
                blocks = self.rounds[number].groupBy("tree", "block")
                paths = blocks.cogroup(paths.groupBy("tree", "block")).applyInArrow(hand_down, PATHS)
        return paths


def build(nodes: DataFrame, levels: int) -> Forest:
    """``nodes``: tree, pos, total, digest of every leaf."""
    forest, roots = Forest(levels), []

    def raise_blocks(key: tuple, nodes: pa.Table) -> pa.Table:
        return _raise(key, nodes, levels)

    level = nodes.select("tree", "pos", "total", "digest")
    while True:
        blocked = _blocked(level, levels)
        forest.rounds.append(blocked)
        raised = stored(blocked.groupBy("tree", "block").applyInArrow(raise_blocks, NODES), "manifest-nodes")
        done = raised.where("total = 1")
        roots.append(done.select("tree", "digest", F.lit(len(forest.rounds) - 1).alias("round")))
        level = raised.where("total > 1")
        if level.isEmpty():
            forest.roots = reduce(DataFrame.unionByName, roots)
            return forest


def manifest(entries: DataFrame, copies: bool = False, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """``entries``: tree, id, digest, changed (binary; null where a leaf is not changed).

    Gives the root (one row: ``root``, no row for an empty table) and one row per entry: tree,
    id, digest, subroot, proof (SHA-256 of all siblings on the way up), folded (the root of
    the version in which this one leaf is the changed one, or of the original's path where it is
    not), and with ``copies`` the version's new nodes from the leaf's parent to its root. Entries of a
    tree are ordered by id (null first), equal ids by digest. Trees are ordered by name.
    """
    schema = "tree string, id long, digest binary, subroot binary, proof binary, folded binary"
    schema += ", copies array<binary>" if copies else ""
    numbered = entries.withColumn("tie", F.monotonically_increasing_id())
    leaves = stored(placed(numbered, ["id", "digest", "tie"]).drop("tie"), "manifest-leaves")
    forest = build(leaves, levels)
    # the trees' roots are leaves of one more tree
    names = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "round")
    upper = stored(placed(names, ["name"]), "manifest-trees")
    whole = build(upper, levels)
    no_path = F.array().cast("array<binary>").alias("path")
    start = whole.roots.select("tree", F.col("digest").alias("subroot"), no_path, "round")

    def name_paths(key: tuple, nodes: pa.Table, paths: pa.Table) -> pa.Table:
        down = _hand_down(key, nodes, paths, levels)
        nodes = _ordered(nodes)
        return pa.table(
            {"tree": nodes["name"], "subroot": nodes["digest"], "path": down["path"], "round": nodes["round"]}
        )

    tops = (
        _blocked(upper, levels)
        .groupBy("tree", "block")
        .cogroup(whole.paths(start).groupBy("tree", "block"))
        .applyInArrow(name_paths, "tree string, subroot binary, path array<binary>, round int")
    )
    paths = stored(forest.paths(stored(tops, "manifest-tops")), "manifest-paths")

    def versions(key: tuple, nodes: pa.Table, paths: pa.Table) -> pa.Table:
        nodes, above = _ordered(nodes), _pairs(paths["path"][0].as_py())
        original, changed = nodes["digest"].to_pylist(), nodes["changed"].to_pylist()
        block, upper_bytes = Block(original, nodes["total"][0].as_py(), levels), b"".join(a + b for a, b in above)
        proofs, folded, made = [], [], []
        for at, leaf in enumerate(original):
            shared, leaf = block.shared(at), changed[at] or leaf
            proofs.append(sha256(b"".join(a + b for a, b in shared) + upper_bytes).digest())
            made.append(copied(leaf, shared + above))
            folded.append(made[-1][-1] if made[-1] else leaf)
        columns = {
            "tree": nodes["tree"],
            "id": nodes["id"],
            "digest": nodes["digest"],
            "subroot": pa.array([paths["subroot"][0].as_py()] * nodes.num_rows, pa.binary()),
            "proof": pa.array(proofs, pa.binary()),
            "folded": pa.array(folded, pa.binary()),
        }
        if copies:
            columns["copies"] = pa.array(made, pa.list_(pa.binary()))
        return pa.table(columns)

    rows = _blocked(leaves, levels).groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(versions, schema)
    return whole.roots.select(F.col("digest").alias("root")), rows


def tree_name(group: Column) -> Column:
    """A name for each value that orders null first and the rest by bytes."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group))


def tampered(doc_id: Column) -> Column:
    """Rows whose text a test changes: 3 divides the CRC-32 of the decimal id; never a null id."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 0, F.lit(False))


def document_manifest(
    docs: DataFrame,
    columns: list[str] | None = None,
    group: str = "lang",
    doc_id: str = "doc_id",
    text: str = "text",
    changes: Column | None = None,
    copies: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof, folded_root (hex), verified.

    A leaf is the digest of ``columns`` (doc_id, source, lang, n_chars, text); documents of one
    ``group`` carry one tree, null being a group of its own. Where ``changes`` holds, the
    document's version has the text with A-Z lowered (null stays null); it is verified if its
    root is the manifest's, so only where the change alters nothing. Repeated rows are leaves of their own.
    An empty table gives an empty result; further columns are not looked at. ``copies`` adds the
    new nodes of each row's version, from the leaf's parent to its root.
    """
    names = columns or [doc_id, "source", group, "n_chars", text]
    given = [F.col(f"`{c}`") for c in names]
    lowered = [lower_ascii(c) if n == text else c for n, c in zip(names, given, strict=True)]
    changes = tampered(F.col(f"`{doc_id}`")) if changes is None else changes
    digest, other = leaf_digest(given), leaf_digest(lowered)
    entries = docs.select(
        tree_name(F.col(f"`{group}`").cast("string")).alias("tree"),
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        digest.alias("digest"),
        F.when(changes, other).alias("changed"),
    )
    root, rows = manifest(stored(entries, "manifest-entries"), copies, levels)
    found = root.first()
    top = F.lit(found.root.hex() if found else None)

    def shown(column: str) -> Column:
        return F.lower(F.hex(column))

    return rows.select(
        F.col("id").alias("doc_id"),
        shown("digest").alias("leaf"),
        shown("subroot").alias("subroot"),
        top.alias("root"),
        shown("proof").alias("proof_sha256"),
        shown("folded").alias("folded_root"),
        (shown("folded") == top).alias("verified"),
        *([F.transform("copies", lambda x: F.lower(F.hex(x))).alias("copies")] if copies else []),
    )
