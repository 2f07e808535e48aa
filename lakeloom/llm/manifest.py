"""Merkle manifest of a data set by checkpoint and recompute.

Rows are the leaves of one tree per source, in order of doc_id; `fan` consecutive nodes become their
parent, and the trees' roots, in order of source, are the leaves of the tree above them. Only every
`step`-th level is written (`Manifest.levels`), a node of it for an aligned subtree of fan**step
nodes below. A proof needs the levels between as well: each subtree's are computed again from its
stored nodes, the siblings are emitted, and the rest is dropped. So a proof's levels come from one
pass over each written level, from the root down, and no task holds more than fan**step nodes of
one tree. Digests and siblings are JVM expressions; a source of a third of all rows spreads over
tasks like any other.

A digest is the lowercase hex sha256 of its inputs one after the other. A leaf's inputs are its
columns, each `-` if null, else its length in UTF-8 bytes, a colon and the value, so that no two
rows have the same input. Null sources come first, as do null doc_ids; rows of one doc_id follow
each other by their leaf, and rows that repeat are leaves of their own. Empty texts and long ones
are leaves like any other. Other columns are not read. An empty table has no root, and an empty
manifest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from ..operators.ranks import ranked

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run, and levels from one written level to the next.
FAN, STEP = 3, 4
HALF = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Manifest:
    """Leaves (tree, idx, n, digest and what the rows carry), written levels above them, and the root's digest."""

    leaves: DataFrame
    levels: list[DataFrame]
    fan: int
    step: int

    @property
    def top(self) -> DataFrame:
        """tree, digest: a tree's root."""
        return self.levels[-1].select("tree", "digest")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in front, `-` for null; no two lists of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*(field(c) for c in columns.values()))


def _nodes(n: Column, level: int, fan: int) -> Column:
    """Nodes on a level of a tree with `n` leaves."""
    return F.ceil(n / F.lit(fan**level).cast("decimal(38,0)")) if level else n


def _parents(nodes: Column, fan: int) -> Column:
    """The parents of the consecutive nodes of a subtree."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fan + 1, fan), ""), 256))


def _inner(df: DataFrame, base: int, fan: int, step: int) -> DataFrame:
    """Columns l0..l<step>: the levels of a subtree from its stored nodes `l0`; a tree ends at one node."""
    for k in range(step):
        more = _nodes(F.col("n"), base + k, fan) > 1
        df = df.withColumn(f"l{k + 1}", F.when(more, _parents(F.col(f"l{k}"), fan)).otherwise(F.col(f"l{k}")))
    return df


def _subtrees(nodes: DataFrame, fan: int, step: int) -> DataFrame:
    """The nodes of a written level by subtree: tree, n, block, l0 and `rows`, in order. fan**step of them at most."""
    block = F.floor(F.col("idx") / fan**step)
    rest = [c for c in nodes.columns if c not in ("tree", "n", "idx")]
    return (
        nodes.groupBy("tree", "n", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("rows"))
        .withColumn("l0", F.col("rows.digest"))
    )


def build(leaves: DataFrame, label: str, fan: int = FAN, step: int = STEP) -> Manifest:
    """From (tree, idx, n, digest, ...), `idx` without gaps, the written levels of every tree."""
    leaves = settle(leaves, f"{label}-leaves")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, below, base = [], leaves.select("tree", "n", "idx", "digest"), 0
    while True:
        up = _inner(_subtrees(below, fan, step), base, fan, step)
        below = settle(up.select("tree", "n", F.col("block").alias("idx"), F.col(f"l{step}")[0].alias("digest")), f"{label}-level")
        levels.append(below)
        base += step
        if fan**base >= most:
            return Manifest(leaves, levels, fan, step)


def _siblings(k: int, fan: int) -> Callable[[Column], Column]:
    """Of the node at place `i` of a subtree, the siblings on level `k` of the subtree."""

    def halves(i: Column) -> Column:
        at = F.floor(i / fan**k).cast("int")
        first = F.floor(at / fan).cast("int") * fan
        nodes = F.col(f"l{k}")
        left = F.array_join(F.slice(nodes, first + 1, at - first), "")
        right = F.array_join(F.slice(nodes, at + 2, first + fan - 1 - at), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return halves


def with_proofs(tree: Manifest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with `proof`: the siblings left and right of their way, level by level up to the tree's root.

    `above` (tree, path) continues a tree's proofs over its root.
    """
    fan, step = tree.fan, tree.step
    path = tree.levels[-1].select("tree", "idx")
    if above is None:
        path = path.withColumn("path", F.array().cast(HALF))
    else:
        path = path.join(above, "tree")
    for depth in reversed(range(len(tree.levels))):
        nodes = tree.levels[depth - 1] if depth else tree.leaves
        inner = _inner(_subtrees(nodes, fan, step), depth * step, fan, step)
        met = inner.join(path.withColumnRenamed("idx", "block"), ["tree", "block"])
        each = F.transform("rows", lambda r, i: F.struct(r.alias("row"), i.alias("at")))
        here = F.filter(
            F.array(
                *(
                    F.when(_nodes(F.col("n"), depth * step + k, fan) > 1, _siblings(k, fan)(F.col("e.at")))
                    for k in range(step)
                )
            ),
            lambda s: s.isNotNull(),
        )
        out = met.withColumn("e", F.explode(each)).select("tree", "n", "e.row.*", F.concat(here, "path").alias("path"))
        if depth:
            path = settle(out.select("tree", "idx", "path"), "merkle-paths")
    return out.withColumnRenamed("path", "proof")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    group: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
    fan: int = FAN,
    step: int = STEP,
) -> tuple[Manifest, Manifest]:
    """The trees of the sources, and the tree of their roots.

    A source's tree is named by its place in the order of sources. Leaves have `source`, `doc_id` and
    what `carry` makes of the row, but not its text.
    """
    more = carry or {}
    base = docs.select(
        F.col(group).alias("source"),
        F.col(order).alias("doc_id"),
        leaf({c: F.col(c) for c in columns}).alias("digest"),
        *(c.alias(name) for name, c in more.items()),
    )
    by = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    leaves = settle(ranked(base, ["source"], by, "merkle-order"), "merkle-leaves")
    # A row for each source; its place is the name of its tree.
    names = ranked(leaves.filter("idx = 0").select("source"), [], [F.col("source").asc_nulls_first()], "merkle-sources")
    names = settle(names.select(F.col("source").alias("_source"), F.col("idx").alias("tree"), F.col("n").alias("_trees")), "merkle-sources")
    named = leaves.join(names.drop("_trees"), leaves["source"].eqNullSafe(names["_source"])).drop("_source")
    below = build(named, "merkle", fan, step)
    roots = below.top.join(names.select("tree", "_trees"), "tree")
    above = build(
        roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("_trees").alias("n"), "digest"),
        "merkle-roots",
        fan,
        step,
    )
    return below, above


def proofs(trees: tuple[Manifest, Manifest]) -> DataFrame:
    """Every leaf with subroot, root and `proof`, the siblings left and right of its way up, from below."""
    below, above = trees
    over = with_proofs(above).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), F.col("proof").alias("path"))
    over = settle(over.crossJoin(F.broadcast(above.top.select(F.col("digest").alias("root")))), "merkle-over")
    out = with_proofs(below, over.select("tree", "path"))
    return out.join(over.select("tree", "subroot", "root"), "tree")


def tampered(docs_text: Column, doc_id: Column) -> Column:
    """Text without its line ends where 2 divides the crc32 of the id in decimal digits."""
    even = F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))
    return F.when(even, F.translate(docs_text, "\n", "")).otherwise(docs_text)


def verified(docs: DataFrame, fan: int = FAN, step: int = STEP) -> DataFrame:
    """Every row's leaf, proof digest and roots, and whether the row, tampered with or not, still proves the root."""
    probe = leaf({c: tampered(F.col("text"), F.col("doc_id")) if c == "text" else F.col(c) for c in COLUMNS})
    rows = proofs(manifest(docs, carry={"probe": probe}, fan=fan, step=step))
    sides = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(sides, 256).alias("proof_sha256"),
        fold(F.col("probe"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
