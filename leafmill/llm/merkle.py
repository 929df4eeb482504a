"""Merkle manifest of a dataset: a tree for each group of rows, a tree of the groups, and a proof for each row.

Slot pivot: conditional aggregates spread the children of each parent into ``fanout`` columns; concatenating the
columns and hashing them gives the parent, and leaving a child's own column out gives its siblings.  One
aggregation makes ``levels_each`` levels at once, as the columns of a level are the parents of those below.  On
the way down a node's proof is its siblings put before the proof of the node above, so that a step costs a join
of its own size and all steps together little more than the rows.

Rows take their places in a group by a distributed sort (``common.ranked``); no group is ever in one task, and an
aggregated row has 16 nodes below it.  Steps are written once to the shared folder.

Defined results: a null value is hashed as ``-``; null ids come first; equal ids are ordered by their leaves, and
repeated rows are leaves of their own; the null group comes first and is unlike the group of the empty text; an
empty table gives an empty result; columns that are not named play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, ranked

SIBLINGS = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class ManifestParams:
    group: str = "lang"
    order: str = "doc_id"
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    fanout: int = 2
    #: Levels that one aggregation makes: it spreads fanout ** levels_each nodes into columns.
    levels_each: int = 4


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: of each value ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    texts = [c.cast("string") for c in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _lifts(nodes: DataFrame, lifts: int, params: ManifestParams, tmp: Scratch, name: str) -> list[DataFrame]:
    """Pivoted rows above ``nodes`` (tree, pos, hash, width), lowest first.

    A lift is ``levels_each`` levels: tree, pos, all nodes of these levels below one node as columns ``n<level>_<slot>``,
    its hash, and the width of its level.  A tree that is down to one node stays as it is.
    """
    out, f, k = [], params.fanout, params.levels_each
    for lift in range(lifts):
        slots = f**k
        spread = [F.max(F.when(F.col("pos") % slots == i, F.col("hash"))).alias(f"n0_{i}") for i in range(slots)]
        wide = nodes.filter("width > 1").groupBy("tree", F.floor(F.col("pos") / slots).cast("long").alias("pos")).agg(*spread, F.max("width").alias("w0"))
        for level in range(1, k + 1):
            below = lambda i, t=level - 1: [F.col(f"n{t}_{j}") for j in range(i * f, (i + 1) * f)]
            up = {f"n{level}_{i}": F.when(F.col(f"w{level - 1}") <= 1, below(i)[0]).when(below(i)[0].isNotNull(), digest(*below(i))) for i in range(f ** (k - level))}
            wide = wide.withColumns(up | {f"w{level}": F.ceil(F.col(f"w{level - 1}") / f).cast("long")})
        nodes = tmp.table(f"{name}{lift}", wide.withColumnsRenamed({f"n{k}_0": "hash", f"w{k}": "width"}))
        out.append(nodes)
    return out


def _proofs(lifts: list[DataFrame], tops: DataFrame, params: ManifestParams, tmp: Scratch, name: str) -> DataFrame:
    """(tree, pos, path) of all nodes at the bottom; ``tops`` has the path of each tree's root (tree, lifts, path)."""
    f, k = params.fanout, params.levels_each

    def child(i: int) -> Column:
        steps = []
        for level in range(k):
            own = i // f**level
            first = own - own % f
            side = lambda js, t=level: F.concat_ws("", *[F.col(f"n{t}_{j}") for j in js])
            steps.append(F.when(F.col(f"w{level}") > 1, F.struct(side(range(first, own)).alias("left"), side(range(own + 1, first + f)).alias("right"))))
        return F.struct(F.lit(i).cast("long").alias("i"), F.col(f"n0_{i}").alias("own"), F.array_compact(F.array(*steps)).cast(SIBLINGS).alias("path"))

    at = lambda n: tops.filter(F.col("lifts") == n).select("tree", F.lit(0).cast("long").alias("pos"), "path")
    paths = at(len(lifts))
    for n in range(len(lifts), 0, -1):
        wide = lifts[n - 1].select("tree", "pos", F.filter(F.array(*map(child, range(f**k))), lambda c: c["own"].isNotNull()).alias("children"))
        each = wide.join(paths, ["tree", "pos"]).select("tree", "pos", "path", F.explode("children").alias("c"))
        below = each.select("tree", (F.col("pos") * f**k + F.col("c.i")).alias("pos"), F.concat("c.path", "path").alias("path"))
        paths = tmp.table(f"{name}{n}", below.union(at(n - 1)))
    return paths


def _lifts_of(width: int, params: ManifestParams) -> int:
    """Lifts from a bottom of ``width`` nodes to one node."""
    n = 0
    while width > 1:
        width, n = -(-width // params.fanout**params.levels_each), n + 1
    return n


def _roots(nodes: DataFrame, lifts: list[DataFrame]) -> DataFrame:
    """(tree, hash) of every tree's last node."""
    out = nodes.filter("width = 1").select("tree", "hash")
    for lift in lifts:
        out = out.union(lift.filter("width = 1").select("tree", "hash"))
    return out


def fold(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_hash, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def manifest(df: DataFrame, params: ManifestParams = ManifestParams(), tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``df``: the order column, leaf, subroot, root, path (its siblings, from the bottom up),
    folded_root (from the leaf of the row as it is now) and verified.

    ``tampered`` gives fields their values now, as columns of ``df``; without it the rows are as they were.
    """
    tmp = Scratch(df.sparkSession)
    now = leaf([(tampered or {}).get(c, df[c]) for c in params.fields])
    tree = F.coalesce(F.concat(F.lit("="), df[params.group].cast("string")), F.lit(""))
    leaves = df.select(df[params.order].alias("id"), tree.alias("tree"), leaf([df[c] for c in params.fields]).alias("hash"), now.alias("now"))
    leaves = ranked(leaves, ["tree"], ["id", "hash"], tmp, "leaves").withColumnsRenamed({"_rank": "pos", "_total": "width"})
    most = leaves.agg(F.max("width").alias("rows"), F.countDistinct("tree").alias("trees")).first()
    high, upper = _lifts_of(most["rows"] or 0, params), _lifts_of(most["trees"], params)
    nodes = leaves.select("tree", "pos", "hash", "width")
    lifts = _lifts(nodes, high, params, tmp, "up")
    # The tree of the groups: one tree over the subroots.
    placed = ranked(_roots(nodes, lifts), [], ["tree"], tmp, "subroots").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("_rank").alias("pos"), "hash", F.col("_total").alias("width"))
    groups = placed.select("tree", "pos", "hash", "width")
    top = _lifts(groups, upper, params, tmp, "top")
    root = _roots(groups, top).select("tree", F.col("hash").alias("root"))
    start = root.select("tree", F.lit(upper).alias("lifts"), F.array().cast(SIBLINGS).alias("path"))
    tops = _proofs(top, start, params, tmp, "topdown").join(placed.select("pos", "of", F.col("hash").alias("subroot")), "pos").join(root, "tree")
    slots = params.fanout**params.levels_each
    own = sum((F.when(F.col("width") > slots**n, 1).otherwise(0) for n in range(high)), F.lit(0))
    heights = leaves.filter("pos = 0").select(F.col("tree").alias("of"), own.alias("lifts"))
    tops = tmp.table("tops", tops.join(heights, "of").select(F.col("of").alias("tree"), "lifts", "path", "subroot", "root"))
    paths = _proofs(lifts, tops.select("tree", "lifts", "path"), params, tmp, "down")
    found = leaves.join(paths, ["tree", "pos"]).join(tops.select("tree", "subroot", "root"), "tree")
    found = found.withColumn("folded_root", fold(F.col("now"), F.col("path")))
    done = found.select(F.col("id").alias(params.order), F.col("hash").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    out = tmp.table("manifest", done)
    tmp.keep("manifest")
    return out


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, from the bottom up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
