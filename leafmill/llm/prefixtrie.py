"""Trie of conversations by their common first turns, built by hashing blocks of a fixed number of turns.

Conversations are grouped by the digests of successive blocks of ``block_turns`` turns.  A group whose members
all go on with the same whole block stays together: the nodes inside that block have the same members, and no
turn of it is looked at.  Only where members diverge, or end, are the turns inside the block told apart, by the
digests of the block's first turns.  A conversation that is alone in its group is a chain and takes no further
part.  So rounds go as deep as conversations agree, and cost what is still shared.

A node is named by its smallest member and its depth.  The smallest member of a node is also that of one child
at most, so each conversation owns a chain of nodes that hangs at a node of a smaller conversation.  Sums over
subtrees are sums along chains, with what hangs on them; totals are pushed up chain by chain.

Scale: turns are numbered by a distributed sort (``common.ranked``); groups are counted and never collected;
arrays hold one block; the members that end at a node are packed in runs of 4,096 ids before one task hashes
them in order, a run at a time.  Step tables lie in the shared folder and are dropped when done with.

Defined results: rows without a conversation's number belong to none and are left out; a null role or text is
empty; turns come by number (null first), equal ones by role, first 64 characters and digest of the text;
repeated rows are turns of their own; no conversation gives no node, not even a root; other columns play no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, ranked

NONE = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieParams:
    block_turns: int = 8
    #: Ids packed before hashing: 2 to this power.
    run_bits: int = 12


def turn_digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(rows: DataFrame, tmp: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, total, digest, bytes): the turns of each conversation, numbered from 0."""
    said, by = F.coalesce(rows[text], F.lit("")), F.coalesce(rows[role], F.lit(""))
    few = rows.filter(rows[conv].isNotNull()).select(rows[conv].cast("long").alias("conv"), rows[turn].alias("turn"), by.alias("role"), F.substring(said, 1, 64).alias("begin"), turn_digest(by, said).alias("digest"), F.octet_length(said).cast("long").alias("bytes"))
    return ranked(few, ["conv"], ["turn", "role", "begin", "digest"], tmp, "turns").select("conv", F.col("_rank").alias("pos"), F.col("_total").alias("total"), "digest", "bytes")


def rebased(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` turns of conversation ``base`` (columns of ``conv``), then go on
    with their own turns after so many: (conv, size) of each, and their turns (conv, pos, digest, bytes)."""
    own = turns.filter("pos = 0").select("conv", "total", base.alias("base"), head.cast("long").alias("head"))
    of_base = own.select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    convs = own.join(of_base, "base", "left").withColumn("lead", F.least("head", F.coalesce("base_total", F.lit(0))))
    heads = convs.select("conv", "base", "head").join(turns.select(F.col("conv").alias("base"), "pos", "digest", "bytes"), "base").filter("pos < head").select("conv", "pos", "digest", "bytes")
    tails = turns.join(convs.select("conv", "head", "lead"), "conv").filter("pos >= head").select("conv", (F.col("lead") + F.col("pos") - F.col("head")).alias("pos"), "digest", "bytes")
    return convs.select("conv", (F.col("lead") + F.greatest(F.col("total") - F.col("head"), F.lit(0))).alias("size")), heads.union(tails)


def _groups(convs: DataFrame, turns: DataFrame, params: TrieParams, tmp: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where chains start (conv, start, parent), nodes of two or more members (conv, depth, n), and the owner of the
    node at which a conversation ends that owns it not (conv, owner)."""
    size = params.block_turns
    blocks = turns.groupBy("conv", F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("d"))
    blocks = tmp.table("blocks", blocks.select("conv", "block", F.transform("d", lambda x: x["digest"]).alias("digests")))
    first = convs.agg(F.min("conv").alias("g"), F.count("*").alias("m")).first()
    alive = convs.select("conv", F.lit(first["g"]).cast("long").alias("g"), F.lit(first["m"]).alias("m"))
    root = convs.sparkSession.createDataFrame([(first["g"], 0, None, first["m"])] if first["m"] else [], "conv long, start long, parent long, n long")
    starts, counts, ends = [root.select("conv", "start", "parent")], [root.select("conv", F.col("start").alias("depth"), "n")], []
    depth = 0
    while not alive.isEmpty():
        name = str(depth)
        prefix = lambda k: F.sha2(F.array_join(F.slice("digests", 1, k), ""), 256)
        here = alive.join(blocks.filter(F.col("block") == depth // size).select("conv", "digests"), "conv", "left").withColumn("digests", F.coalesce("digests", F.array().cast("array<string>")))
        here = tmp.table(f"here{name}", here.withColumn("whole", F.when(F.size("digests") == size, prefix(F.lit(size)))))
        apart = here.groupBy("g").agg((~((F.count("whole") == F.max("m")) & (F.min("whole") == F.max("whole")))).alias("apart"))
        here = here.join(apart.withColumn("apart", F.coalesce("apart", F.lit(True))), "g")
        same, split = here.filter("not apart").select("conv", "g", "m"), here.filter("apart")
        counts.append(tmp.table(f"same{name}", same.filter("conv = g").select("conv", F.explode(F.sequence(F.lit(depth + 1).cast("long"), F.lit(depth + size).cast("long"))).alias("depth"), F.col("m").alias("n"))))
        steps = F.transform(F.when(F.size("digests") > 0, F.sequence(F.lit(1), F.size("digests"))), lambda k: F.struct(k.alias("k"), prefix(k).alias("prefix")))
        each = split.select("conv", "g", F.inline(steps))
        nodes = tmp.table(f"nodes{name}", each.groupBy("g", "k", "prefix").agg(F.min("conv").alias("owner"), F.count("*").alias("n")))
        counts.append(nodes.filter("n > 1").select(F.col("owner").alias("conv"), (F.col("k") + depth).cast("long").alias("depth"), "n"))
        of = each.join(nodes, ["g", "k", "prefix"]).groupBy("conv").agg(
            F.min(F.when(F.col("owner") == F.col("conv"), F.col("k"))).alias("own"),
            F.max(F.when(F.col("owner") != F.col("conv"), F.struct("k", "owner")))["owner"].alias("before"),
            F.max(F.struct("k", "owner", "n")).alias("last"),
        )
        found = tmp.table(f"found{name}", split.select("conv", "g", F.size("digests").alias("here")).join(of, "conv", "left"))
        starts.append(found.filter("conv <> g and own is not null").select("conv", (F.col("own") + depth).cast("long").alias("start"), F.coalesce("before", "g").alias("parent")))
        ends.append(found.filter(F.col("here") < size).select("conv", F.coalesce("last.owner", "g").alias("owner")).filter("conv <> owner"))
        on = found.filter((F.col("here") == size) & (F.col("last.n") > 1)).select("conv", F.col("last.owner").alias("g"), F.col("last.n").alias("m"))
        alive = tmp.table(f"alive{name}", on.union(same))
        depth += size
    union = lambda parts, empty: tmp.table(empty, _union(parts)) if parts else None
    starts, counts = union(starts, "starts"), union(counts, "counts")
    ends = union(ends, "ends") if ends else starts.select("conv", F.col("conv").alias("owner")).limit(0)
    return starts, counts, ends


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _push_up(chains: DataFrame, tmp: Scratch) -> DataFrame:
    """(conv, depth, leaves, saved): what hangs on the nodes of each chain (conv, parent, at, leaves, saved), with all below it."""
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    above = chains.select("conv", F.col("parent").alias("above"), F.col("at").alias("above_at"))
    pending, parts = chains.filter("parent is not null").groupBy("parent", "at").agg(*sums), []
    while True:
        hung = tmp.table(f"hung{len(parts)}", pending)
        parts.append(hung.select(F.col("parent").alias("conv"), F.col("at").alias("depth"), "leaves", "saved"))
        if hung.isEmpty():
            return _union(parts)
        up = hung.groupBy(F.col("parent").alias("conv")).agg(*sums).join(above.filter("above is not null"), "conv")
        pending = up.groupBy(F.col("above").alias("parent"), F.col("above_at").alias("at")).agg(*sums)


def _end_digests(at: DataFrame, params: TrieParams) -> DataFrame:
    """(owner, depth, ends): digest of the comma-joined, ascending numbers ``conv`` of each (owner, depth)."""

    def hashed(batches):
        now, state = None, None
        for b in batches:
            out = []
            for owner, depth, ids in zip(b["owner"].tolist(), b["depth"].tolist(), b["ids"].tolist()):
                if (owner, depth) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["owner", "depth", "ends"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["owner", "depth", "ends"])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    runs = at.groupBy("owner", "depth", F.shiftright("conv", params.run_bits).alias("run")).agg(ids.alias("ids"))
    return runs.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "run").mapInPandas(hashed, "owner long, depth long, ends string")


def prefix_trie(convs: DataFrame, turns: DataFrame, params: TrieParams = TrieParams(), tmp: Scratch | None = None) -> DataFrame:
    """One row for each node of the trie of ``convs`` (conv, size) with ``turns`` (conv, pos, digest, bytes).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens (bytes
    of turns that members share, over the subtree) and ends_sha256 (digest of the members that end there).
    """
    tmp = tmp or Scratch(convs.sparkSession)
    convs, turns = tmp.table("convs", convs), tmp.table("rebuilt", turns)
    starts, counts, ends = _groups(convs, turns, params, tmp)
    owners = convs.join(starts, "conv").select("conv", "size", "start", "parent", (F.col("start") - 1).alias("at"))
    weights = counts.join(turns.select("conv", (F.col("pos") + 1).alias("depth"), "bytes"), ["conv", "depth"]).select("conv", "depth", ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    weights = tmp.table("weights", weights)
    hung_at = owners.filter("parent is not null").groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(F.count("*").alias("kids"))
    tips = owners.select("conv", F.col("size").alias("depth"), "start", "parent", "at").join(hung_at, ["conv", "depth"], "left").withColumn("leaves", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long"))
    totals = weights.groupBy("conv").agg(F.sum("saved").alias("saved"))
    chains = tmp.table("chains", tips.select("conv", "parent", "at", "depth", "leaves").join(totals, "conv", "left").withColumn("saved", F.coalesce("saved", F.lit(0)).cast("long")))
    hung = _push_up(chains.select("conv", "parent", "at", "leaves", "saved"), tmp)
    ended = convs.join(ends, "conv", "left").select(F.coalesce("owner", "conv").alias("owner"), F.col("size").alias("depth"), "conv")
    facts = {"n": "long", "kids": "long", "leaves": "long", "saved": "long", "ends": "string"}
    parts = [counts, hung_at, hung, weights, chains.select("conv", "depth", "leaves"), _end_digests(ended, params).withColumnRenamed("owner", "conv")]
    parts = [p.select("conv", "depth", *[(F.col(f) if f in p.columns else F.lit(None)).cast(t).alias(f) for f, t in facts.items()], F.lit(None).cast("long").alias("above"), F.lit(0).cast("long").alias("goes_on")) for p in parts]
    up = F.when(F.col("depth") > F.col("start"), F.col("conv")).otherwise(F.col("parent"))
    nodes = owners.select("conv", "size", "start", "parent", F.explode(F.sequence("start", "size")).alias("depth"))
    nodes = nodes.select("conv", "depth", *[F.lit(None).cast(t).alias(f) for f, t in facts.items()], up.alias("above"), (F.col("depth") < F.col("size")).cast("long").alias("goes_on"))
    one = _union([nodes, *parts]).groupBy("conv", "depth").agg(*[(F.sum if f in ("leaves", "saved", "kids") else F.max)(f).alias(f) for f in facts], F.max("above").alias("above"), F.max("goes_on").alias("goes_on"))
    below = Window.partitionBy("conv").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = one.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("above").alias("parent_conv_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_convs"),
        (F.col("goes_on") + zero(F.col("kids"))).alias("n_children"),
        zero(F.sum("leaves").over(below)).alias("n_leaves"),
        zero(F.sum("saved").over(below)).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
    )
    out = tmp.table("trie", out)
    tmp.keep("trie")
    return out
