"""The prefix trie of conversations: double-array tries per prefix shard, their shared upper nodes merged globally.

Rebuilt conversations are rows (conv_id, depth, turn).  A node, a distinct prefix of turns, has a 128-bit key: the XOR of
hashes of (depth, SHA-256 of role and text) along the prefix, so keys come from running XORs and a long
conversation is cut into segments of ``SEGMENT`` turns for them.  Of equal conversations one, the smallest, goes on
with their number.

A node with more than ``UNIT_ROWS`` rows of distinct conversations below it is an upper node; the subtrees
hanging under upper nodes are units, and a hash of their root's key deals units to shards of about
``SHARD_ROWS`` rows.  A shard's task numbers its turns densely, packs BASE and CHECK arrays, traverses them with all its
conversations and sums its nodes bottom-up along CHECK.  Upper nodes are merged across shards: their own
members by one map-side combined aggregation, and what hangs below them by running sums along one
path per node and a sum per node.  So a first turn that all conversations share is an upper node like any other, in no
task's memory.

Defined results: rows without a conv_id belong to no conversation; turns of one number are ordered by role
and text, repeated rows are turns each; a null role or text is empty; a conversation rebuilt without turns is a
member of the root alone; an empty table has no nodes; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .double_array import DoubleArrayTrie

GROUP = 20
HEADS = 4
SEGMENT = 4096
UNIT_ROWS = 1_000
SHARD_ROWS = 4_000
END_BLOCK = 65_536
KEY = ["k1", "k2"]
NODE_SCHEMA = (
    "k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def running(df: DataFrame, by: str, at: str, values: dict[str, str], total, plus, last_first: bool = False) -> DataFrame:
    """``df`` with the running ``total`` of each value (new name -> column) over ``at`` within ``by``, this row included.

    Rows are worked through in segments of ``SEGMENT`` positions, and the segments' totals carry on from each to the next, so that
    one key's rows need not be in one task.
    """
    way = F.desc if last_first else F.asc
    cutup = df.withColumn("segment", F.floor(F.col(at) / SEGMENT))
    inside = Window.partitionBy(by, "segment").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy(way("segment")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cutup.groupBy(by, "segment").agg(*[total(F.col(c)).alias(f"{new}_sum") for new, c in values.items()])
    carried = sums.select(by, "segment", *[F.coalesce(total(F.col(f"{new}_sum")).over(before), F.lit(0)).alias(f"{new}_carried") for new in values])
    here = cutup.withColumns({new: total(F.col(c)).over(inside) for new, c in values.items()})
    joined = here.join(carried, [by, "segment"])
    return joined.withColumns({new: plus(F.col(new), F.col(f"{new}_carried")) for new in values}).drop("segment", *[f"{new}_carried" for new in values])


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def add(a: Column, b: Column) -> Column:
    return a + b


def numbered_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, words): the turns of every conversation, counted from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.select(
        "*",
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).alias("part"),
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    found = rows.withColumn("place", F.row_number().over(inside)).join(parts, ["conv_id", "part"])
    return cut(spark, found.select("conv_id", (F.col("first") + F.col("place") - 1).alias("i"), "digest", "words"), "turns")


def rebuilt_paths(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, convs): the turns of the rebuilt conversations with the keys of their nodes and parents, and (conv_id, length) of all."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    head = F.least("h", F.coalesce("base_own", F.lit(0)))
    length = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = convs.join(bases, "base", "left").withColumn("head", head).withColumn("length", length)
    convs = cut(spark, convs.select("conv_id", "base", "h", "head", "length"), "convs")
    tails = turns.join(convs.where("length > head"), "conv_id").where(F.col("i") >= F.col("h"))
    tails = tails.select("conv_id", (F.col("head") + F.col("i") - F.col("h") + 1).alias("depth"), "digest", "words", "length")
    firsts = turns.where(F.col("i") < HEADS - 1).withColumnRenamed("conv_id", "base")
    heads = firsts.join(convs.where("head > 0"), "base").where(F.col("i") < F.col("head"))
    heads = heads.select("conv_id", (F.col("i") + 1).alias("depth"), "digest", "words", "length")
    rows = tails.union(heads).withColumns({"t1": F.xxhash64("depth", "digest"), "t2": F.xxhash64("digest", F.lit("t"), "depth")})
    keyed = running(rows, "conv_id", "depth", {"k1": "t1", "k2": "t2"}, F.bit_xor, xor)
    keyed = keyed.select("conv_id", "depth", "digest", "words", "length", *KEY, xor(F.col("k1"), F.col("t1")).alias("p1"), xor(F.col("k2"), F.col("t2")).alias("p2"))
    return cut(spark, keyed, "paths"), convs.select("conv_id", "length")


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per node of its blocks' ids, which come in order; only the running hash is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"]):
            if (k1, k2) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["k1", "k2", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations (k1, k2, conv_id) that end at a node, ids in order and joined by commas."""
    blocks = ends.groupBy(*KEY, F.floor(F.col("conv_id") / END_BLOCK).alias("block"))
    blocks = blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return ordered.mapInPandas(_stream_digests, "k1 long, k2 long, ends_sha256 string")


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard's units, by a double-array trie; parent_conv_id is null at a unit's root.

    ``rows``: (conv_id, at, digest, words, n, depth, k1, k2, p1, p2), ``at`` the turn's place below the upper nodes, from 0.
    """
    rows = rows.sort_values(["conv_id", "at"], ignore_index=True)
    # a unit's root stands by its key: the same turn may begin units under different upper nodes
    labels = [d if a else b"%d,%d" % (k1, k2) for d, a, k1, k2 in zip(rows["digest"], rows["at"], rows["k1"], rows["k2"])]
    symbol = pd.factorize(np.array([bytes(x) for x in labels], dtype=object))[0]
    starts = np.flatnonzero(rows["at"].to_numpy() == 0)
    ends = np.append(starts[1:], len(rows))
    order = sorted(range(len(starts)), key=lambda s: symbol[starts[s] : ends[s]].tolist())
    starts, ends = starts[order], ends[order]
    levels, depth = [], 0
    while len(live := np.flatnonzero(ends - starts > depth)):
        levels.append(np.stack([symbol[starts[live] + depth], live]))
        depth += 1
    trie = DoubleArrayTrie(levels)
    size = len(trie.check)
    state = np.zeros(len(starts), dtype=np.int64)
    n, words = rows["n"].to_numpy(), rows["words"].to_numpy()
    n_convs, children, leaves, saved, one = (np.zeros(size, dtype=np.int64) for _ in range(5))
    least = np.full(size, np.iinfo(np.int64).max)
    conv = rows["conv_id"].to_numpy()
    visited = []
    for d, (symbols, live) in enumerate(levels):
        state[live] = at = trie.step(state[live], symbols)
        row = starts[live] + d
        np.add.at(n_convs, at, n[row])
        np.minimum.at(least, at, conv[row])
        one[at] = row
        visited.append(np.unique(at))
    for nodes in reversed(visited):
        leaves[nodes] += children[nodes] == 0
        saved[nodes] += (n_convs[nodes] - 1) * words[one[nodes]]
        if nodes is not visited[0]:
            parents = trie.check[nodes]
            for total, part in ((children, np.ones(len(nodes), dtype=np.int64)), (leaves, leaves[nodes]), (saved, saved[nodes])):
                np.add.at(total, parents, part)
    nodes = np.concatenate(visited)
    parent = pd.array(least[trie.check[nodes]], dtype="Int64")
    parent[: len(visited[0])] = pd.NA
    out = rows.loc[one[nodes], ["k1", "k2", "p1", "p2", "depth"]].reset_index(drop=True)
    return out.assign(
        conv_id=least[nodes], parent_conv_id=parent, n_convs=n_convs[nodes], n_children=children[nodes], n_leaves=leaves[nodes], saved_tokens=saved[nodes]
    )


def trie_nodes(spark: SparkSession, conversations: DataFrame, unit_rows: int = UNIT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every node of the trie, with its key, parent's key and ``ends_sha256``."""
    paths, convs = rebuilt_paths(spark, numbered_turns(spark, conversations))
    none = convs.where("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    ends = paths.where("depth = length").select(*KEY, "conv_id").union(none)
    ends = cut(spark, ends, "ends")
    sequences = ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    chosen = cut(spark, paths.join(sequences.select("conv_id", "n"), "conv_id"), "chosen")

    below = chosen.groupBy(*KEY).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
    upper = below.where(F.col("below") > unit_rows).select(*KEY)
    upper_rows = cut(spark, chosen.join(upper, KEY, "left_semi"), "upper")
    tops = upper_rows.groupBy("conv_id").agg(F.max("depth").alias("top"))
    lower = chosen.join(tops, "conv_id", "left").withColumn("at", F.col("depth") - F.coalesce("top", F.lit(0)) - 1).where("at >= 0").drop("top")
    shards = chosen.count() // shard_rows + 1
    homes = lower.where("at = 0").select("conv_id", F.pmod(F.xxhash64(*KEY), F.lit(shards)).alias("shard"))
    dealt = lower.join(homes, "conv_id").select("shard", "conv_id", "at", "digest", "words", "n", "depth", "k1", "k2", "p1", "p2")
    low = cut(spark, dealt.groupBy("shard").applyInPandas(lambda rows: shard_nodes(rows), NODE_SCHEMA), "nodes")

    # upper nodes: members, then children, then what is below
    roots = low.where("parent_conv_id is null")
    high = upper_rows.groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("n").alias("n_convs")
    )
    zero = F.lit(0).cast("long")
    root = sequences.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")).where("conv_id is not null")
    nothing = F.lit(None).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), nothing.alias("p1"), nothing.alias("p2"), "conv_id", zero.alias("depth"), zero.alias("words"), "n_convs")
    high = cut(spark, high.unionByName(root), "high")
    kin = roots.select("p1", "p2", "n_leaves", "saved_tokens").union(high.where("depth > 0").select("p1", "p2", zero, zero))
    kin = kin.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kin = kin.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    high = high.join(kin, KEY, "left").na.fill(0, ["n_children", "n_leaves", "saved_tokens"])
    high = high.withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        }
    ).drop("words")
    high = cut(spark, high, "high")
    # each upper node's own part stands once, on the path of its smallest conversation; a node's total is that of all paths through it
    parts = high.select("conv_id", "depth", "n_leaves", "saved_tokens")
    along = upper_rows.select("conv_id", "depth", *KEY).join(parts, ["conv_id", "depth"], "left").na.fill(0, ["n_leaves", "saved_tokens"])
    along = running(along, "conv_id", "depth", {"all_leaves": "n_leaves", "all_saved": "saved_tokens"}, F.sum, add, last_first=True)
    totals = along.groupBy(*KEY).agg(F.sum("all_leaves").alias("n_leaves"), F.sum("all_saved").alias("saved_tokens"))
    whole = high.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    totals = totals.union(whole.where("n_leaves is not null").select(zero, zero, "n_leaves", "saved_tokens"))
    high = high.drop("n_leaves", "saved_tokens").join(totals, KEY)

    names = high.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    tied = roots.drop("parent_conv_id").unionByName(high).join(names, ["p1", "p2"], "left").withColumnRenamed("parent", "parent_conv_id")
    nodes = low.where("parent_conv_id is not null").unionByName(tied)
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends_digests(ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))


def trie_report(spark: SparkSession, conversations: DataFrame, unit_rows: int = UNIT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: its smallest member, depth, parent, members, children, leaves, saved tokens and the digest of those that end there."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return trie_nodes(spark, conversations, unit_rows, shard_rows).select(*columns)


REPORT_SQL = r"""
with own as (
    select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                              order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
    from conversations where conv_id is not null group by conv_id),
h as (
    select c, own, c - c % 20 as base,
           xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda ch: ascii(ch)::bigint)),
                           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                                                    lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))),
               4294967295::bigint) % 4 as h
    from own),
s as (select h.c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) as s from h left join own b on b.c = h.base),
path as (
    select c, d, md5(cast(to_json(s[1:d]) as varchar)) as key, case when d > 0 then md5(cast(to_json(s[1:d - 1]) as varchar)) end as parent,
           case when d > 0 then len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) else 0 end as words, d = len(s) as last
    from (select c, s, unnest(range(0, len(s) + 1)) as d from s)),
node as (
    select key, d, min(parent) as parent, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * min(words) as saved,
           sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last), '')) as ends
    from path group by key, d),
child as (select parent as key, count(*) as n from node where parent is not null group by parent),
under as (select distinct a.key, b.key as low from path a join path b on a.c = b.c and a.d <= b.d),
total as (
    select under.key, sum(case when child.n is null then 1 else 0 end) as leaves, sum(saved) as saved
    from under join node on node.key = low left join child on child.key = low group by under.key)
select node.conv_id, cast(node.d as bigint) as depth, up.conv_id as parent_conv_id, node.n_convs, cast(coalesce(child.n, 0) as bigint) as n_children,
       cast(total.leaves as bigint) as n_leaves, cast(total.saved as bigint) as saved_tokens, node.ends as ends_sha256
from node left join node up on up.key = node.parent left join child on child.key = node.key join total on total.key = node.key
"""
