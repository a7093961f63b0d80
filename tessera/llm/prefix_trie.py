"""Conversation prefix trie by prefix-doubling names.

A node of the trie is a sequence of turns that conversations begin with.  Turns get dense numbers by their contents; blocks of
two, four, eight turns, at places that are multiples of their length, get dense numbers by the pair of their halves, so a
conversation of n turns has fewer than 2 n blocks and takes log2 n rounds.  A prefix of d turns is the prefix without the
lowest binary digit of d followed by one block: prefixes are named from the longest digit down, each once, by the pair of
both names.  Equal names mean equal prefixes; a node is a name.

Dense numbers come from a sort over ranges (see ranks), not from a group per name, so a first turn that a third of all
conversations share, or a conversation with a third of all turns, is spread over tasks.  All other joins are on a
conversation's place, which is unique.

Sums over a subtree are sums over the members of its top: a member adds the turns from its place on, less those of nodes that
it is the smallest member of, as those are one (n - 1) short.  A childless node is counted by its smallest member.  So no
step walks the trie.

The ids of the conversations that end at a node are joined to texts of ``CHUNK`` ids, sorted; a digest reads them chunk by chunk
and holds one at a time.

Defined results: turns are ordered by turn (null first), then role and text; null roles and texts are empty; repeated rows are
turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table has no conversation
and gives no node, not even the root; other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import core
from tessera.llm.ranks import ranked

#: Ids that are joined to one text.
CHUNK = 4096


def turn_key(role: Column, text: Column) -> Column:
    """What a turn is known by: the SHA-256 of its role and text, with the role's length before them."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def placed_turns(turns: DataFrame) -> tuple[DataFrame, str]:
    """(conv, pos, key, len) of every turn of ``turns`` (conv_id, turn, role, text), and the table's path."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    placed, _, path = ranked(rows, ["conv"], ["turn", "role", "text"], "trie-turns")
    return placed.select("conv", F.col("_at").alias("pos"), turn_key(F.col("role"), F.col("text")).alias("key"), F.char_length("text").cast("long").alias("len")), path


def rebuilt(own: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation of ``own`` (conv, pos, key, len) as the first ``head`` turns of conversation ``base`` (all if it has
    fewer, none if there is none), then its own turns after its first ``head``.  Both are columns over conv; ``head`` must be
    bounded.  (conv, pos, key, len, n): n is the number of turns; a conversation without turns has one row with null pos."""
    convs = own.groupBy("conv").agg(F.count("*").alias("own")).select("conv", "own", base.alias("base"), head.cast("long").alias("h"))
    shared = own.select(F.col("conv").alias("base"), F.struct("pos", "key", "len").alias("t")).join(convs.select("base", F.col("h").alias("most")).groupBy("base").agg(F.max("most").alias("most")), "base").where("t.pos < most")
    # A base gives as many turns as the largest head, so what is gathered of it is small.
    heads = shared.groupBy("base").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    known = convs.join(heads, "base", "left").withColumn("first", F.slice(F.coalesce("turns", F.array().cast("array<struct<pos:bigint,key:binary,len:bigint>>")), 1, F.col("h").cast("int")))
    known, at = core.stored(known.select("conv", "h", "first", (F.size("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    before = known.select("conv", "n", F.explode_outer("first").alias("t")).where("t IS NOT NULL OR n = 0").select("conv", "t.pos", "t.key", "t.len", "n")
    after = own.join(known.select("conv", "h", "n", F.size("first").alias("skip")), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("skip")).alias("pos"), "key", "len", "n")
    return before.unionByName(after)


def _named(rows: DataFrame, by: list[str], first: int, name: str) -> tuple[DataFrame, int, str]:
    """``rows`` with ``node``, a dense number of ``by`` from ``first`` on; the next free number; the table's path."""
    out, total, path = ranked(rows, by, ["conv", "at"], name)
    return out.withColumn("node", F.col("_group") + first).drop("_group", "_at"), first + total, path


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, total, last, n) of every prefix of ``turns`` (conv, pos, key, len, n), the empty one included: node is
    its name, total the code points of its turns, last those of its last turn."""
    spark = turns.sparkSession
    kept, kept_at = core.stored(turns, "trie-rebuilt")
    longest = kept.agg(F.max("n")).first()[0] or 0
    single = kept.where("pos IS NOT NULL").select("conv", F.col("pos").alias("at"), "key", F.col("len").alias("total"), F.col("len").alias("last"), "n")
    level, free, path = _named(single, ["key"], 1, "trie-names")
    levels, paths = [level.drop("key")], [kept_at, path]
    while (2 << (len(levels) - 1)) <= longest:  # at: the place of a block among those of its length
        odd = F.col("at") % 2 == 1
        part = lambda c, side: F.max(F.when(side, F.col(c)))
        pairs = levels[-1].groupBy("conv", F.expr("at DIV 2").alias("at")).agg(part("node", ~odd).alias("a"), part("node", odd).alias("b"), F.sum("total").alias("total"), part("last", odd).alias("last"), F.first("n").alias("n")).where("a IS NOT NULL AND b IS NOT NULL")
        level, free, path = _named(pairs, ["a", "b"], free, "trie-names")
        levels.append(level.drop("a", "b"))
        paths.append(path)
    root = kept.where("pos IS NULL OR pos = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"), "n")
    root, _ = core.stored(root, "trie-roots")
    done = [root]
    for k in reversed(range(len(levels))):
        # Prefixes whose lowest digit is 2 ** k: one that ends at a multiple of 2 ** (k + 1), and the block after it.
        step = 1 << k
        block = levels[k].where("at % 2 = 0").select("conv", (F.col("at") * step).alias("depth"), F.col("node").alias("b"), F.col("total").alias("more"), F.col("last").alias("end"))
        upto = reduce(DataFrame.unionByName, done).where(F.col("depth") % (2 * step) == 0)
        pairs = upto.join(block, ["conv", "depth"]).select("conv", (F.col("depth") + step).alias("at"), F.col("node").alias("a"), "b", (F.col("total") + F.col("more")).alias("total"), F.col("end").alias("last"), "n")
        level, free, _ = _named(pairs, ["a", "b"], free, "trie-prefixes")
        done.append(level.select("conv", F.col("at").alias("depth"), "node", "total", "last", "n"))
    for path in paths:
        core.drop(spark, path)
    return reduce(DataFrame.unionByName, done)


def _digest(batches):
    """Rows (node, ids) sorted by node and place: the SHA-256 of each node's ids, chunks joined by commas."""
    node, state = None, None
    for batch in batches:
        nodes, out = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    nodes.append(node)
                    out.append(state.hexdigest())
                node, state = key, hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())], ["node", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends"])


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, ends): the SHA-256 of the ascending decimal conv ids of ``ends`` (node, conv), comma-joined."""
    spark = ends.sparkSession
    placed, _, _ = ranked(ends, ["node"], ["conv"], "trie-ends")
    joined = placed.groupBy("node", F.expr(f"_at DIV {chunk}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return joined.repartition(core.tasks(spark), "node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_digest, "node long, ends string")


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie over
    ``turns`` (conv, pos, key, len, n)."""
    rows, _ = core.stored(prefixes(turns), "trie-rows")
    first = F.min(F.struct("conv", (F.col("total") - F.col("last")).alias("before")))
    found = rows.groupBy("node").agg(first.alias("owner"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.max("n").alias("deepest"))
    nodes, _ = core.stored(found.select("node", F.col("owner.conv").alias("conv_id"), F.col("owner.before").alias("before"), "n_convs", "depth", "deepest"), "trie-nodes")
    # A conversation is the smallest member of its nodes from some depth on.
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min(F.struct("depth", "before")).alias("top"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    ends = rows.where("depth = n").select("conv", F.col("node").alias("end"), F.col("total").alias("whole"))
    about = ends.join(owned, "conv", "left").select("conv", F.coalesce("top.depth", F.lit((1 << 62))).alias("from"), F.coalesce("top.before", "whole").alias("upto"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    saved = F.when(F.col("depth") < F.col("from"), F.col("upto") - (F.col("total") - F.col("last"))).otherwise(0)
    sums = rows.join(about, "conv").groupBy("node").agg(F.sum(saved).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    # The parent of a node is the prefix of its smallest member that is one turn shorter.
    up = rows.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    named, _ = core.stored(nodes.select("node", "conv_id", "depth", "n_convs").join(up, ["conv_id", "depth"], "left"), "trie-parents")
    children = named.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    digests = end_digests(ends.select(F.col("end").alias("node"), "conv"))
    about_node = sums.join(children, "node", "left").join(digests, "node", "left")
    # The numbers are gathered first, as a node with very many children makes its parent's name a frequent key.
    out = named.join(parents, "parent", "left").join(about_node, "node")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
