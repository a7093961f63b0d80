"""Merkle manifest of a dataset: a hash tree of fan-out three over the rows of each source, and one over the sources.

A row's leaf is the SHA-256 of its fields, each with its length before it.  Leaves get their places by a sort over ranges
(see ranks), so a source with a third of all rows is no single task, and no text moves: only ids and digests do.

Trees are built in rounds.  A round gathers the nodes of a source in blocks of ``BLOCK`` = 3 ** ``LEVELS`` consecutive ones,
an array each, and collapses ``LEVELS`` levels of a block by array functions; the roots of the blocks are the nodes of the
next round.  A block that is all its source has stops at one node.  Ten thousand million rows take five rounds.

Proofs come back down the same way: a block's path to the root is joined once to the block, and each of its nodes adds its
own siblings inside the block.  A path is a list of what stands left and right of the node in its run, level by level.

Defined results: null fields are marked as such, so a null and an empty text differ; rows without an id come first; rows that
share an id are ordered by their leaves, and repeated rows are leaves of their own; a null source is a source; an empty table
gives an empty result; other columns of the table play no part, but for clashing names none is lost: only those in ``FIELDS``
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import core
from tessera.llm.ranks import ranked

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEVELS = 5
BLOCK = 3**LEVELS


def encode(value: Column) -> Column:
    """A field as its length in bytes, a colon and its text; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encode, values)), 256)


#: All levels of a block from its ``nodes`` up; ``lone``: it is all its tree has, so it stops at one node.
LEVELS_SQL = f"""aggregate(sequence(1, {LEVELS}), array(nodes), (acc, l) ->
  CASE WHEN lone AND size(element_at(acc, -1)) = 1 THEN acc
  ELSE concat(acc, array(transform(sequence(0, CAST((size(element_at(acc, -1)) - 1) DIV 3 AS INT)),
    i -> sha2(array_join(slice(element_at(acc, -1), 3 * i + 1, 3), ''), 256)))) END)"""

#: What stands before and after node ``i`` of a block in its run, for each level of the block.
OWN_SQL = f"""transform(slice(sequence(0, {LEVELS - 1}), 1, size(levels) - 1), l -> named_struct(
  'before', array_join(slice(levels[l], CAST(i DIV {{step}} - i DIV {{step}} % 3 + 1 AS INT), CAST(i DIV {{step}} % 3 AS INT)), ''),
  'after', array_join(slice(levels[l], CAST(i DIV {{step}} + 2 AS INT), CAST(2 - i DIV {{step}} % 3 AS INT)), '')))""".format(step=f"element_at(array({', '.join(str(3**k) for k in range(LEVELS))}), l + 1)")

PATH = "array<struct<before:string,after:string>>"


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def proof_hash(path: Column) -> Column:
    """The SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def _gather(rows: DataFrame, carried: list[str], name: str) -> tuple[DataFrame, str]:
    """Blocks (key, block, about, levels) of rows (key, at, node, *carried)."""
    inside = F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "node", *carried)
    cut = rows.groupBy("key", F.expr(f"at DIV {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(inside)).alias("rows"))
    about = F.transform("rows", lambda r: F.struct(F.lit(0).alias("_"), *(r[c].alias(c) for c in carried)))
    blocks = cut.select("key", "block", about.alias("about"), F.transform("rows", lambda r: r["node"]).alias("nodes"), (F.col("block") == 0).alias("lone"))
    lone = F.col("lone") & (F.size("nodes") < BLOCK)
    return core.stored(blocks.withColumn("lone", lone).withColumn("levels", F.expr(LEVELS_SQL)).drop("nodes", "lone"), name)


def _grow(rows: DataFrame, carried: list[str], name: str) -> list[tuple[DataFrame, str]]:
    """The rounds of the trees over rows (key, at, node, *carried), from the leaves up; the last has one block per key."""
    rounds = [_gather(rows, carried, name)]
    while (rounds[-1][0].agg(F.max("block")).first()[0] or 0) > 0:
        nodes = rounds[-1][0].select("key", F.col("block").alias("at"), _top().alias("node"))
        rounds.append(_gather(nodes, [], name))
    return rounds


def _top() -> Column:
    return F.get(F.element_at("levels", -1), F.lit(0))


def _descend(blocks: DataFrame, paths: DataFrame, carried: list[str]) -> DataFrame:
    """(key, at, node, path, *carried, *others) of the nodes of ``blocks``, from ``paths`` (key, block, path, *others)."""
    others = [c for c in paths.columns if c not in ("key", "block", "path")]
    above = paths.withColumnsRenamed({"key": "_key", "block": "_block"})
    met = blocks.join(above, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    each = met.select("key", "block", "levels", "path", *others, F.posexplode("about").alias("i", "_about"))
    path = F.concat(F.expr(OWN_SQL), F.col("path"))
    node = F.get(F.get("levels", F.lit(0)), F.col("i"))
    return each.select("key", (F.col("block") * BLOCK + F.col("i")).alias("at"), node.alias("node"), path.alias("path"), *(F.col(f"_about.{c}").alias(c) for c in carried), *others)


def _paths(rounds: list[tuple[DataFrame, str]], top: DataFrame, carried: list[str]) -> DataFrame:
    """The paths of the leaves of ``rounds``, from those of the roots: ``top`` (key, block 0, path, *others)."""
    paths = top
    for blocks, _ in reversed(rounds[1:]):
        paths = _descend(blocks, paths, []).withColumnRenamed("at", "block").drop("node")
    return _descend(rounds[0][0], paths, carried)


def prove(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of every row of ``docs``.

    ``changed``, if given, is a text in place of the row's own, null where it is to stay as it is; shown is then the leaf that
    the row would have with it.  ``fold(shown, path)`` differs from root where a row was tampered with."""
    own = [F.col(c) for c in FIELDS]
    shown = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf_hash(*own[:-1], changed))
    leaves = docs.select(F.col("source").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*own).alias("node"), shown.alias("shown"))
    # A sort over ranges reads its input twice, the texts should be read once.
    leaves, digests = core.stored(leaves, "merkle-digests")
    placed, _, places = ranked(leaves, ["key"], ["doc_id", "node"], "merkle-leaves")
    core.drop(docs.sparkSession, digests)
    rounds = _grow(placed.withColumnRenamed("_at", "at").drop("_group"), ["doc_id", "shown"], "merkle-blocks")
    core.drop(docs.sparkSession, places)
    subroots = rounds[-1][0].select(F.lit(0).alias("key"), F.col("key").alias("source"), _top().alias("node"))
    placed, _, places = ranked(subroots, ["key"], ["source"], "merkle-sources")
    above = _grow(placed.withColumnRenamed("_at", "at").drop("_group"), ["source"], "merkle-sources")
    core.drop(docs.sparkSession, places)
    root = above[-1][0].select("key", "block", F.array().cast(PATH).alias("path"), _top().alias("root"))
    sources = _paths(above, root, ["source"]).select(F.col("source").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root")
    found = _paths(rounds, sources, ["doc_id", "shown"])
    return found.select("doc_id", F.col("key").alias("source"), F.col("node").alias("leaf"), "subroot", "root", "path", F.coalesce("shown", "node").alias("shown"))


def audit(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, against rows as ``changed`` has them."""
    found = prove(docs, changed).withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
