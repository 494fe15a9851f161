"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups.

The nodes of a level stand in aligned blocks of BLOCK nodes, each block as one string of hexadecimal
digests. Fixed-width substrings of such a string are hashed to the level above; the siblings of a node
are the substrings on both sides of it within its run. A block ends in one node, and the nodes of all
blocks go through the same steps again until a group has one root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expressions import col, require_columns

from .common import bounded, join_without_hot_keys, written

# Hexadecimal digits of a SHA-256, nodes of a run, levels within a block.
DIGITS = 64
ARITY = 2
LEVELS = 10
# Rows that one task puts in order.
TASK_ROWS = 500_000

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its number of UTF-8 bytes, a colon and its text; `-` if missing."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered_row(values: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """Whether a row is tampered with in the manifest's own test, and its values then.

    Where 7 divides the CRC-32 of the doc_id's text, n_chars goes up by one; a missing n_chars stays.
    """
    hit = F.crc32(values["doc_id"].cast("string").cast("binary")) % 7 == 0
    more = (values["n_chars"].cast("decimal(38,0)") + 1).cast("string")
    return F.coalesce(hit & values["n_chars"].isNotNull(), F.lit(False)), {**values, "n_chars": more}


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    The leaves of a group stand in ascending doc_id order, missing ids first; equal ids are ordered by
    their leaves, so the result does not depend on where rows are stored. Rows given several times are
    leaves each. A missing group is a group of its own and comes first. A missing or empty text is a
    value like any other (`-` and `0:`). A tree of one leaf has the leaf as its root and an empty proof.
    No rows give no rows. Other columns are left out.
    """
    require_columns(docs, *LEAF_COLUMNS, group, order)
    values = {c: col(c) for c in LEAF_COLUMNS}
    hit, changed = tampered_row(values)
    # Missing groups sort before all others, by a mark that is less than theirs.
    mark = F.coalesce(F.concat(F.lit("+"), col(group).cast("string")), F.lit("!"))
    leaves = docs.select(
        mark.alias("tree"),
        col(order).alias("place"),
        col("doc_id").alias("doc_id"),
        leaf_digest(list(values.values())).alias("node"),
        F.when(hit, leaf_digest(list(changed.values()))).alias("tampered"),
    )
    nodes = positions(leaves.withColumn("own", F.struct("doc_id", "tampered")).drop("doc_id", "tampered"), ["place", "node"])
    blocks, tops = tree_blocks(nodes)

    # The roots of the groups, in order of the groups, are the leaves of the last tree.
    subroots = written(tops.select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("top").alias("node"), F.struct("tree").alias("own")), "subroots")
    above, roots = tree_blocks(positions(subroots, ["place"]))
    above = members(above).join(F.broadcast(roots.select(F.col("top").alias("root"))))
    above = above.select(F.col("own.tree").alias("tree"), F.col("path").alias("group_path"), F.col("node").alias("subroot"), "root")
    above = bounded(above, "group-paths")
    rows = members(join_without_hot_keys(blocks, above, "tree") if above.count() > 1000 else blocks.join(F.broadcast(above), "tree"), "subroot", "root", "group_path")
    return folded(rows.withColumn("path", F.concat("path", "group_path")))


def folded(rows: DataFrame) -> DataFrame:
    """Proof digests and the roots that rows fold to, from node, own.tampered, path and root."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    start = F.coalesce("own.tampered", "node")
    up = F.aggregate("path", start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = rows.select(
        F.col("own.doc_id").alias("doc_id"),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        up.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def positions(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """The nodes with `at`, their place from 0 in their tree, and `total`, the size of the tree.

    Rows go through one range exchange on tree and order. Equal rows are told apart by a number of their
    own, so a row that is repeated without end does not meet in one task either.
    """
    spark = nodes.sparkSession
    keyed = written(nodes, "leaves").withColumn("copy", F.monotonically_increasing_id())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // TASK_ROWS))
    ranged = keyed.repartitionByRange(parts, "tree", *order, "copy").sortWithinPartitions("tree", *order, "copy")
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered-leaves")
    # One row per part and tree: the numbers of rows before it, and of the whole tree.
    slices = ranged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("inside").alias("first"))
    slices = written(slices, "slices").withColumnsRenamed({"part": "_part", "tree": "_tree"})
    earlier = "coalesce(sum(n) over (partition by _tree order by _part rows between unbounded preceding and 1 preceding), 0)"
    slices = slices.selectExpr("_part", "_tree", "first", f"{earlier} as before", "sum(n) over (partition by _tree) as total")
    slices = bounded(slices, "slice-starts")
    placed = ranged.join(slices, (F.col("part") == F.col("_part")) & (F.col("tree") == F.col("_tree")))
    return placed.select("tree", "node", "own", (F.col("before") + F.col("inside") - F.col("first")).alias("at"), "total")


def parents(level: Column, arity: int = ARITY) -> Column:
    """The level above a level that is given as one string."""
    width = arity * DIGITS
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * width + 1, F.lit(width)), 256)), "")


def segments(levels: Column, index: Column, arity: int = ARITY) -> Column:
    """What stands left and right of a node in its run, level by level, but for the last level given."""

    def flanks(level: Column, height: Column) -> Column:
        node = F.floor(index / F.pow(F.lit(float(arity)), height)).cast("int")
        run = F.floor(node / arity).cast("int") * arity
        left = F.substr(level, run * DIGITS + 1, (node - run) * DIGITS)
        right = F.substr(level, (node + 1) * DIGITS + 1, (run + arity - node - 1) * DIGITS)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), flanks)


def tree_blocks(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Blocks of nodes with the paths from their members to the top, and the top of each tree.

    nodes: tree, at, total, node, own. Blocks: tree, members (node, own, path within the block) and
    path, from the block to the top. Tops: tree, top.
    """
    size = arity**levels
    block = F.floor(F.col("at") / size).cast("long")
    grouped = nodes.groupBy("tree", block.alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("at", "node", "own"))).alias("members")
    )
    many = F.col("total") > size
    # A tree of several blocks goes up all levels in each of them; a tree of one block until one node is left.
    first = F.array(F.array_join(F.transform("members", lambda m: m["node"]), ""))

    def climb(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(many | (F.length(last) > DIGITS), F.concat(done, F.array(parents(last, arity)))).otherwise(done)

    grouped = grouped.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), first, climb))
    inner = F.transform("members", lambda m: F.struct(m["node"].alias("node"), m["own"].alias("own"), segments(F.col("levels"), m["at"] % size, arity).alias("path")))
    blocks = grouped.select("tree", "block", "total", inner.alias("members"), F.element_at("levels", -1).alias("head"))
    blocks = written(blocks, "blocks")
    none = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    whole = blocks.where(~many)
    done = whole.select("tree", "members", none.alias("path"))
    tops = whole.select("tree", F.col("head").alias("top"))
    if blocks.where(many).isEmpty():
        return done, tops
    heads = blocks.where(many).select(
        "tree", F.col("block").alias("at"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("head").alias("node"), F.struct("block").alias("own")
    )
    upper, upper_tops = tree_blocks(heads, arity, levels)
    upper = members(upper).select("tree", F.col("own.block").alias("block"), "path")
    rest = blocks.where(many).join(bounded(upper, "paths"), ["tree", "block"]).select("tree", "members", "path")
    return done.unionByName(rest), tops.unionByName(upper_tops)


def members(blocks: DataFrame, *more: str) -> DataFrame:
    """The members of blocks as rows: tree, node, own and the whole path to the top of their tree."""
    rows = blocks.select("tree", F.col("path").alias("upper"), F.explode("members").alias("m"), *more)
    return rows.select("tree", "m.node", "m.own", F.concat("m.path", "upper").alias("path"), *more)
