"""Parent links to full hierarchies: path, depth, root, descendants and faulty links.

The forest's depth is unknown and may be large, so nodes are not walked level
by level. A hash of the id picks *splitters* (about one node in
``splitter_every``; nodes without a usable parent are splitters too). Every
node jumps to its next splitter by pointer doubling, the much smaller graph of
splitters is solved the same way, and each node's chain is its own segment
followed by its splitter's. A cycle without any splitter shows itself when a
node's segment reaches the node again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.scratch import Scratch

SOUND, CYCLE, BELOW_CYCLE, ORPHAN = "ok", "cycle", "below_cycle", "orphan"


def _close_loops(df: DataFrame) -> DataFrame:
    """Ends the walk of each node whose segment holds the node itself, and cuts the segment there."""
    at = F.array_position("seg", F.col("id"))
    return df.withColumn("pos", at).select(
        "id",
        F.when(F.col("pos") > 0, F.col("id")).otherwise(F.col("at")).alias("at"),
        F.when(F.col("pos") > 0, F.slice("seg", F.lit(1), F.col("pos").cast("int"))).otherwise(F.col("seg")).alias("seg"),
        (F.col("done") | (F.col("pos") > 0)).alias("done"),
        (F.col("loop") | (F.col("pos") > 0)).alias("loop"),
        "missing",
    )


def _jump(scratch: Scratch, state: DataFrame) -> DataFrame:
    """Pointer doubling until every row is done.

    Rows: id; at, the node reached; seg, the nodes passed up to and with at;
    done; loop, if the walk ended in a cycle; missing, the absent parent that
    ends the chain. Every ``at`` is an id of the table.
    """
    last, finished = scratch.keep(state), []  # rows that are done are written once and stay where they are
    while not (active := last.filter(~F.col("done"))).isEmpty():
        onward = reduce(DataFrame.unionByName, finished, last).select(
            F.col("id").alias("at"), F.col("at").alias("to"), F.col("seg").alias("more"),
            F.col("done").alias("to_done"), F.col("loop").alias("to_loop"), F.col("missing").alias("to_missing"),
        )
        moved = active.select("id", "at", "seg").join(onward, "at").select(
            "id", F.col("to").alias("at"), F.concat("seg", "more").alias("seg"),
            F.col("to_done").alias("done"), F.col("to_loop").alias("loop"), F.col("to_missing").alias("missing"),
        )
        finished.append(last.filter("done"))
        last = scratch.keep(_close_loops(moved))
    return reduce(DataFrame.unionByName, finished, last)


def hierarchy(df: DataFrame, id_col: str = "chunk_id", parent_col: str = "parent_chunk_id", splitter_every: int = 8) -> DataFrame:
    """One row per distinct non-null id of ``df``.

    Result: id bigint; parent_id; status (ok, cycle, below_cycle, orphan);
    root_id, null unless status is ok; depth, the number of ancestors (in and
    below a cycle: of distinct ones); path array, from the top to the node
    itself; missing_parent_id, the absent parent that ends an orphan's chain.

    Rows with a null id are left out. Of several rows with one id the smallest
    non-null parent counts, so repeated rows change nothing. A node that names
    itself as parent is a cycle. An empty table gives an empty result. Other
    columns, whatever their names, are neither read nor returned.
    """
    scratch = Scratch(df.sparkSession)
    nodes = (
        df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{parent_col}`").cast("bigint").alias("parent"))
        .filter("id IS NOT NULL")
        .groupBy("id").agg(F.min("parent").alias("parent"))
    )
    above = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    linked = scratch.keep(nodes.join(above, "parent", "left").select("id", "parent", F.coalesce("known", F.lit(False)).alias("known")))
    none = F.array().cast("array<bigint>")
    no = F.lit(None).cast("bigint")
    splitter = ~F.col("known") | (F.pmod(F.xxhash64("id"), F.lit(splitter_every)) == 0)

    walk = linked.select(
        "id",
        F.when(splitter, F.col("id")).otherwise(F.col("parent")).alias("at"),
        F.when(splitter, none).otherwise(F.array("parent")).alias("seg"),
        splitter.alias("done"), F.lit(False).alias("loop"), no.alias("missing"),
    )
    walked = _jump(scratch, _close_loops(walk))

    hop = walked.select(F.col("id").alias("parent"), "at", "seg", "loop")
    between = linked.filter(splitter & F.col("known")).join(hop, "parent").select(
        "id", "at", F.concat(F.array("parent"), "seg").alias("seg"), F.col("loop").alias("done"), "loop", no.alias("missing"),
    )
    # a chain that ran into a splitterless cycle is done; it points at itself, as no splitter follows
    between = between.withColumn("at", F.when(F.col("done"), F.col("id")).otherwise(F.col("at")))
    ends = linked.filter(~F.col("known")).select(
        "id", F.col("id").alias("at"), none.alias("seg"), F.lit(True).alias("done"), F.lit(False).alias("loop"), F.col("parent").alias("missing"),
    )
    solved = _jump(scratch, _close_loops(between).unionByName(ends))

    tail = solved.select(F.col("id").alias("at"), F.col("seg").alias("more"), F.col("loop").alias("tail_loop"), "missing")
    inner = walked.filter(~F.col("loop")).select("id", "at", "seg").join(tail, "at").select(
        "id", F.concat("seg", "more").alias("chain"), F.col("tail_loop").alias("loop"), "missing",
    )
    alone = walked.filter("loop").select("id", F.col("seg").alias("chain"), "loop", "missing")
    chains = inner.unionByName(alone).join(linked.select("id", "parent"), "id")

    # in and below a cycle the chain comes back to a node: only the first visit counts
    up = F.filter(F.array_distinct("chain"), lambda x: x != F.col("id"))
    status = (
        F.when(F.col("loop") & F.array_contains("chain", F.col("id")), CYCLE)
        .when(F.col("loop"), BELOW_CYCLE)
        .when(F.col("missing").isNotNull(), ORPHAN)
        .otherwise(SOUND)
    )
    path = F.concat(F.reverse(up), F.array("id"))
    return chains.select(
        "id", F.col("parent").alias("parent_id"), status.alias("status"),
        F.when(status == SOUND, path[0]).alias("root_id"),
        F.size(up).alias("depth"), path.alias("path"), F.col("missing").alias("missing_parent_id"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every pair of ``hierarchy``'s result, without the node itself.

    On a cycle each node is an ancestor of each other one.
    """
    size = F.size("path")
    return (
        tree.select(F.col("id").alias("descendant_id"), size.alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
        .filter(F.col("pos") < F.col("n") - 1)
        .select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))
    )


def faulty_links(tree: DataFrame) -> DataFrame:
    """The nodes whose chain does not end at a node without parent: id and defect."""
    return tree.filter(F.col("status") != SOUND).select("id", F.col("status").alias("defect"))
