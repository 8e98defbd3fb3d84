"""Relation graphs: directed edges, bounded expansion from seeds, and the life of inferred relations.

Edges: edge_id, source, target, relation_type, direction, is_hard[, scope].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.scratch import Scratch, bounded

# fixed values: what a relation is called when read backwards
REVERSED = {"calls": "called_by", "called_by": "calls", "fk_references": "fk_referenced_by", "fk_referenced_by": "fk_references"}
DEFAULT_RELATIONS = ("calls", "called_by", "fk_references", "fk_referenced_by", "inferred")
HARD_WEIGHT, SOFT_WEIGHT, DECAY, MAX_HOP, MAX_BUDGET = 1.0, 0.3, 0.5, 3, 20


def directed_edges(edges: DataFrame, direction: str = "bidirectional", relations: tuple[str, ...] | None = None) -> DataFrame:
    """(scope, from, to, edge_id, relation_type, direction, is_hard), forwards and or backwards.

    ``relations`` filters by the stored type, before it is reversed; soft edges
    keep their type. Only active soft edges may be passed in.
    """
    scope = F.col("scope") if "scope" in edges.columns else F.lit(0)
    rows = edges.select(scope.alias("scope"), "source", "target", "edge_id", "relation_type", "direction", "is_hard")
    if relations:
        rows = rows.filter(F.col("relation_type").isin(*relations))
    ahead = rows.select("scope", F.col("source").alias("from"), F.col("target").alias("to"), "edge_id", "relation_type", "direction", "is_hard")
    names = F.create_map(*(F.lit(x) for pair in REVERSED.items() for x in pair))
    kind = F.when(F.col("is_hard"), F.coalesce(names[F.col("relation_type")], F.col("relation_type"))).otherwise(F.col("relation_type"))
    back = rows.select("scope", F.col("target").alias("from"), F.col("source").alias("to"), "edge_id", kind.alias("relation_type"), F.when(F.col("direction") == "out", "in").otherwise("out").alias("direction"), "is_hard")
    return {"out": ahead, "in": back, "bidirectional": ahead.unionByName(back)}[direction]


def expand(seeds: DataFrame, directed: DataFrame, hops: int = 2, budget: int | None = None) -> DataFrame:
    """(qid, scope, doc, start, hop, weight, is_hard, path), the best path to each node a query's seeds reach.

    seeds: (qid, scope, doc). A path's weight is that of its last edge, 1 if hard
    and 0.3 if soft, halved per hop after the first; a path does not return to
    a node it left from, but may end at a seed. Hops are unrolled joins, at most
    three. Best: weight, then fewer hops, then the start, then the edges.

    A path goes on from each node it may come to only as often as that can
    matter: what follows depends on the last edge and on the nodes that must not
    come again, so of all ways from a start to a node the best is kept, and at
    the second hop the best two with a different node between. With ``budget`` a
    query stops as soon as so many of its nodes outweigh all that further hops
    can bring; ``within_budget`` of the result is the same with and without.
    """
    query, ids = ["qid", "scope"], lambda path: F.array_join(F.transform(path, lambda e: e["edge_id"].cast("string")), ",")
    front = seeds.select(*query, F.col("doc").alias("start"), F.col("doc").alias("from"), F.lit(None).cast(seeds.schema["doc"].dataType).alias("between"), F.array().alias("path")).distinct()
    best: DataFrame | None = None
    hops = min(hops, MAX_HOP)
    for hop in range(1, hops + 1):
        weight = F.when(F.col("is_hard"), HARD_WEIGHT).otherwise(SOFT_WEIGHT) * (DECAY ** (hop - 1))
        edge = F.struct(F.lit(hop).alias("hop"), "edge_id", "relation_type", "direction", "is_hard")
        path = F.array(edge) if hop == 1 else F.concat("path", F.array(edge))
        ways = front.join(directed, ["scope", "from"])
        if hop > 1:
            ways = ways.filter((F.col("to") != F.col("start")) & (F.col("between").isNull() | (F.col("to") != F.col("between"))))
        ways = ways.select(*query, "start", "from", F.col("to").alias("doc"), weight.alias("weight"), "is_hard", path.alias("path"))
        found = ways.groupBy(*query, "doc").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.lit(hop).alias("hop"), "start", ids(F.col("path")).alias("edges"), "is_hard", "path")).alias("b"))
        best = found if best is None else best.unionByName(found).groupBy(*query, "doc").agg(F.min("b").alias("b"))
        if hop == hops:
            break
        onward = ways.groupBy(*query, "start", "doc", "from").agg(F.min(F.struct(ids(F.col("path")).alias("edges"), "path")).alias("p"))
        if hop > 1:  # the node between must not come again: with two of them one is always left
            w = Window.partitionBy(*query, "start", "doc").orderBy("p.edges")
            onward = onward.withColumn("n", F.row_number().over(w)).filter("n <= 2")
        front = onward.select(*query, "start", F.col("doc").alias("from"), F.when(F.lit(hop > 1), F.col("from")).alias("between"), F.col("p.path").alias("path"))
        if budget is not None:
            ahead = best.groupBy(*query).agg(F.count_if(-F.col("b.w") > HARD_WEIGHT * DECAY**hop).alias("n")).filter(F.col("n") >= min(budget, MAX_BUDGET))
            front = front.join(ahead.select(*query), query, "left_anti")
    return best.select(*query, "doc", "b.start", "b.hop", (-F.col("b.w")).alias("weight"), "b.is_hard", "b.path")


def within_budget(expanded: DataFrame, budget: int = 10) -> DataFrame:
    """The first ``budget`` candidates of each query and scope, over all hops, with graph_rank."""
    w = Window.partitionBy("qid", "scope").orderBy(F.col("weight").desc(), "hop", "doc")
    return expanded.withColumn("graph_rank", F.row_number().over(w)).filter(F.col("graph_rank") <= min(budget, MAX_BUDGET))


def reach(seeds: DataFrame, directed: DataFrame, hops: int = 2, budget: int = 10) -> DataFrame:
    """(qid, scope, doc, hop, weight, graph_rank): ``within_budget`` of ``expand``, without the paths.

    A hop takes the hard edges first, and the soft ones only for queries of which
    fewer than ``budget`` nodes outweigh them and all that may follow, so the
    many soft edges of a hub are not walked for queries that have enough. Of a
    query no more than ``budget`` nodes are held, and only edges that leave the
    nodes come to are read.
    """
    query, budget, hops = ["qid", "scope"], min(budget, MAX_BUDGET), min(hops, MAX_HOP)
    scratch = Scratch(seeds.sparkSession, free_shuffles=True)
    hard = F.coalesce("is_hard", F.lit(False))
    place = Window.partitionBy(*query).orderBy(F.col("weight").desc(), "hop", "doc")

    def without_those_with_enough(front: DataFrame, best: DataFrame, weight: float) -> DataFrame:
        enough = best.filter(F.col("weight") > weight).groupBy(*query).agg(F.count("*").alias("n")).filter(F.col("n") >= budget)
        return front.join(enough.select(*query), query, "left_anti")

    def ways(front: DataFrame, edges: DataFrame) -> DataFrame:
        nodes = bounded(scratch.keep(front.select("scope", "from").distinct()))
        near = scratch.keep(edges.join(nodes, ["scope", "from"], "left_semi").select("scope", "from", "to").distinct())
        out = bounded(front).join(bounded(near), ["scope", "from"])
        return out.filter(F.col("back").isNull() | ((F.col("to") != F.col("back")) & (F.col("between").isNull() | (F.col("to") != F.col("between")))))

    nothing = F.lit(None).cast(seeds.schema["doc"].dataType)
    # back: the start, where a path must not come to; nothing in the first hop
    front = scratch.keep(seeds.select(*query, F.col("doc").alias("start"), F.col("doc").alias("from")).distinct().withColumns({"back": nothing, "between": nothing}))
    best: DataFrame | None = None
    for hop in range(1, hops + 1):
        follows = HARD_WEIGHT * DECAY**hop if hop < hops else 0.0
        for is_hard, first in ((True, HARD_WEIGHT), (False, SOFT_WEIGHT)):
            weight = first * DECAY ** (hop - 1)
            who = front if is_hard else scratch.keep(without_those_with_enough(front, best, max(weight, follows)))
            if not is_hard and who.isEmpty():
                continue
            found = ways(who, directed.filter(hard if is_hard else ~hard)).select(*query, F.col("to").alias("doc"), F.lit(hop).alias("hop"), F.lit(weight).alias("weight")).distinct()
            if best is not None:
                found = best.unionByName(found).groupBy(*query, "doc").agg(F.min(F.struct((-F.col("weight")).alias("w"), "hop")).alias("b")).select(*query, "doc", "b.hop", (-F.col("b.w")).alias("weight"))
            best = scratch.keep(found.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= budget).drop("n"))
        if hop == hops:
            break
        going = scratch.keep(without_those_with_enough(front, best, follows))
        if going.isEmpty():
            break
        onward = ways(going, directed).select(*query, "start", F.col("to").alias("from"), F.col("from").alias("last"))
        if hop > 1:  # the node between must not come again: with two of them one is always left
            w = Window.partitionBy(*query, "start", "from").orderBy("last")
            onward = onward.distinct().withColumn("n", F.row_number().over(w)).filter("n <= 2")
        front = scratch.keep(onward.select(*query, "start", "from", F.col("start").alias("back"), F.when(F.lit(hop > 1), F.col("last")).alias("between")))
    return best.withColumn("graph_rank", F.row_number().over(place))


def soft_state(confidence, evidence):
    """The state of a new relation: active from a confidence of 0.6 with evidence, else inferred."""
    return F.when((confidence >= 0.6) & (F.size(evidence) > 0), "active").otherwise("inferred")


def supersede(soft: DataFrame) -> DataFrame:
    """Adds superseded_by: of the active rows of one (source, target, type), the newer with the highest confidence replaces weaker ones."""
    w = Window.partitionBy("source", "target", "relation_type")
    best = F.max(F.when(F.col("lifecycle_state") == "active", F.struct("confidence", F.col("edge_id")))).over(w)
    out = soft.withColumn("best", best)
    beaten = (F.col("lifecycle_state") == "active") & (F.col("best.confidence") > F.col("confidence"))
    return out.withColumn("superseded_by", F.when(beaten, F.col("best.edge_id"))).withColumn("lifecycle_state", F.when(beaten, "superseded").otherwise(F.col("lifecycle_state"))).drop("best")


def retire(soft: DataFrame) -> DataFrame:
    return soft.withColumn("lifecycle_state", F.when(F.col("lifecycle_state") == "superseded", "retired").otherwise(F.col("lifecycle_state")))


def add_edges(existing: DataFrame, new: DataFrame, key: tuple[str, ...] = ("source", "target", "relation_type", "direction")) -> DataFrame:
    """Inserts that do nothing where the key is there already."""
    return existing.unionByName(new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti"))


def annotate(evidence: DataFrame, hard: DataFrame, soft: DataFrame, key: str = "doc") -> DataFrame:
    """Adds relation: the hard edge's struct where there is one, else the soft one's."""
    one = lambda df, name: df.groupBy(F.col("target").alias(key)).agg(F.min(F.struct("edge_id", "relation_type", "is_hard")).alias(name))
    return evidence.join(one(hard, "h"), key, "left").join(one(soft, "s"), key, "left").withColumn("relation", F.coalesce("h", "s")).drop("h", "s")


def neighbours(node_seeds: DataFrame, directed: DataFrame, budget: int = 10) -> DataFrame:
    """The nodes one hop from each seed, within the budget."""
    return within_budget(expand(node_seeds, directed, 1), budget)


def path_rows(expanded: DataFrame) -> DataFrame:
    """One row per step of each candidate's path: (qid, doc, hop, edge_id, relation_type, direction, is_hard)."""
    return expanded.select("qid", "doc", F.explode("path").alias("p")).select("qid", "doc", "p.hop", "p.edge_id", "p.relation_type", "p.direction", "p.is_hard")


def rebuild_scope(existing: DataFrame, scopes: DataFrame, extracted: DataFrame) -> DataFrame:
    """Edges after the scopes (scope) were emptied and their newly extracted edges put in; other scopes stay."""
    kept = existing.join(scopes.select("scope").distinct(), "scope", "left_anti")
    return kept.unionByName(extracted.join(scopes.select("scope").distinct(), "scope", "left_semi"))


def scopes_with_edges(scopes: DataFrame, hard: DataFrame, soft: DataFrame) -> DataFrame:
    """The scopes (scope, ..) that have a hard edge or an active soft one."""
    there = hard.select("scope").unionByName(soft.filter("lifecycle_state = 'active'").select("scope")).distinct()
    return scopes.join(there, "scope", "left_semi")
