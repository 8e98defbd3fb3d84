"""Cosine search: exact top-k in blocks, and an inverted-file index over the same vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.scratch import Scratch

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def dimension(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: the greatest and least length of a vector; a collection is sound if they agree."""
    return vectors.agg(F.max(F.size(col)).alias("dimension"), F.min(F.size(col)).alias("least"))


def _unit(column: pd.Series) -> np.ndarray:
    m = np.asarray(column.tolist(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by falling score and then rising id."""
    return np.lexsort((ids, -scores))[:k] if len(scores) <= 4 * k else _among(scores, ids, k)


def _among(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    at = np.flatnonzero(scores >= edge)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


#: Numbers of all queries' vectors together that are sent to every executor at most (8 bytes each).
BROADCAST_NUMBERS = 4_000_000


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scoped: bool = False, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """(qid, doc, score, rank) of vectors (doc, embedding[, scope]) and queries (qid, embedding[, scope]).

    Queries within ``broadcast_numbers`` go to every executor, where each batch
    of vectors is one matrix product and a task keeps the k best of each query:
    vectors are not shuffled. With more queries, blocks of queries meet blocks of
    vectors by shuffling. With ``scoped``, a query only sees vectors of its
    scope. Scores have six decimals; ties go to the smaller id.
    """
    size = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    parts = _scanned(vectors, queries, k, scoped) if size <= broadcast_numbers else _blocks(vectors, queries, k, scoped)
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scanned(vectors: DataFrame, queries: DataFrame, k: int, scoped: bool) -> DataFrame:
    held = queries.select("qid", "embedding", *(["scope"] if scoped else [])).toPandas()  # within broadcast_numbers
    own = held["scope"].to_numpy() if scoped else None
    sent = vectors.sparkSession.sparkContext.broadcast((held["qid"].to_numpy(), _unit(held["embedding"]) if len(held) else None, own))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit, scopes = sent.value
        best_score = np.empty((len(ids), 0))
        best_doc = np.empty((len(ids), 0), np.int64)
        for v in batches:
            if not len(v) or not len(ids):
                continue
            scores = np.round(unit @ _unit(v["embedding"]).T, 6)
            if scopes is not None:
                scores[scopes[:, None] != v["scope"].to_numpy()[None, :]] = -np.inf
            docs = v["doc"].to_numpy()
            at = np.stack([_padded(_best(row, docs, k), k) for row in scores])
            new = np.where(at >= 0, np.take_along_axis(scores, np.maximum(at, 0), 1), -np.inf)
            best_score, best_doc = np.hstack([best_score, new]), np.hstack([best_doc, docs[np.maximum(at, 0)]])
            order = np.lexsort((best_doc, -best_score), axis=1)[:, :k]
            best_score, best_doc = np.take_along_axis(best_score, order, 1), np.take_along_axis(best_doc, order, 1)
        there = np.isfinite(best_score)
        yield pd.DataFrame({"qid": np.repeat(ids, there.sum(axis=1)), "doc": best_doc[there], "score": best_score[there]})

    return vectors.select("doc", "embedding", *(["scope"] if scoped else [])).mapInPandas(scan, "qid bigint, doc bigint, score double")


def _padded(at: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([at, np.full(k - len(at), -1, at.dtype)])


def _blocks(vectors: DataFrame, queries: DataFrame, k: int, scoped: bool) -> DataFrame:
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    nv = max(1, -(-vectors.count() // VECTOR_BLOCK))
    extra = ["scope"] if scoped else []
    left = queries.select("qid", *extra, "embedding", F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    right = vectors.select("doc", *extra, "embedding", F.pmod(F.xxhash64("doc"), F.lit(nv)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("qb"))

    def multiply(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "doc": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        scores = np.round(_unit(q["embedding"]) @ _unit(v["embedding"]).T, 6)
        ids, out = v["doc"].to_numpy(), []
        for i, qid in enumerate(q["qid"]):
            rows = np.flatnonzero((v["scope"] == q["scope"].iloc[i]).to_numpy()) if scoped else np.arange(len(ids))
            at = rows[_best(scores[i][rows], ids[rows], k)] if len(rows) else rows
            out.append(pd.DataFrame({"qid": qid, "doc": ids[at], "score": scores[i][at]}))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(multiply, "qid bigint, doc bigint, score double")


def list_count(vectors: int) -> int:
    """Lists of an index over so many vectors: the square root, within 16 and 2,048, so that a sample of bounded size can fit them."""
    return max(16, min(2048, round(vectors**0.5)))


def fit_centroids(vectors: DataFrame, lists: int = 16, sample_rows: int = 10_000, rounds: int = 10) -> np.ndarray:
    """Centroids by k-means on at most ``sample_rows`` vectors, those of the smallest hashes of their ids."""
    rows = vectors.select("doc", "embedding").orderBy(F.xxhash64("doc"), "doc").limit(sample_rows).toPandas()
    points = _unit(rows["embedding"])
    centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1)
        centres = np.stack([points[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def choose_probes(vectors: DataFrame, centres: np.ndarray, k: int = 5, recall: float = 0.95, sample_rows: int = 10_000, sample_queries: int = 200) -> int:
    """The least number of lists to look into so that, within a bounded sample, this share of the exact top k is found."""
    rows = vectors.select("doc", "embedding").orderBy(F.xxhash64("doc"), "doc").limit(sample_rows).toPandas()
    points, ids = _unit(rows["embedding"]), rows["doc"].to_numpy()
    own = np.argmax(points @ centres.T, axis=1)
    asked = points[:sample_queries]
    near = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    exact = [own[_best(row, ids, k)] for row in asked @ points.T]
    place = np.concatenate([np.argsort(near[i])[lists] for i, lists in enumerate(exact)])  # how far down the query's order each answer's list is
    return int(np.quantile(place, recall, method="higher")) + 1 if len(place) else 1


def assign_lists(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Adds ``list``: the nearest centroid, or a row for each of the ``probes`` nearest. Every vector is indexed."""
    names = vectors.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", list int"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(-(_unit(pdf["embedding"]) @ centres.T), axis=1, kind="stable")[:, :probes]
            out = pdf.loc[pdf.index.repeat(order.shape[1]), names].reset_index(drop=True)
            out["list"] = order.ravel().astype("int32")
            yield out

    return vectors.mapInPandas(assign, schema)


def indexed_top_k(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 8) -> DataFrame:
    """As ``exact_top_k``, over the vectors in the ``probes`` lists nearest to each query."""
    indexed = Scratch(vectors.sparkSession).keep(assign_lists(vectors.select("doc", "embedding"), centres))
    asked = assign_lists(queries.select("qid", "embedding"), centres, probes)
    # a list may hold a third of all vectors: it is searched in parts of one block; a row per list comes to the driver
    sizes = {r["list"]: -(-r["n"] // VECTOR_BLOCK) for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = F.coalesce(F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("list")], F.lit(1)) if sizes else F.lit(1)
    right = indexed.withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int"))
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))

    def look(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "doc": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        scores, ids = np.round(_unit(q["embedding"]) @ _unit(v["embedding"]).T, 6), v["doc"].to_numpy()
        best = [_best(row, ids, k) for row in scores]
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), [len(b) for b in best]), "doc": np.concatenate([ids[b] for b in best]), "score": np.concatenate([s[b] for s, b in zip(scores, best)])})

    parts = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInPandas(look, "qid bigint, doc bigint, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
