"""BM25 as tables: term statistics, document weights, and top-k for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as txt
from sparquill.scratch import BROADCAST_ROWS, Scratch, bounded


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def term_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, tokens=txt.tokens) -> DataFrame:
    """(doc, the kept columns, dl, term, tf); each text has one row more with a null term, so that it counts without tokens or wanted terms, too.

    ``tokens`` makes a text column an array of tokens: ``text.tokens``, with
    single Chinese characters, or a ``segment.segmenter`` with words.
    """
    keep = keep or []
    each = docs.select(F.col(id_col).alias("doc"), *keep, F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
    marked = F.concat("t", F.array(F.lit(None).cast("string")))
    return each.select("doc", *keep, F.size("t").alias("dl"), F.explode(marked).alias("term")).groupBy("doc", *keep, "dl", "term").agg(F.count("*").alias("tf"))


def kept_counts(counts: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of ``counts`` that searches of queries (query) read, written once: the postings of their terms, and a row for each document."""
    scratch = Scratch(counts.sparkSession, free_shuffles=True)
    terms = scratch.keep(term_counts(queries.select("query").distinct(), "query", "query").filter("term IS NOT NULL").select("term").distinct())
    if terms.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return scratch.keep(counts)
    marked = counts.join(F.broadcast(terms.withColumn("wanted", F.lit(True))), "term", "left")
    return scratch.keep(marked.filter("wanted OR term IS NULL").select(*counts.columns))


def term_stats(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., term, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ``by`` fits per source or scope."""
    by = by or []
    size = corpus_size(counts, by)
    df = counts.filter("term IS NOT NULL").groupBy(*by, "term").agg(F.count("*").alias("df"))
    joined = df.join(F.broadcast(size), by) if by else df.crossJoin(F.broadcast(size))  # without by, one row
    return joined.select(*by, "term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def corpus_size(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    docs = counts.groupBy("doc", *by).agg(F.max("dl").alias("dl"))
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def doc_weights(counts: DataFrame, by: list[str] | None = None, cfg: Bm25 = Bm25()) -> DataFrame:
    """(doc, by.., term, weight): idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))."""
    by = by or []
    size = corpus_size(counts, by)
    rows = counts.filter("term IS NOT NULL").join(term_stats(counts, by), [*by, "term"])
    rows = rows.join(F.broadcast(size), by) if by else rows.crossJoin(F.broadcast(size))
    saturation = F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))
    return rows.select("doc", *by, "term", (F.col("idf") * saturation).alias("weight"))


#: Rows of query terms that are sent to every executor at most; with more, they are joined by shuffling.
BROADCAST_TERMS = 1_000_000

#: Postings that a task scores at most, about.
TASK_POSTINGS = 2_000_000

#: Steps of the saturation, which is below k1 + 1, at which a term's postings are counted.
_STEPS = 22

#: Scores with six decimals differ from the sums by half of one each.
_MARGIN = 2e-6


def search(
    queries: DataFrame, counts: DataFrame, k: int = 5, weighting: str = "idf", cfg: Bm25 = Bm25(), scopes: DataFrame | None = None, allowed: DataFrame | None = None,
    only: DataFrame | None = None, broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each query, ties by the smaller id; scores have six decimals.

    A query's terms are weighted like a document's, or with 1 for each in
    'binary'. With ``scopes`` (doc, scope) and ``allowed`` (qid, scope) a query
    sees the documents of its scopes only, and one without scope none. With
    ``only`` (doc) no other document is seen by any query. Either way the
    statistics stay those of all of ``counts``, of which several passes are
    made: it should be kept, as ``kept_counts`` does with what searches read.

    Equal queries are searched once. Only the postings of the queries' terms
    leave the scan; df and idf are counted for those terms alone. With few enough
    query terms the postings are laid out by document and scored where they lie
    (``_scored``), and only the best of each part are shuffled. Scopes and
    ``only`` are applied before anything is scored.
    """
    return searches(queries, counts, k, (weighting,), cfg, scopes, allowed, only, broadcast_terms)[weighting]


def searches(
    queries: DataFrame, counts: DataFrame, k: int = 5, weightings: tuple[str, ...] = ("idf", "binary"), cfg: Bm25 = Bm25(), scopes: DataFrame | None = None, allowed: DataFrame | None = None,
    only: DataFrame | None = None, broadcast_terms: int = BROADCAST_TERMS,
) -> dict[str, DataFrame]:
    """``search`` with each of the weightings, in one pass over the postings."""
    scratch = Scratch(queries.sparkSession, free_shuffles=True)
    queries = scratch.keep(queries.select("qid", "query").distinct())
    texts = scratch.keep(queries.groupBy("query").agg(F.min("qid").alias("first")))
    own = scratch.keep(term_counts(texts, "first", "query").filter("term IS NOT NULL").withColumnRenamed("doc", "first"))
    terms = bounded(scratch.keep(own.select("term").distinct()))
    postings = counts.join(terms, "term").select("doc", "dl", "term", "tf")
    size = F.broadcast(scratch.keep(corpus_size(counts.filter("term IS NULL"))))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    stats = bounded(scratch.keep(postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(size).select("term", idf, "avgdl", "df")))
    saturation = F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))
    wq = {"binary": F.lit(1.0), "idf": F.col("idf") * saturation}
    asked = own.join(stats, "term").select("first", "term", F.explode(F.array(*(F.struct(F.lit(n).alias("weighting"), wq[n].alias("wq")) for n in weightings))).alias("w")).select("first", "term", "w.*")
    seen, on, named = postings, ["term"], queries.join(texts, "query").select("qid", "first")
    if only is not None:
        seen = seen.join(bounded(scratch.keep(only.select("doc").distinct())), "doc", "left_semi")
    if allowed is not None:
        named = scratch.keep(named.join(allowed.select("qid", "scope").distinct(), "qid"))
        asked = asked.join(named.select("first", "scope").distinct(), "first")
        seen = seen.join(bounded(scratch.keep(scopes.select("doc", "scope").distinct())), "doc")
        on.append("scope")
    # a key is what a posting and a row of a query meet on; of its postings' saturations the greatest, and how many reach each step, bound what it adds to a score
    reached = [F.count_if(F.col("saturation") >= (cfg.k1 + 1) * i / _STEPS).alias(f"n{i}") for i in range(1, _STEPS)]
    steps = seen.join(stats, "term").select(*on, saturation.alias("saturation"), "idf").groupBy(*on).agg(F.max("saturation").alias("most"), F.max("idf").alias("idf"), F.count("*").alias("n"), *reached)
    least = F.coalesce(*(F.when(F.col(f"n{i}") >= k, F.lit((cfg.k1 + 1) * i / _STEPS)) for i in reversed(range(1, _STEPS))), F.lit(0.0))
    keys = scratch.keep(steps.select(*on, "n", (F.col("idf") * F.col("most")).alias("most"), (F.col("idf") * least).alias("least")).withColumn("key", F.monotonically_increasing_id()))
    group = ["first", "weighting", *on[1:]]
    asked = asked.join(keys, on).select(*group, "key", "wq", (F.col("wq") * F.col("most")).alias("most"), (F.col("wq") * F.col("least")).alias("least"))
    # k documents have at least the sum ``enough``, so those that have only keys whose most together is less cannot be among the best
    by_most = Window.partitionBy(*group).orderBy("most", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.max("least").over(Window.partitionBy(*group)) - _MARGIN
    asked = scratch.keep(asked.withColumn("upto", F.sum("most").over(by_most)).withColumn("enough", enough).select(*group, "key", "wq", "most", "enough", (F.col("upto") >= F.col("enough")).alias("leads")))
    weights = seen.join(stats, "term").join(bounded(keys.select(*on, "key")), on).select("doc", "key", (F.col("idf") * saturation).alias("weight"))
    if asked.count() <= broadcast_terms:
        parts = max(weights.sparkSession.sparkContext.defaultParallelism, -(-(keys.agg(F.sum("n")).first()[0] or 0) // TASK_POSTINGS))
        scored = _scored(weights.repartition(parts, "doc"), asked, group, k)
    else:
        hits = weights.join(asked.select(*group, "key", "wq"), "key")
        scored = hits.groupBy("doc", *group).agg(F.round(F.sum(F.col("wq") * F.col("weight")), 6).alias("score"))
    best = scratch.keep(top_k(scored, group, k))
    return {n: _named(named, best.filter(F.col("weighting") == n).drop("weighting"), k) for n in weightings}


def _named(named: DataFrame, best: DataFrame, k: int) -> DataFrame:
    if "scope" in named.columns:  # the best of all of a query's scopes
        return top_k(named.join(best.drop("rank"), ["first", "scope"]).select("qid", "doc", "score"), "qid", k)
    return named.join(best, "first").select("qid", "doc", "score", "rank")


def _scored(weights: DataFrame, asked: DataFrame, group: list[str], k: int) -> DataFrame:
    """(doc, group.., score): of each partition of weights (doc, key, weight) that has all of its documents' rows, at least the k best of each group.

    The rows of ``asked`` go to every executor. A partition's postings are sorted
    by key and document. Documents come from the postings of a group's leading
    keys alone; those that cannot reach ``enough`` are left out before the other
    keys' weights are looked up.
    """
    held = asked.toArrow().sort_by([(c, "ascending") for c in (*group, "leads", "most", "key")])  # within broadcast_terms
    column = lambda name: held.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    heads = held.select(group)
    keys, at = np.unique(column("key"), return_inverse=True)
    change = np.zeros(len(held), bool)
    for name in group:
        codes = held.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    change[:1] = True
    begin = np.flatnonzero(change)
    enough = column("enough")[begin]
    sent = asked.sparkSession.sparkContext.broadcast((heads.take(pa.array(begin)).combine_chunks(), np.append(begin, len(held)), keys, at, column("wq"), column("most"), column("leads"), enough))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, begin, keys, at, wq, most, leads, enough = sent.value
        rows = [b for b in batches if len(b)]
        if not rows or not len(at):
            return
        rows = pa.Table.from_batches(rows)
        key = np.searchsorted(keys, rows.column("key").to_numpy())
        asks = keys[np.minimum(key, len(keys) - 1)] == rows.column("key").to_numpy()
        ids, doc = np.unique(rows.column("doc").to_numpy()[asks], return_inverse=True)
        key, weight = key[asks], rows.column("weight").to_numpy()[asks]
        order = np.lexsort((doc, key))
        key, doc, weight = key[order], doc[order].astype(np.int32), weight[order]
        start = np.searchsorted(key, np.arange(len(keys) + 1))
        first, last = start[at], start[at + 1]
        there = last > first
        active = np.flatnonzero(np.logical_or.reduceat(there & leads, begin[:-1])).tolist()
        begin, first, last, there, wq, most, leads, enough = (x.tolist() for x in (begin, first, last, there, wq, most, leads, enough))
        sums, out = np.zeros(len(ids)), []
        for g in active:
            mine = [i for i in range(begin[g], begin[g + 1]) if there[i]]
            ahead, rest = [i for i in mine if leads[i]], [i for i in mine if not leads[i]]
            could = sum(most[i] for i in rest)
            if len(ahead) == 1:
                i = ahead[0]
                found, score = doc[first[i] : last[i]], weight[first[i] : last[i]] * wq[i]
            else:
                for i in ahead:
                    sums[doc[first[i] : last[i]]] += weight[first[i] : last[i]] * wq[i]
                if sum(last[i] - first[i] for i in ahead) * 8 > len(ids):
                    found = np.flatnonzero(sums + could >= enough[g]) if enough[g] > could else np.flatnonzero(sums)
                    score = sums[found]
                    sums[:] = 0
                else:
                    found = np.unique(np.concatenate([doc[first[i] : last[i]] for i in ahead]))
                    score = sums[found]
                    sums[found] = 0
            for i in reversed(rest):
                on = score + could >= enough[g]
                if not on.all():
                    found, score = found[on], score[on]
                if not len(found):
                    break
                docs, w = doc[first[i] : last[i]], weight[first[i] : last[i]]
                if 16 * len(found) < len(docs):
                    place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    score = score + np.where(docs[place] == found, w[place] * wq[i], 0.0)
                else:
                    sums[docs] = w * wq[i]
                    score = score + sums[found]
                    sums[docs] = 0
                could -= most[i]
            if len(score) > k:
                on = score >= enough[g]
                found, score = found[on], score[on]
            score = np.floor(score * 1e6 + 0.5) / 1e6
            if len(score) > k:
                on = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[on], score[on]
                order = np.lexsort((found, -score))[:k]  # a smaller place is a smaller id
                found, score = found[order], score[order]
            out.append((g, found, score))
        if out:
            of = groups.take(pa.array(np.repeat([g for g, _, _ in out], [len(f) for _, f, _ in out])))
            docs, scores = ids[np.concatenate([f for _, f, _ in out])], np.concatenate([s for _, _, s in out])
            table = pa.table([pa.array(docs, rows.schema.field("doc").type), *of.columns, pa.array(scores)], names=["doc", *of.column_names, "score"])
            yield from table.combine_chunks().to_batches(max_chunksize=100_000)

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    schema = f"doc {kind(weights, 'doc')}, " + ", ".join(f"`{c}` {kind(asked, c)}" for c in group) + ", score double"
    return weights.mapInArrow(run, schema)


def top_k(scored: DataFrame, key: str | list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col("score").desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
