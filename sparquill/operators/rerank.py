"""Models as hooks: encoders and pair scorers that run on Arrow batches, with simple ones that need no download."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import STOP_WORDS, TOKEN
from sparquill.operators.fusion import rerank_order
from sparquill.scratch import Scratch

Encoder = Callable[[Sequence[str]], np.ndarray]  # (texts, dimension)
Scorer = Callable[[Sequence[str], Sequence[str]], np.ndarray]  # of each query and text

_TOKEN, _STOP = re.compile(TOKEN), frozenset(STOP_WORDS)


def _tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if t not in _STOP]


@lru_cache(maxsize=100_000)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


def bag_of_words(texts: Sequence[str], dimension: int = 64) -> np.ndarray:
    """Hashed counts of tokens with signs, of length 1; the zero vector for a text without tokens."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts):
        for token in _tokens(text):
            h = _token_hash(token)
            row[(h >> 1) % dimension] += 1 if h & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def shared_tokens(queries: Sequence[str], texts: Sequence[str]) -> np.ndarray:
    """The share of the query's distinct tokens that the text has; 0 without any."""
    out = np.zeros(len(queries))
    for i, (query, text) in enumerate(zip(queries, texts)):
        wanted = set(_tokens(query))
        out[i] = len(wanted & set(_tokens(text))) / len(wanted) if wanted else 0.0
    return out


def encode(df: DataFrame, text_col: str, encoder: Encoder = bag_of_words, name: str = "embedding") -> DataFrame:
    """The rows of ``df``, without the text, with the encoder's vector of it; a null text has that of an empty one."""
    heads = [c for c in df.columns if c != text_col]
    rows = df.select(*heads, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = encoder([t or "" for t in b.column(len(heads)).to_pylist()])
            vectors = pa.array(list(np.asarray(made, np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(heads))), vectors], names=[*heads, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in heads)
    return rows.mapInArrow(run, f"{schema}, {name} array<float>")


def score_pairs(df: DataFrame, query_col: str, text_col: str, scorer: Scorer = shared_tokens, name: str = "rerank_score") -> DataFrame:
    """The rows of ``df`` without query and text, with the scorer's value of each pair, six decimals; nulls count as empty."""
    heads = [c for c in df.columns if c not in (query_col, text_col)]
    rows = df.select(*heads, F.col(query_col).alias("__query"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query, text = ([t or "" for t in b.column(len(heads) + k).to_pylist()] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(heads))), pa.array(np.round(scorer(query, text), 6), pa.float64())], names=[*heads, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in heads)
    return rows.mapInArrow(run, f"{schema}, {name} double")


def rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame, k: int = 5, budget: int = 20, scorer: Scorer = shared_tokens) -> DataFrame:
    """The first ``k`` of fused (qid, doc, fused_score, final_rank) after the first ``budget`` of each query are scored again.

    queries: (qid, query), texts: (doc, text), ids unique. Only the texts within
    the budget are read by the scorer.
    """
    within = fused.filter(F.col("final_rank") <= budget).select("qid", "doc", "fused_score", "final_rank")
    scored = score_pairs(within.join(queries.select("qid", "query"), "qid").join(texts.select("doc", "text"), "doc"), "query", "text", scorer)
    return rerank_order(scored, budget=budget).filter(F.col("rerank_rank") <= k)


def cached_calls(requests: DataFrame, model: Callable[[Sequence[str]], Sequence[str]], path: str, at_once: int = 4, batch: int = 64) -> DataFrame:
    """The rows of requests (request, ..) with the model's response: each distinct request is asked once, ever.

    Answers are kept as a Parquet table at ``path``; only what it does not hold is
    asked, by at most ``at_once`` tasks, ``batch`` requests a call. A failing
    batch is asked one by one, and a request that fails alone has a null
    response with its error and is asked again next time. Null requests have
    neither response nor error.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], _ANSWERS).write.mode("append").parquet(path)
    held = spark.read.schema(_ANSWERS).parquet(path)
    asked = requests.select("request").filter("request IS NOT NULL").distinct().join(held.select("request"), "request", "left_anti")

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return model([text])[0], None
        except Exception as e:  # noqa: BLE001  any failure of a model is told, not raised
            return None, str(e)[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    answers = [(a, None) for a in model(part)]
                except Exception:  # noqa: BLE001
                    answers = [one(t) for t in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (part, *zip(*answers))], names=["request", "response", "error"])

    made = Scratch(spark).keep(asked.repartition(at_once).mapInArrow(run, _ANSWERS))
    made.filter("error IS NULL").write.mode("append").parquet(path)
    answers = held.select("request", "response", F.lit(None).cast("string").alias("error")).unionByName(made)
    return requests.join(answers.dropDuplicates(["request"]), "request", "left")


_ANSWERS = "request string, response string, error string"
