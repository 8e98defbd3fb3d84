"""Chinese words, found in the texts themselves, and texts cut into them.

No dictionary is at hand, so words are n-grams that are frequent and hold
together: of every cut of the n-gram into two, both parts occur apart much less
often than chance would have it. Texts are cut by the longest word that fits,
from the left.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import STOP_WORDS, TOKEN

HAN = TOKEN.rpartition("|")[2]


def fit_words(docs: DataFrame, text_col: str, longest: int = 4, least: int = 5, cohesion: float = 20.0, most: int = 20_000) -> DataFrame:
    """(word, n, cohesion) of two to ``longest`` characters: the ``most`` most frequent ones, ties by the word.

    A word occurs ``least`` times and its cohesion, the least over its cuts of
    n(word) * n(all characters) / (n(left) * n(right)), reaches ``cohesion``.
    ``most`` bounds what is later sent to the workers. Null texts have no words.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(f"{HAN}+"), F.lit(0))).alias("run"))
    at = F.sequence(F.lit(1), F.length("run"))
    grams = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - i + 1)), lambda n: F.substring(F.col("run"), i, n))))
    counts = runs.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    total = runs.agg(F.sum(F.length("run")).alias("total"))  # one row
    words = counts.filter(F.length("gram") > 1)
    cuts = words.select(F.col("gram").alias("word"), "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("cut"))
    cuts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("cut")).alias("left"), F.expr("substring(word, cut + 1)").alias("right"))
    parts = cuts.join(counts.select(F.col("gram").alias("left"), F.col("n").alias("nl")), "left").join(counts.select(F.col("gram").alias("right"), F.col("n").alias("nr")), "right")
    held = parts.crossJoin(F.broadcast(total)).groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("nl") * F.col("nr"))).alias("cohesion"))
    return held.filter(F.col("cohesion") >= cohesion).orderBy(F.col("n").desc(), "word").limit(most)


def segmenter(words: DataFrame):
    """A function of a text column to its tokens, as ``text.tokens`` gives them but with these words (word, ..) in place of single characters.

    The words come to the driver and go to every worker; ``fit_words`` bounds
    them. Null texts have null.
    """
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(frozenset(r.word for r in words.select("word").toLocalIterator()))
    pattern, han, stop = re.compile(f"[a-z0-9_]+|{HAN}+"), re.compile(HAN), frozenset(STOP_WORDS)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        known = held.value
        longest = max(map(len, known), default=1)
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            tokens: list[str] = []
            for run in pattern.findall(text.lower()):
                if not han.match(run):
                    if run not in stop:
                        tokens.append(run)
                    continue
                at = 0
                while at < len(run):
                    size = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in known), 1)
                    tokens.append(run[at : at + size])
                    at += size
            out.append(tokens)
        return pd.Series(out)

    def of(text: Column) -> Column:
        return cut(text)

    return of
