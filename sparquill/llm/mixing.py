"""Mixing sources to target weights by hash thresholds, without sorting a source.

Each document has a hash. A source's budget of tokens is met by whole passes
over the source and one pass over the documents whose hash is below a
threshold. The threshold comes from a histogram of tokens by hash bucket; only
the bucket in which the budget ends is split further. Thresholds are nested: a
larger budget draws the same documents and more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.scratch import Scratch

_HASH_BITS = 40
_DIGIT = 8  # a histogram has at most 256 rows per target


def normal_source(source: str = "source"):
    return F.lower(F.trim(F.col(source)))


def mix(sized: DataFrame, targets: DataFrame, mix_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawn, report) from sized (id, source, n_tokens) and targets (source, target_share, max_repeats).

    drawn: id, source (as in targets), n_tokens, repeats: how often the document
    is in the mix, at least 1. report, one row per target: source, target_share,
    max_repeats, available_tokens, budget_tokens, drawn_tokens, actual_share
    (of all drawn tokens), reachable (available_tokens * max_repeats reaches
    target_share of the mix).

    The mix holds ``mix_tokens``, by default as many tokens as all of ``sized``.
    A source is drawn to within one document of its budget, or max_repeats times
    if that is less. Sources compare trimmed and in lower case; documents whose
    source is null or in no target are not drawn but count in the default total.
    Null or negative sizes count as 0. Repeated rows are drawn together, and so
    are rows with a null id. Several targets of one name: the one with the largest share
    counts. Empty tables give empty draws and a report of what is missing.
    """
    scratch = Scratch(sized.sparkSession)
    rows = scratch.keep(
        sized.select(
            "id", normal_source().alias("s"), F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"),
            F.shiftrightunsigned(F.xxhash64("id"), 64 - _HASH_BITS).alias("h"),
        )
    )
    want = targets.select(F.col("source").alias("name"), normal_source().alias("s"), F.col("target_share").cast("double").alias("share"), F.greatest(F.col("max_repeats").cast("int"), F.lit(0)).alias("most"))
    first = Window.partitionBy("s").orderBy(F.col("share").desc(), "name", "most")
    want = want.filter("s IS NOT NULL AND share IS NOT NULL AND most IS NOT NULL").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")

    every = scratch.keep(rows.groupBy("s", F.shiftright("h", _HASH_BITS - _DIGIT).alias("bucket")).agg(F.sum("n").alias("t")))
    held = every.groupBy("s").agg(F.sum("t").alias("held"))
    hist = scratch.keep(every.join(want.select("s"), "s", "left_semi"))
    total = F.lit(mix_tokens).cast("bigint").alias("mix") if mix_tokens is not None else F.coalesce(F.sum("held"), F.lit(0)).alias("mix")
    size = held.agg(total) if mix_tokens is None else sized.sparkSession.range(1).select(total)
    plan = want.join(held, "s", "left").crossJoin(size).withColumn("held", F.coalesce("held", F.lit(0)))  # size is one row
    plan = plan.withColumn("budget", F.col("share") * F.col("mix"))
    whole = F.when(F.col("held") <= 0, F.lit(0)).otherwise(F.least(F.floor(F.col("budget") / F.col("held")), F.col("most").cast("bigint")))
    plan = plan.withColumn("whole", whole.cast("int"))
    rest = F.when(F.col("whole") >= F.col("most"), F.lit(0.0)).otherwise(F.col("budget") - F.col("whole") * F.col("held"))
    plan = scratch.keep(plan.withColumn("rest", rest).withColumn("reachable", F.col("held") * F.col("most") >= F.col("budget")))

    # below: the first hash that is not drawn in the last pass, digit by digit
    bound, done = plan.select("s", F.lit(0).cast("bigint").alias("below"), F.col("rest").alias("left")), 0
    while True:
        w = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = hist.withColumn("upto", F.sum("t").over(w))
        ends = bound.join(upto, "s", "left").groupBy("s", "below", "left").agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("bucket"))) + 1, F.shiftleft("below", _DIGIT)).alias("next"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("used"),
        )
        # a bucket that is not in the histogram is empty: the next one that is not holds the end
        opened = ends.select("s", F.col("next").alias("below"), (F.col("left") - F.col("used")).alias("left"))
        ahead = opened.join(hist.select("s", "bucket"), "s", "left").groupBy("s", "below", "left").agg(F.min(F.when(F.col("bucket") >= F.col("below"), F.col("bucket"))).alias("b"))
        bound = scratch.keep(ahead.select("s", F.coalesce("b", "below").alias("below"), "left"))
        done += _DIGIT
        if done >= _HASH_BITS:
            break
        inside = rows.join(bound.select("s", "below"), "s").filter(F.shiftright("h", _HASH_BITS - done) == F.col("below"))
        scratch.drop(hist)
        hist = scratch.keep(inside.groupBy("s", F.shiftright("h", _HASH_BITS - done - _DIGIT).alias("bucket")).agg(F.sum("n").alias("t")))

    rule = plan.select("s", "name", "whole", "most").join(bound.select("s", "below"), "s")
    drawn = rows.join(rule, "s").withColumn("repeats", F.least(F.col("most"), F.col("whole") + (F.col("h") < F.col("below")).cast("int")))
    drawn = drawn.filter("repeats > 0").select("id", F.col("name").alias("source"), F.col("n").alias("n_tokens"), "repeats")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("got"))
    report = plan.join(got, plan["name"] == got["source"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    every = Window.partitionBy(F.lit(0))  # a row per target
    report = report.select(
        F.col("name").alias("source"), F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), F.col("held").alias("available_tokens"),
        F.col("budget").alias("budget_tokens"), F.col("got").alias("drawn_tokens"), F.try_divide("got", F.sum("got").over(every)).alias("actual_share"), "reachable",
    )
    return drawn, report
