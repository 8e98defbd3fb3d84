"""Percentiles of very large numeric columns, by radix selection.

Values become integers of the same order; one histogram per digit, from the
highest bits down, tells which digit holds each wanted rank, and only the rows
with that digit are counted further. The answer is exact (nearest rank), each
pass shuffles counts only, and no group is ever sorted or gathered.

For answers that are put together later, ``sketch`` keeps the leading digits
of the same integers with their counts: sketches of partitions or days add up,
and a percentile read from the sum is off by at most ``relative_error``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.scratch import Scratch

_INT_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_LOW63 = 0x7FFFFFFFFFFFFFFF
_SIGN = -0x8000000000000000


@F.pandas_udf(T.LongType())
def _double_key(value: pd.Series) -> pd.Series:
    """The bits of a double as a bigint whose order is that of the values; -0.0 counts as 0.0."""
    bits = (value.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _LOW63, bits))


@F.pandas_udf(T.DoubleType())
def _key_double(key: pd.Series) -> pd.Series:
    bits = key.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _LOW63, bits).view(np.float64))


def _keyed(df: DataFrame, group_by: Sequence[str], value: str) -> tuple[DataFrame, list[str], int, bool]:
    """(g0.., u): u is the value as an unsigned integer of so many bits, in the value's order."""
    kind = df.select(F.col(value)).dtypes[0][1]
    whole = kind in _INT_BITS
    groups = [f"g{i}" for i in range(len(group_by))]
    key, bits = (F.col("v").cast("bigint"), _INT_BITS[kind]) if whole else (_double_key(F.col("v")), 64)
    rows = df.select(*(F.col(c).alias(g) for c, g in zip(group_by, groups)), F.col(value).cast("bigint" if whole else "double").alias("v"))
    rows = rows.filter("v IS NOT NULL" if whole else "v IS NOT NULL AND NOT isnan(v)")
    u = key.bitwiseXOR(F.lit(_SIGN)) if bits == 64 else key + F.lit(1 << (bits - 1))
    return rows.select(*groups, u.alias("u")), groups, bits, whole


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased sides, a null being equal to a null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def radix_percentiles(
    df: DataFrame, group_by: Sequence[str], value: str, percentiles: Sequence[float] = (0.5, 0.95, 0.99), names: Sequence[str] | None = None, digit_bits: int = 11,
) -> DataFrame:
    """One row per group: the group columns, n, and a column per percentile (p50, p95, ... or ``names``).

    A percentile is the value at rank ceil(p * n), at least 1: a value that
    occurs. Null and NaN values do not count; a group without other values is
    left out, and so is everything of an empty table. A null in a group column
    is a group of its own. Ties need no care, as equal values share a digit.
    Other columns are not read, whatever their names. Integers come back as
    bigint, other numbers as double.
    """
    names = list(names or (f"p{round(p * 100, 4):g}".replace(".", "_") for p in percentiles))
    scratch = Scratch(df.sparkSession)
    keyed, groups, bits, whole = _keyed(df, group_by, value)
    data = scratch.keep(keyed)

    # the first digit's histogram also gives n, and so the ranks
    done, step = 0, bits % digit_bits or digit_bits
    hist = data.groupBy(*groups, F.shiftrightunsigned("u", bits - step).alias("digit")).agg(F.count("*").alias("c"))
    hist = scratch.keep(hist)
    sizes = hist.groupBy(*groups).agg(F.sum("c").alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(p)) - 1e-9)).cast("bigint").alias("rank")) for i, p in enumerate(percentiles))))
    sought = sizes.select(*groups, "n", wanted.alias("w")).select(*groups, "n", F.col("w.i").alias("i"), F.col("w.rank").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    hist = hist.withColumn("prefix", F.lit(0).cast("bigint"))
    while True:
        upto = _running(hist, [*groups, "prefix"])
        on = _same("w", "h", [*groups, "prefix"]) & (F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto"))
        sought = scratch.keep(
            sought.alias("w").join(upto.alias("h"), on).select(
                *(F.col(f"w.{g}") for g in groups), "w.n", "i", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"),
                F.shiftleft("w.prefix", step).bitwiseOR(F.col("digit")).alias("prefix"),
            )
        )
        done += step
        if done >= bits:
            break
        step = digit_bits
        live = sought.select(*groups, "prefix").distinct()
        here = data.withColumn("prefix", F.shiftrightunsigned("u", bits - done))
        digit = F.shiftrightunsigned("u", bits - done - step).bitwiseAND(F.lit((1 << step) - 1))
        follow = here.alias("d").join(live.alias("l"), _same("d", "l", [*groups, "prefix"]), "left_semi")
        hist = follow.groupBy(*groups, "prefix", digit.alias("digit")).agg(F.count("*").alias("c"))
    scratch.drop(data)

    key = F.col("prefix").bitwiseXOR(F.lit(_SIGN)) if bits == 64 else F.col("prefix") - F.lit(1 << (bits - 1))
    found = F.col("found")
    sought = sought.withColumn("found", key if whole else _key_double(key))
    out = sought.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("i") == i, found)).alias(f"q{i}") for i in range(len(names))))
    return out.select(*(F.col(g).alias(c) for c, g in zip(group_by, groups)), "n", *(F.col(f"q{i}").alias(x) for i, x in enumerate(names)))


def _running(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A running count by digit; a partition of the window has at most 2^digit_bits rows."""
    w = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("upto", F.sum("c").over(w))


def sketch(df: DataFrame, group_by: Sequence[str], value: str, mantissa_bits: int = 7) -> DataFrame:
    """A mergeable histogram: the group columns, bucket, n.

    A bucket is the value's order-preserving integer without all but
    ``mantissa_bits`` bits of the mantissa, so its width is at most
    2^-mantissa_bits of its values. Null and NaN values do not count.
    """
    rows = df.select(*group_by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)")
    rows = rows.withColumn("bucket", F.shiftright(_double_key(F.col("__v")), 52 - mantissa_bits))
    return rows.groupBy(*group_by, "bucket").agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """The sketch of everything that ``sketches`` (any union of sketches of one width) covers, for coarser or equal groups."""
    return sketches.groupBy(*group_by, "bucket").agg(F.sum("n").alias("n"))


def sketch_percentiles(merged: DataFrame, group_by: Sequence[str], percentiles: Sequence[float] = (0.5, 0.95, 0.99), mantissa_bits: int = 7) -> DataFrame:
    """Group columns, n and p50_low, p50_high, ...: the bounds between which each percentile lies.

    low is a bucket's least value and high its greatest; the exact percentile is
    one of the values between.
    """
    w = Window.partitionBy(*group_by)
    ranked = merged.select(*group_by, "bucket", "n", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("total"))
    key = F.shiftleft("bucket", 52 - mantissa_bits)
    ranked = ranked.withColumn("low", _key_double(key)).withColumn("high", _key_double(key.bitwiseOR(F.lit((1 << (52 - mantissa_bits)) - 1))))
    low, high, aggs = F.col("low"), F.col("high"), []
    for p in percentiles:
        rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(p)) - 1e-9))
        here = (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))
        name = f"p{round(p * 100, 4):g}".replace(".", "_")
        aggs += [F.max(F.when(here, low)).alias(f"{name}_low"), F.max(F.when(here, high)).alias(f"{name}_high")]
    return ranked.groupBy(*group_by).agg(F.max("total").alias("n"), *aggs)


def relative_error(mantissa_bits: int) -> float:
    """How far, as a share of the exact percentile, a bound of ``sketch_percentiles`` is off at most."""
    return 2.0**-mantissa_bits


def usable_runs(runs: DataFrame) -> DataFrame:
    """Each run_id once, with a usable duration: retrieval_mode, completion_status, day, duration_ms.

    A duration is usable if it is not null, not negative and below 2147483647.
    Of a run delivered several times the copy logged first counts. Rows without
    run_id cannot be told apart and are left out.
    """
    fields = ["retrieval_mode", "completion_status", "duration_ms", "created_at"]
    ok = runs.filter("run_id IS NOT NULL AND duration_ms >= 0 AND duration_ms < 2147483647")
    first = ok.groupBy("run_id").agg(F.min(F.struct("logged_at", *fields)).alias("r"))
    return first.select("r.retrieval_mode", "r.completion_status", F.to_date("r.created_at").alias("day"), F.col("r.duration_ms").cast(T.IntegerType()).alias("duration_ms"))
