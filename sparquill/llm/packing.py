"""Filling contexts of a fixed number of tokens: first-fit decreasing over a tournament tree of free room."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item: the first bin with room for it, in the order of falling sizes, ties in the given order.

    The tree's leaves are bins, an inner node holds the most room below it, so
    the first bin with room is found in as many steps as the tree is deep.
    """
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist()
    leaves = 1
    while leaves < len(order):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    where = [0] * len(order)
    for item in order:
        size, node = sizes[item], 1
        if size > capacity:
            raise ValueError("an item exceeds the capacity")
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        where[item] = node - leaves
        node //= 2
        while node:
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a > b else b
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return where


def pieces_of_sizes(sized: DataFrame, id_col: str = "id", size_col: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """(id, pieces) as ``tokens.with_token_pieces`` has them, from sizes only: full pieces and a rest, without places in the text.

    Items of null or no size have no pieces; a negative size counts as none.
    """
    n = F.col("n")
    items = sized.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("n")).filter("n > 0")
    piece = lambda k: F.struct(
        (k * capacity).cast("int").alias("token_start"), F.least((k + 1) * capacity, n).cast("int").alias("token_end"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
    )
    return items.select("id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(capacity))), piece).alias("pieces"))


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 20_000, total_rows: int | None = None) -> DataFrame:
    """One row per packed piece of rows (id, pieces): id, piece_no from 0, n_pieces, n_tokens, token_start, char_start, char_end, bin_id.

    Pieces are packed in groups of about ``group_rows`` rows, drawn by a hash of
    the id, so a group fits a task whatever the table's size; only an item above
    the capacity has several. No bin holds more than ``capacity``. Items without
    pieces have no row. Repeated rows are packed each for itself, and rows with
    a null id are packed like others. An empty table gives an empty result.
    """
    each = pieces.select("id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "p"))
    each = each.select("id", "piece_no", "n_pieces", (F.col("p.token_end") - F.col("p.token_start")).alias("n_tokens"), "p.token_start", "p.char_start", "p.char_end")
    if total_rows is None:
        total_rows = pieces.count()
    groups = max(1, -(-total_rows // group_rows))
    # the size is hashed with the id, so that rows without id spread too
    grouped = each.withColumn("grp", F.pmod(F.xxhash64("id", "piece_no", "n_tokens"), F.lit(groups)).cast("int"))
    names = ["id", "piece_no", "n_pieces", "n_tokens", "token_start", "char_start", "char_end"]

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("id", "piece_no", "n_tokens")])
        sizes = table["n_tokens"].to_pylist()
        if sizes and max(sizes) > capacity:
            raise ValueError("a piece exceeds the capacity")
        bins = np.asarray(first_fit_decreasing(sizes, capacity), np.int64) + (table["grp"][0].as_py() << 32)
        return table.select(names).append_column("bin_id", pa.array(bins))

    schema = ", ".join(f"{n} {each.schema[n].dataType.simpleString()}" for n in names) + ", bin_id bigint"
    return grouped.groupBy("grp").applyInArrow(fill, schema)


def contexts(packed: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per bin: bin_id, n_tokens, items (array of id, piece_no, text in order of id): the filled containers themselves.

    Ids of ``df`` are unique; rows without id are not in it. Texts are shuffled
    twice, to their id and to their bin; a bin is as small as its capacity.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    piece = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    cut = packed.join(texts, "id").select("bin_id", "n_tokens", F.struct("id", "piece_no", F.when(F.col("n_pieces") == 1, F.col("text")).otherwise(piece).alias("text")).alias("item"))
    return cut.groupBy("bin_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sort_array(F.collect_list("item")).alias("items"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: bins, tokens, least_bins (tokens / capacity, rounded up), fill (share of the room used), unused tokens."""
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("t"))
    total = bins.agg(F.count("*").alias("bins"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return total.select(
        "bins", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_bins"),
        F.try_divide("tokens", F.col("bins") * capacity).alias("fill"), (F.col("bins") * capacity - F.col("tokens")).alias("unused"),
    )
