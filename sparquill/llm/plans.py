"""Queries of the training-data operators on the tables of TESTDATA.md, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import markup, mixing, near_duplicates, packing, percentiles, splitting, stuffing, tokens
from sparquill.scratch import Scratch, bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1. percentiles

_BY = ["retrieval_mode", "completion_status"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = percentiles.usable_runs(_table(spark, sf_dir, "retrieval_runs"))
    found = percentiles.radix_percentiles(runs, _BY, "duration_ms", (0.5, 0.95))
    return found.filter(F.col("p95") >= 10 * F.col("p50")).select(*_BY)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.radix_percentiles(percentiles.usable_runs(_table(spark, sf_dir, "retrieval_runs")), _BY, "duration_ms")


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.radix_percentiles(percentiles.usable_runs(_table(spark, sf_dir, "retrieval_runs")), ["day", *_BY], "duration_ms")


def p1_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = percentiles.sketch(percentiles.usable_runs(_table(spark, sf_dir, "retrieval_runs")), ["day", *_BY], "duration_ms")
    merged = percentiles.sketch_percentiles(percentiles.merge_sketches(days, _BY), _BY)
    return merged.select(*_BY, "n", "p50_low", "p95_low", "p99_low")


_RUNS = """
WITH u AS (
  SELECT run_id, r.* FROM (
    SELECT run_id, arg_min({'retrieval_mode': retrieval_mode, 'completion_status': completion_status, 'duration_ms': duration_ms, 'day': CAST(created_at AS DATE)}, logged_at) AS r
    FROM retrieval_runs WHERE run_id IS NOT NULL AND duration_ms >= 0 AND duration_ms < 2147483647 GROUP BY run_id)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM u
), q AS (
  SELECT {by}, max(n) AS n, {cols} FROM k GROUP BY ALL
)
"""
_AT = "CAST(max(duration_ms) FILTER (rn = greatest(1, ceil(n * CAST({p} AS DOUBLE) - 1e-9))) AS BIGINT) AS {name}"


def _runs_sql(by: str) -> str:
    cols = ", ".join(_AT.replace("{p}", str(p)).replace("{name}", name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    return _RUNS.replace("{by}", by).replace("{cols}", cols)


def _floored(col: str) -> str:
    """The least value of the bucket of 7 mantissa bits that holds a whole number."""
    width = f"pow(2, floor(log2({col})) - 7)"
    return f"CASE WHEN {col} = 0 THEN 0.0::DOUBLE ELSE floor({col} / {width}) * {width} END"


# 2. near-duplicates

#: As TESTDATA.md has it for p2_found.
_SIMILAR = near_duplicates.Forest(shingle_words=3, threshold=0.5, min_words=20)
#: One row for every chunk that has a text.
_EVERY = near_duplicates.Forest(keep_short=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates.near_duplicates(_table(spark, sf_dir, "chunks"), "chunk_id", "content_text", _SIMILAR)
    pairs = near_duplicates.similar_pairs(links, members)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates.near_duplicates(_table(spark, sf_dir, "chunks"), "chunk_id", "content_text", _EVERY)
    return near_duplicates.link_counts(links, members).withColumnRenamed("id", "chunk_id")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates.near_duplicates(_table(spark, sf_dir, "chunks"), "chunk_id", "content_text", _EVERY)
    return near_duplicates.duplicate_groups(links, members).withColumnRenamed("id", "chunk_id")


def _pairs_sql(words: int, threshold: float, least: int) -> str:
    run = ", ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH t AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content_text), '[a-z0-9_]+|[一-鿿]') AS w FROM chunks),
s AS (SELECT DISTINCT chunk_id, [{run}] AS s FROM (SELECT chunk_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM t WHERE len(w) >= {least})),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.chunk_id AS chunk_id_a, y.chunk_id AS chunk_id_b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.chunk_id < y.chunk_id GROUP BY 1, 2)
SELECT chunk_id_a, chunk_id_b FROM c JOIN n a ON a.chunk_id = chunk_id_a JOIN n b ON b.chunk_id = chunk_id_b WHERE c / (a.n + b.n - c) >= {threshold}"""


_MEMBERS_SQL = """
WITH RECURSIVE t AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content_text), '[a-z0-9_]+|[一-鿿]') AS w, content_text FROM chunks WHERE chunk_id IS NOT NULL AND content_text IS NOT NULL),
m AS (SELECT DISTINCT chunk_id, CASE WHEN len(w) = 0 THEN chr(1) || content_text ELSE array_to_string(w, ' ') END AS class, CASE WHEN len(w) >= 5 THEN w END AS w FROM t),
k AS (SELECT class, min(chunk_id) AS class_id, any_value(w) AS w, count(*) AS copies FROM m GROUP BY 1),
s AS (SELECT DISTINCT class_id, [w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]] AS s FROM (SELECT class_id, w, unnest(range(1, len(w) - 3)) AS i FROM k WHERE w IS NOT NULL)),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.class_id <> y.class_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.class_id = a JOIN n q ON q.class_id = b WHERE c / (p.n + q.n - c) >= 0.8)
"""


# 3. oversized texts


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(_table(spark, sf_dir, "chunks"), "chunk_id", "content_text").filter("boundary IS NOT NULL")
    levels = F.array(*map(F.lit, splitting.LEVELS))  # from the coarsest
    return pieces.groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.array_position(levels, F.col("boundary")).cast("int")).alias("k")).select("chunk_id", levels[F.col("k") - 1].alias("boundary"))


def _once(chunks: DataFrame) -> DataFrame:
    """Each row once; only rows whose id occurs again are compared by their text, the others do not move where those ids are few."""
    again = bounded(Scratch(chunks.sparkSession).keep(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id")))
    return chunks.join(again, "chunk_id", "left_anti").unionByName(chunks.join(again, "chunk_id", "left_semi").distinct())


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _once(_table(spark, sf_dir, "chunks").select("chunk_id", "position_path", "content_text"))
    pieces = splitting.split_oversized(chunks, "chunk_id", "content_text", keep=["position_path"])
    return pieces.withColumnRenamed("id", "chunk_id")


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text: what its pieces give when their bodies are joined, the longest piece, and whether all overlaps are as stated."""
    p = p3_pieces(spark, sf_dir).withColumn("overlap", F.when(F.col("piece_no") == 0, 0).otherwise(200))
    body = F.struct("piece_no", F.expr("substring(text, overlap + 1)").alias("body"), F.col("start").alias("at"), F.length("text").alias("n"), F.expr("left(text, overlap)").alias("head"), F.expr("right(text, 200)").alias("tail"))
    whole = p.groupBy("chunk_id", "position_path").agg(F.sort_array(F.collect_list(body)).alias("b"), F.max(F.length("text")).alias("longest"))
    pairs = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b")), lambda x, y: (x["tail"] == y["head"]) & (x["at"] + x["n"] - 200 == y["at"]))
    return whole.select("chunk_id", "position_path", F.md5(F.array_join("b.body", "")).alias("md5"), (F.col("longest") <= 4096).alias("within"), F.forall(pairs, lambda x: x).alias("overlapping"))


_UNITS = {
    "paragraph": "string_split_regex(content_text, '(\\r\\n|\\r|\\n)([^\\S\\r\\n]*(\\r\\n|\\r|\\n))+')",
    "line": "string_split_regex(content_text, '\\r\\n|\\r|\\n')",
    "sentence": "string_split_regex(regexp_replace(regexp_replace(content_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g'), chr(1) || '|\\r\\n|\\r|\\n')",
    "word": "string_split_regex(content_text, '\\s+')",
}

# 4. markup


def _text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of markdown, word and pdf sources, a source having the format of its latest row."""
    sources = _table(spark, sf_dir, "knowledge_sources").groupBy("source_id").agg(F.max_by("format", "updated_at").alias("format"))
    sources = sources.filter(F.col("format").isin("markdown", "word", "pdf")).select("source_id")
    sources = bounded(Scratch(spark).keep(sources))
    chunks = _table(spark, sf_dir, "chunks").select("chunk_id", "source_id", "position_path", "content_text")
    return chunks.join(sources, "source_id", "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_kinds(_text_chunks(spark, sf_dir), "chunk_id", "content_text", "source_id").withColumnRenamed("id", "chunk_id")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(_text_chunks(spark, sf_dir), "chunk_id", "content_text", keep=["position_path"], host_col="source_id").withColumnRenamed("id", "chunk_id")


def p4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.host_wrappers(_text_chunks(spark, sf_dir), "chunk_id", "content_text", "source_id")
    return found.select(F.col("host").cast("bigint").alias("source_id"), "wrapper", F.col("rows").alias("chunks"))


# 6. packing, 7. mixing


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"])


_CAPACITY = 2048


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return packing.pack(tokens.with_token_pieces(documents, "doc_id", "text", _CAPACITY), _CAPACITY, total_rows=documents.count())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).filter("n_pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.contexts(Scratch(spark).keep(_packed(spark, sf_dir)), _table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what must hold of the filled contexts: whole texts in them, none overfull, only larger ones cut, hardly any room left."""
    packed = Scratch(spark).keep(_packed(spark, sf_dir))
    texts = packing.contexts(packed, _table(spark, sf_dir, "documents"), "doc_id", "text").select(F.explode("items").alias("i"), "n_tokens")
    held = texts.agg(F.countDistinct("i.id").alias("documents"), F.sum(F.length("i.text")).alias("chars"), F.count_if(F.col("n_tokens") > _CAPACITY).alias("overfull"))
    sizes = packed.groupBy("id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("n_pieces").alias("of"))
    cut = sizes.agg(F.count_if(((F.col("n") <= _CAPACITY) & (F.col("pieces") > 1)) | (F.col("pieces") != F.col("of"))).alias("wrongly_cut"))
    # first-fit decreasing leaves at most one bin per group filled by less than a half; the rest shows in the share
    fill = packing.fill_report(packed).select((F.col("bins") <= F.ceil(F.col("least_bins") * 1.02) + 1).alias("well_filled"))
    return held.crossJoin(cut).crossJoin(fill)  # one row each


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_document_tokens(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].filter("NOT reachable").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per target: whether its draw is right as far as that can be told without the draw's own steps.

    Drawn and reported tokens agree, no document is used more than allowed, and
    the draw misses its budget by less than a document, or else uses every
    document as often as allowed; all that was drawn is from the source.
    """
    sized = Scratch(spark).keep(_document_tokens(spark, sf_dir))
    targets = _table(spark, sf_dir, "mix_targets")
    drawn, report = mixing.mix(sized, targets)
    own = sized.select("id", F.col("n_tokens").alias("n"), mixing.normal_source().alias("s"))
    held = own.groupBy("s").agg(F.sum("n").alias("held"), F.max("n").alias("largest"))
    total = sized.agg(F.sum("n_tokens").alias("total"))
    got = drawn.join(own, "id").groupBy("source").agg(
        F.sum(F.col("n") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"), F.bool_and(F.col("s") == mixing.normal_source()).alias("own"),
    )
    rows = targets.withColumn("s", mixing.normal_source()).join(got, "source", "left").join(held, "s", "left").crossJoin(total).join(report.select("source", "drawn_tokens"), "source")  # total is one row
    budget, tokens_ = F.col("target_share") * F.col("total"), F.coalesce("tokens", F.lit(0))
    reached = F.when(F.coalesce("held", F.lit(0)) * F.col("max_repeats") >= budget, F.abs(tokens_ - budget) <= F.col("largest")).otherwise(tokens_ == F.coalesce("held", F.lit(0)) * F.col("max_repeats"))
    return rows.select("source", reached.alias("reached"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("own", F.lit(True)).alias("own_documents"), (tokens_ == F.col("drawn_tokens")).alias("as_reported"))


# 8. stuffed pages


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"))


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffing_evidence(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_percentiles": p1_percentiles, "p1_daily": p1_daily, "p1_merged_days": p1_merged_days,
    "p2_found": p2_found, "p2_links": p2_links, "p2_groups": p2_groups,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined,
    "p4_found": p4_found, "p4_clean": p4_clean, "p4_wrappers": p4_wrappers,
    "p6_found": p6_found, "p6_packing": p6_packing, "p6_fill": p6_fill, "p6_contexts": p6_contexts, "p6_invariants": p6_invariants,
    "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks,
    "p8_found": p8_found, "p8_evidence": p8_evidence,
}

_MODE = "retrieval_mode, completion_status"
SQL = {
    "p1_found": _runs_sql(_MODE) + f"SELECT {_MODE} FROM q WHERE p95 >= 10 * p50",
    "p1_percentiles": _runs_sql(_MODE) + "SELECT * FROM q",
    "p1_daily": _runs_sql(f"day, {_MODE}") + "SELECT * FROM q",
    "p1_merged_days": _runs_sql(_MODE) + f"SELECT {_MODE}, n, {_floored('p50')} AS p50_low, {_floored('p95')} AS p95_low, {_floored('p99')} AS p99_low FROM q",
    "p2_found": _pairs_sql(3, 0.5, 20),
    "p2_links": _MEMBERS_SQL + "SELECT chunk_id, class_id, copies, coalesce(d, 0) AS n_links FROM m JOIN k USING (class) LEFT JOIN (SELECT a AS class_id, count(*) AS d FROM e GROUP BY 1) USING (class_id)",
    "p2_groups": _MEMBERS_SQL + """, r AS (SELECT class_id AS x, class_id AS g FROM k UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.x), g AS (SELECT x AS class_id, min(g) AS group_id FROM r GROUP BY 1)
SELECT chunk_id, class_id, group_id FROM m JOIN k USING (class) JOIN g USING (class_id)""",
    "p7_checks": "SELECT source, true AS reached, true AS within_repeats, true AS own_documents, true AS as_reported FROM mix_targets",
    "p6_invariants": "SELECT count(*) AS documents, sum(length(text)) AS chars, 0::BIGINT AS overfull, 0::BIGINT AS wrongly_cut, true AS well_filled FROM documents WHERE text <> ''",
    "p3_found": "WITH d AS (SELECT DISTINCT chunk_id, content_text FROM chunks WHERE length(content_text) > 4096)\nSELECT chunk_id, ['paragraph', 'line', 'sentence', 'word', 'none'][min(CASE "
    + " ".join(f"WHEN list_max(list_transform({units}, lambda x: length(x))) <= 4096 THEN {k}" for k, units in enumerate(_UNITS.values(), 1))
    + " ELSE 5 END)] AS boundary FROM d GROUP BY 1",
    "p3_rejoined": "SELECT DISTINCT chunk_id, position_path, md5(content_text) AS md5, true AS within, true AS overlapping FROM chunks WHERE content_text <> ''",
}
