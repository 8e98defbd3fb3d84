"""Deterministic parts of multi-step retrieval, on rows: sub-problems, status, gaps, evidence views, parents, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as txt
from sparquill.scratch import Scratch

# fixed values: signals a sub-problem may name, and directions a graph signal may
SIGNALS = ("dense", "sparse", "graph")
DIRECTIONS = ("calls", "called_by", "fk_references", "fk_referenced_by")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def harden_sub_problems(plans: DataFrame, queries: DataFrame) -> DataFrame:
    """Sub-problems (qid, ord, query, signals, directions, hop) made safe, with the original query always among them.

    Unknown signals go, none left means dense. One unknown direction gives the
    sub-problem all of them, and so do none with a graph signal. A hop outside
    1..3 is 2. A sub-problem without text, or with that of the original query,
    is left out. Of two and more the original query goes ahead as number 1, with
    dense and sparse signals; a single one asks the original query itself; with
    none the original query is asked by dense search.
    """
    strings = lambda col: F.coalesce(F.col(col), F.array().cast("array<string>"))
    names = lambda values: F.array(*(F.lit(v) for v in values))
    known = F.array_intersect(strings("signals"), names(SIGNALS))
    text = queries.select("qid", F.col("query").alias("whole"))
    kept = plans.join(text, "qid").filter(F.trim(F.coalesce("query", F.lit(""))) != "").filter("query <> whole")
    kept = kept.withColumn("signals", F.when(F.size(known) == 0, names(("dense",))).otherwise(known))
    given = F.when((F.size(strings("directions")) == 0) & F.array_contains("signals", "graph"), names(DIRECTIONS)).otherwise(strings("directions"))
    sound = F.size(F.array_except(strings("directions"), names(DIRECTIONS))) == 0
    hop = F.when(F.col("hop").between(1, 3), F.col("hop")).otherwise(2)
    kept = kept.select("qid", "ord", "query", "signals", F.when(sound, given).otherwise(names(DIRECTIONS)).alias("directions"), hop.alias("hop"), "whole")
    kept = kept.withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    counts = queries.join(kept.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")
    alone = F.col("n") == 0
    anchor = counts.select(
        "qid", F.lit(-1).alias("ord"), "query", F.when(alone, names(("dense",))).otherwise(names(("dense", "sparse"))).alias("signals"),
        F.when(alone, names(DIRECTIONS)).otherwise(F.array().cast("array<string>")).alias("directions"), F.lit(2).alias("hop"),
    )
    kept = kept.select("qid", "ord", F.when(F.col("n") == 1, F.col("whole")).otherwise(F.col("query")).alias("query"), "signals", "directions", "hop")
    w = Window.partitionBy("qid").orderBy("ord", "query")
    return anchor.unionByName(kept).withColumn("sub_problem_id", F.row_number().over(w)).drop("ord")


def bounded_rounds(problems: DataFrame, search, enough: int = 10, rounds: int = 3) -> DataFrame:
    """(qid, doc, round): what sub-problems (qid, sub_problem_id, query) find, one a round, in the order of their number.

    ``search(asked)`` takes (qid, query) and gives (qid, doc, ..). A query goes on
    while it has sub-problems left and fewer than ``enough`` documents; each
    document is of the round that found it first. The number of rounds is a
    bound, so the loop ends whatever a search brings.
    """
    scratch = Scratch(problems.sparkSession)
    found: DataFrame | None = None
    for n in range(rounds):
        asked = problems.filter(F.col("sub_problem_id") == n + 1).select("qid", "query")
        if found is not None:
            done = found.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
            asked = asked.join(done, "qid", "left_anti")
        asked = scratch.keep(asked)
        if found is not None and asked.isEmpty():
            break
        new = search(asked).select("qid", "doc", F.lit(n).alias("round"))
        found = scratch.keep(new if found is None else found.unionByName(new.join(found.select("qid", "doc"), ["qid", "doc"], "left_anti")))
    return found


def completion_status(found: Column, asked: Column, failed: Column) -> Column:
    """failed, no_evidence, partial (fewer than asked for) or complete."""
    return F.when(failed, "failed").when(found == 0, "no_evidence").when(found < asked, "partial").otherwise("complete")


def gaps(found: Column, asked: Column, failed_paths: Column) -> Column:
    """Array of (kind, detail) that says what is missing from a result."""
    item = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    short = F.when(found == 0, item("no_evidence", F.lit(""))).when(found < asked, item("too_few", F.concat_ws("/", found.cast("string"), asked.cast("string"))))
    paths = F.transform(F.coalesce(failed_paths, F.array().cast("array<string>")), lambda p: item("failed_path", p))
    return F.concat(F.array_compact(F.array(short)), paths)


def evidence_view(evidence: DataFrame, head: int = 8, size: int = 400, key: str = "qid") -> DataFrame:
    """The first ``head`` rows of each query as a model may see them: text cut to ``size`` characters, withheld at a high injection risk."""
    w = Window.partitionBy(key).orderBy("rank", "doc")
    rows = evidence.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= head).withColumn("signs", txt.injection_signs(F.col("content_text")))
    shown = F.when(F.col("signs.risk") == "high", F.lit("[withheld]")).otherwise(txt.excerpt(F.col("content_text"), size))
    return rows.select(key, "doc", "place", shown.alias("shown"), (F.length("content_text") > size).alias("truncated"), (F.col("signs.risk") == "high").alias("quarantined"))


def supplement_parents(chosen: DataFrame, chunks: DataFrame, capacity: int, key: str = "qid") -> DataFrame:
    """Chosen rows (qid, doc, rank) and, in the room they leave up to ``capacity``, their parents that are not chosen yet."""
    parents = chunks.select(F.col("chunk_id").alias("doc"), F.col("parent_chunk_id").alias("parent")).filter("parent IS NOT NULL").dropDuplicates(["doc"])
    there = chunks.select(F.col("chunk_id").alias("parent")).distinct()
    wanted = chosen.join(parents, "doc").join(there, "parent").groupBy(key, F.col("parent").alias("doc")).agg(F.min("rank").alias("of_rank"))
    wanted = wanted.join(chosen.select(key, "doc"), [key, "doc"], "left_anti")
    used = chosen.groupBy(key).agg(F.count("*").alias("used"), F.max("rank").alias("last"))
    w = Window.partitionBy(key).orderBy("of_rank", "doc")
    added = wanted.withColumn("n", F.row_number().over(w)).join(used, key).filter(F.col("used") + F.col("n") <= capacity)
    return chosen.select(key, "doc", "rank", F.lit(False).alias("supplement")).unionByName(added.select(key, "doc", (F.col("last") + F.col("n")).alias("rank"), F.lit(True).alias("supplement")))


def look_up_evidence(refs: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """refs (evidence_id, scope) with status: available, scope_mismatch or unavailable (no such chunk, or its version is not published)."""
    live = versions.filter("status = 'published'").select("version_id", F.lit(True).alias("live")).distinct()
    own = chunks.select(F.col("chunk_id").cast("string").alias("evidence_id"), "knowledge_scope_id", "version_id", "position_path").dropDuplicates(["evidence_id"])
    found = refs.join(own, "evidence_id", "left").join(live, "version_id", "left")
    status = F.when(F.col("knowledge_scope_id").isNull() | F.col("live").isNull(), "unavailable").when(F.col("knowledge_scope_id") != F.col("scope"), "scope_mismatch").otherwise("available")
    return found.select("evidence_id", "scope", status.alias("status"), F.when(status == "available", F.col("position_path")).alias("position_path"))


def ledger(candidates: DataFrame, key: str = "qid") -> DataFrame:
    """Append-only rows of candidates (qid, round, sub_problem_id, doc, score, retrievers, reranked): round from 0 without gaps, score within 0 and 1, one retriever name."""
    from sparquill.operators.fusion import retriever_label

    rounds = F.dense_rank().over(Window.partitionBy(key).orderBy("round")) - 1
    return candidates.select(
        key, rounds.alias("round_index"), "sub_problem_id", F.col("doc").cast("string").alias("evidence_id"), retriever_label(F.col("retrievers"), F.col("reranked")).alias("retriever"), F.round(txt.clamp01(F.col("score")), 4).alias("score"),
    )


def entries_of(ledger: DataFrame, wanted: DataFrame, key: str = "qid") -> DataFrame:
    """The ledger's entries of each wanted (request, evidence_id), the pair that results carry outside."""
    return ledger.join(wanted.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_semi")


def llm_cost(calls: DataFrame, price_per_million: float, prompt: str = "prompt_chars", completion: str = "completion_chars", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., calls, chars, tokens, cost): three characters are taken for a token, cost has six decimals."""
    total = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))), F.lit(0)).cast("bigint").alias("chars"))
    tokens = F.col("chars") / 3.0
    return total.select(*by, "calls", "chars", F.round(tokens, 2).alias("tokens"), F.round(tokens / 1e6 * price_per_million, 6).alias("cost"))


def valid_selections(rows: DataFrame) -> DataFrame:
    """Selections whose ledger id is a number and whose decision is known."""
    return rows.filter(F.col("ledger_id").rlike("^[0-9]+$") & F.col("decision").isin("selected", "truncated", "deduped"))


def generated_queries(chunks: DataFrame) -> DataFrame:
    """(chunk_id, query, expected_evidence_id): a question per chunk on the last part of its path, by a template the id picks."""
    topic = F.trim(F.regexp_replace(F.element_at(F.split("position_path", " > "), -1), "^#+ *", ""))
    english = F.array(*(F.lit(x) for x in ("How does %s work?", "What is %s?", "Where is %s described?")))
    chinese = F.array(*(F.lit(x) for x in ("%s 是什么？", "如何使用 %s？", "%s 在哪里说明？")))
    pick = lambda a: F.element_at(a, (F.pmod(F.col("chunk_id"), F.lit(3)) + 1).cast("int"))
    template = F.when(topic.rlike("[一-鿿]"), pick(chinese)).otherwise(pick(english))
    rows = chunks.filter("position_path <> ''").select("chunk_id", F.regexp_replace(template, "%s", F.regexp_replace(topic, r"([\\$])", r"\\$1")).alias("query"))
    return rows.withColumn("expected_evidence_id", F.col("chunk_id").cast("string"))

