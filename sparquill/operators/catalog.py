"""Scopes, projects, versions and retention as table transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_refs(refs: DataFrame, projects: DataFrame, exact: bool = False) -> DataFrame:
    """(ref, project_id, knowledge_scope_id, n, outcome) of refs (ref).

    A reference matches by project id, scope id, alias (any case), repo path, or
    part of the repo path (any case); with ``exact`` the last is left out.
    outcome is resolved, ambiguous (n > 1) or missing. Projects are a small table.
    """
    ref = F.col("ref")
    low = F.lower(ref)
    hit = (F.col("project_id").cast("string") == ref) | (F.col("knowledge_scope_id").cast("string") == ref) | (F.lower("alias") == low) | (F.col("repo_path") == ref)
    if not exact:
        hit = hit | (F.instr(F.lower("repo_path"), low) > 0)
    side = projects.select("project_id", "knowledge_scope_id", "alias", "repo_path")
    found = refs.filter("ref IS NOT NULL AND ref <> ''").distinct().join(side, hit, "left").select("ref", "project_id", "knowledge_scope_id")
    n = F.count("project_id").over(Window.partitionBy("ref"))
    return found.withColumn("n", n).withColumn("outcome", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous"))


def scope_names(projects: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope_id, scope_type, name, project_id): a public scope stands for itself, before a project of the same scope."""
    own = projects.select(F.col("knowledge_scope_id").alias("scope_id"), "project_id", F.col("name").alias("project_name"))
    both = scopes.join(own, "scope_id", "left")
    return both.select("scope_id", "scope_type", F.when(F.col("scope_type") == "public", F.col("name")).otherwise(F.coalesce("project_name", "name")).alias("name"), "project_id")


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("knowledge_scope_id").agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_version"))


def publish(versions: DataFrame, drafts: DataFrame, now, mode: str = "scope", sources: DataFrame | None = None) -> DataFrame:
    """Versions after publishing ``drafts`` (version_id): they are published, older published ones are superseded.

    mode 'scope' supersedes every published version of the scope; 'source' only
    those that hold the same source, given ``sources`` (version_id, source_id).
    """
    new = versions.join(drafts.select("version_id").distinct(), "version_id", "left_semi")
    if mode == "source":
        if sources is None:
            raise ValueError("mode 'source' needs the sources of the versions")
        held = sources.select("version_id", "source_id").distinct()
        same = held.join(new.select("version_id"), "version_id", "left_semi").select("source_id").distinct()
        old = held.join(same, "source_id", "left_semi").select("version_id").distinct().withColumn("__old", F.lit(True))
        marked = versions.join(old, "version_id", "left")
    else:
        marked = versions.join(new.select("knowledge_scope_id").distinct().withColumn("__old", F.lit(True)), "knowledge_scope_id", "left")
    marked = marked.join(new.select("version_id").withColumn("__new", F.lit(True)), "version_id", "left")
    status = F.when(F.col("__new"), "published").when(F.col("__old") & (F.col("status") == "published"), "superseded").otherwise(F.col("status"))
    out = marked.withColumn("status", status).withColumn("published_at", F.when(F.col("__new"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("published_at")))
    return out.select(*versions.columns)


def published_only(rows: DataFrame, versions: DataFrame) -> DataFrame:
    return rows.join(versions.filter("status = 'published'").select("version_id").distinct(), "version_id", "left_semi")


def purge(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``; a null key stays."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def newest_version(versions: DataFrame, capability: str) -> DataFrame:
    """The newest published version of each scope that has a capability; graph_ready needs dense_ready and lexical_ready too."""
    ready = F.col(f"capabilities.{capability}")
    if capability == "graph_ready":
        ready = ready & F.col("capabilities.dense_ready") & F.col("capabilities.lexical_ready")
    w = Window.partitionBy("knowledge_scope_id").orderBy(F.col("version_number").desc(), "version_id")
    return versions.filter((F.col("status") == "published") & ready).withColumn("n", F.row_number().over(w)).filter("n = 1").select("knowledge_scope_id", "version_id", "version_number")


def split_expired(runs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): a row expires strictly before ``now``; one without expiry stays."""
    gone = F.coalesce(F.col("expires_at") < F.lit(now).cast("timestamp_ntz"), F.lit(False))
    return runs.filter(~gone), runs.filter(gone)


def purge_audit(expired: DataFrame, now, ttl_days: int = 30) -> DataFrame:
    """The maintenance row of one purge: counts, and when the row itself expires."""
    at = F.lit(now).cast("timestamp_ntz")
    return expired.agg(F.count("*").alias("purged_runs"), F.count_if(F.col("provider_usage").isNotNull()).alias("purged_usage")).select("*", at.alias("purged_at"), (at + F.make_dt_interval(F.lit(ttl_days))).alias("expires_at"))


def purge_totals(audit: DataFrame, start, end) -> DataFrame:
    """One row over the maintenance rows of purges in [start, end) that have not expired by then themselves: purges and what they removed."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    kept = split_expired(audit, end)[0].filter((F.col("purged_at") >= at(start)) & (F.col("purged_at") < at(end)))
    return kept.agg(F.count("*").alias("purges"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("purged_runs", "purged_usage")))


def newest_first(rows: DataFrame, group: str, key: str, at: str = "created_at", limit: int = 20) -> DataFrame:
    """The first ``limit`` rows of each group as a list shows them: newest first, ties by the key; adds place."""
    w = Window.partitionBy(group).orderBy(F.col(at).desc_nulls_last(), key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of the same key; of several new rows of a key one is taken."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def runs_that_must_fail(sources: DataFrame, parsed: DataFrame, edges: DataFrame, graph_asked: DataFrame) -> DataFrame:
    """(source_id, reason) of ingest runs that may not publish: 'empty' without any piece, 'no_edges' if graph search was asked for and no hard edge is there.

    parsed: a row per piece (source_id); edges: (source_id, is_hard); graph_asked: (source_id).
    """
    empty = sources.select("source_id").distinct().join(parsed.select("source_id").distinct(), "source_id", "left_anti").withColumn("reason", F.lit("empty"))
    bare = graph_asked.select("source_id").distinct().join(edges.filter("is_hard").select("source_id").distinct(), "source_id", "left_anti").withColumn("reason", F.lit("no_edges"))
    return empty.unionByName(bare.join(empty.select("source_id"), "source_id", "left_anti"))


def free_ids(spark, taken: DataFrame, column: str, size: int = 1024, limit: int = 2) -> DataFrame:
    """The lowest ids below ``size`` that no row holds."""
    held = taken.select(F.col(column).cast("bigint").alias("id"))
    return spark.range(size).join(held, "id", "left_anti").orderBy("id").limit(limit)


def latest_sources(sources: DataFrame) -> DataFrame:
    """Each source once, as last updated, with its hash in lower case."""
    w = Window.partitionBy("source_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.lower("content_hash"), "filename", "status")
    return sources.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumn("content_hash", F.lower("content_hash"))


def repeated_uploads(sources: DataFrame) -> DataFrame:
    """(content_hash, copies, first_source_id) of contents that several sources hold."""
    return latest_sources(sources).filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("source_id").alias("first_source_id")).filter("copies > 1")


def _streamed_hashes(rows: DataFrame, key: str, text: str, joiner: str = "\n\n") -> DataFrame:
    """(key, n, sha) of rows that lie sorted by key: SHA-256 of a key's texts in order, held as a digest and never as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, digest, out = None, 0, None, []
        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                if digest is None or k != now:
                    if digest is not None:
                        out.append((now, n, digest.hexdigest()))
                    now, n, digest = k, 0, hashlib.sha256()
                digest.update(((joiner if n else "") + (t or "")).encode())
                n += 1
            yield pd.DataFrame(out, columns=[key, "n", "sha"])
            out = []
        if digest is not None:
            yield pd.DataFrame([(now, n, digest.hexdigest())], columns=[key, "n", "sha"])

    return rows.mapInPandas(run, f"{key} bigint, n int, sha string")


def source_integrity(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, chunks, hash_matches): whether content_hash is the SHA-256 of the chunk texts in order, joined by a blank line."""
    rows = chunks.filter("source_id IS NOT NULL").select("source_id", "chunk_id", "content_text").dropDuplicates(["source_id", "chunk_id"])
    hashed = _streamed_hashes(rows.repartition("source_id").sortWithinPartitions("source_id", "chunk_id"), "source_id", "content_text")
    held = latest_sources(sources).join(hashed, "source_id", "left")
    return held.select("source_id", F.coalesce("n", F.lit(0)).alias("chunks"), (F.col("sha") == F.col("content_hash")).alias("hash_matches"))


def unique_names(new: DataFrame, scopes: DataFrame) -> DataFrame:
    """New public scopes (name) whose name no active public scope has."""
    taken = scopes.filter("scope_type = 'public' AND status = 'active'").select("name")
    return new.dropDuplicates(["name"]).join(taken, "name", "left_anti")


def violations(runs: DataFrame) -> DataFrame:
    """How many rows break each rule of the run log."""
    rules = {
        "known_status": F.col("completion_status").isin("complete", "partial", "no_evidence", "failed"),
        "known_mode": F.col("retrieval_mode").isin("dense", "hybrid", "graph_enhanced", "agentic"),
        "no_evidence_is_empty": (F.col("completion_status") != "no_evidence") | (F.col("evidence_count") == 0),
        "hybrid_has_timings": ~F.col("retrieval_mode").isin("hybrid", "graph_enhanced") | F.col("subpath_timings").isNotNull(),
        "count_is_refs": F.col("evidence_count") == F.size("evidence_ref_ids"),
        "expires_later": F.col("expires_at") > F.col("created_at"),
    }
    row = runs.agg(*(F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()))
    return row.select(F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in rules)), F.array(*rules))).alias("rule", "rows"))


def schema_differences(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What keeps a table from being read as expected (name to type): missing columns and other types."""
    held = dict(df.dtypes)
    return [f"{c}: {held.get(c, 'missing')}, not {t}" for c, t in expected.items() if held.get(c) != t]
