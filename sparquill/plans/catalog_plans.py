"""Queries on scopes, projects, versions, sources and the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparquill.functions import text as txt
from sparquill.operators import agentic, catalog, runs
from sparquill.session import table

NOW = datetime(2026, 2, 15)
START, END = datetime(2026, 1, 10), datetime(2026, 2, 10)


def _log(spark, sf_dir):
    return runs.delivered_once(table(spark, sf_dir, "retrieval_runs"))


def _window(spark, sf_dir):
    return runs.between(_log(spark, sf_dir), START, END)


def resolve_refs(spark, sf_dir):
    projects = table(spark, sf_dir, "projects")
    names = projects.select(F.col("name").alias("ref")).union(projects.select("alias")).union(projects.select(F.col("project_id").cast("string"))).union(projects.select(F.substring("name", 1, 3))).union(projects.select(F.lit("/srv/repos")))
    return catalog.resolve_refs(names, projects)


def scope_names(spark, sf_dir):
    return catalog.scope_names(table(spark, sf_dir, "projects"), table(spark, sf_dir, "scopes"))


def next_version(spark, sf_dir):
    return catalog.next_version(table(spark, sf_dir, "versions"))


def publish_drafts(spark, sf_dir):
    versions = table(spark, sf_dir, "versions")
    out = catalog.publish(versions, versions.filter("status = 'draft'"), NOW)
    return out.select("version_id", "knowledge_scope_id", "status", "published_at")


def published_chunks(spark, sf_dir):
    kept = catalog.published_only(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "versions"))
    return kept.select("chunk_id", "version_id").distinct()


def purge_superseded(spark, sf_dir):
    gone = table(spark, sf_dir, "versions").filter("status = 'superseded'")
    return catalog.purge(table(spark, sf_dir, "chunks"), gone, "version_id").select("chunk_id").distinct()


def purge_archived_scopes(spark, sf_dir):
    gone = table(spark, sf_dir, "scopes").filter("status <> 'active'").select(F.col("scope_id").alias("knowledge_scope_id"))
    return catalog.purge(table(spark, sf_dir, "chunks"), gone, "knowledge_scope_id").select("chunk_id", "knowledge_scope_id").distinct()


def newest_graph_version(spark, sf_dir):
    return catalog.newest_version(table(spark, sf_dir, "versions"), "graph_ready")


def ttl_purge(spark, sf_dir):
    return catalog.split_expired(_log(spark, sf_dir), NOW)[0].select("run_id", "expires_at")


def ttl_audit(spark, sf_dir):
    return catalog.purge_audit(catalog.split_expired(_log(spark, sf_dir), NOW)[1], NOW)


def free_worker_ids(spark, sf_dir):
    return catalog.free_ids(spark, table(spark, sf_dir, "versions"), "version_number")


def latest_sources(spark, sf_dir):
    return catalog.latest_sources(table(spark, sf_dir, "knowledge_sources"))


def repeated_uploads(spark, sf_dir):
    return catalog.repeated_uploads(table(spark, sf_dir, "knowledge_sources"))


def source_integrity(spark, sf_dir):
    return catalog.source_integrity(table(spark, sf_dir, "knowledge_sources"), table(spark, sf_dir, "chunks"))


def index_versions(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("knowledge_scope_id", "index_version", "embedding_model").distinct()


def run_violations(spark, sf_dir):
    return catalog.violations(_log(spark, sf_dir))


def request_totals(spark, sf_dir):
    return runs.request_totals(_window(spark, sf_dir))


def status_distribution(spark, sf_dir):
    return runs.status_distribution(_window(spark, sf_dir))


def latency_p50_p95(spark, sf_dir):
    return runs.latency(_window(spark, sf_dir))


def subpath_p50(spark, sf_dir):
    return runs.timing_medians(_window(spark, sf_dir))


def provider_usage(spark, sf_dir):
    return runs.usage_totals(_window(spark, sf_dir))


def timing_totals(spark, sf_dir):
    return runs.timing_totals(_log(spark, sf_dir))


def late_arrivals(spark, sf_dir):
    return runs.late_arrivals(table(spark, sf_dir, "retrieval_runs"))


def evidence_usage(spark, sf_dir):
    return runs.evidence_usage(_log(spark, sf_dir), table(spark, sf_dir, "chunks"))


def ledger_rejections(spark, sf_dir):
    """Evidence written under the scope of its run's first evidence: entries of other scopes are rejected."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "knowledge_scope_id").dropDuplicates(["chunk_id"])
    refs = _log(spark, sf_dir).select("run_id", F.posexplode("evidence_ref_ids").alias("pos", "ref")).select("run_id", "pos", F.expr("try_cast(ref AS bigint)").alias("chunk_id"))
    first = refs.filter("pos = 0").join(chunks, "chunk_id").select("run_id", "knowledge_scope_id")
    return runs.scope_check(refs.join(first, "run_id"), chunks)[1].select("run_id", "pos", "chunk_id", "knowledge_scope_id")


def redaction(spark, sf_dir):
    """Texts that redaction changes, with what it leaves."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "content_text").distinct()
    clean = chunks.withColumn("clean", txt.redact(F.col("content_text")))
    return clean.filter("clean <> content_text").select("chunk_id", F.md5("clean").alias("clean_md5"))


def injection_scan(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", txt.injection_signs(F.col("text")).alias("s"))
    return chunks.select("doc_id", F.col("s.risk").alias("risk"), F.array_join("s.matched", ",").alias("matched"))


def text_functions(spark, sf_dir):
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", txt.content_hash(text).alias("hash"), txt.chars_estimate(text).alias("chars_estimate"), txt.excerpt(text).alias("excerpt"), F.size(txt.tokens(text)).alias("tokens"))


def exact_refs(spark, sf_dir):
    """References that must name a project fully: parts of a path do not count."""
    projects = table(spark, sf_dir, "projects")
    names = projects.select(F.col("repo_path").alias("ref")).union(projects.select(F.upper("alias"))).union(projects.select(F.col("knowledge_scope_id").cast("string"))).union(projects.select(F.substring("repo_path", 2, 9)))
    return catalog.resolve_refs(names, projects, exact=True)


def publish_by_source(spark, sf_dir):
    """Drafts are published and supersede only versions that hold one of their sources."""
    versions = table(spark, sf_dir, "versions")
    held = table(spark, sf_dir, "chunks").select("version_id", "source_id").distinct()
    out = catalog.publish(versions, versions.filter("status = 'draft'"), NOW, "source", held)
    return out.select("version_id", "status", "published_at")


def unique_scope_names(spark, sf_dir):
    """Names of projects and scopes that a new public scope may have."""
    scopes = table(spark, sf_dir, "scopes")
    new = table(spark, sf_dir, "projects").select("name").union(scopes.select("name"))
    return catalog.unique_names(new, scopes).select("name")


def schema_check(spark, sf_dir):
    """What differs in two tables from a stated schema, one part of which is wrong on purpose."""
    found = catalog.schema_differences(table(spark, sf_dir, "projects"), {"project_id": "bigint", "alias": "string", "name": "int"})
    found += catalog.schema_differences(table(spark, sf_dir, "scopes"), {"scope_id": "bigint", "owner": "string"})
    return spark.createDataFrame([(x,) for x in found], "difference string")


def clamped_requests(spark, sf_dir):
    """Each run's number of results within what a request may ask for."""
    return _log(spark, sf_dir).select("run_id", agentic.clamp(F.col("evidence_count"), 1, 3).alias("top_k"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_refs, publish_by_source, unique_scope_names, schema_check, clamped_requests,
        resolve_refs, scope_names, next_version, publish_drafts, published_chunks, purge_superseded, purge_archived_scopes, newest_graph_version, ttl_purge, ttl_audit,
        free_worker_ids, latest_sources, repeated_uploads, source_integrity, index_versions, run_violations, request_totals, status_distribution, latency_p50_p95,
        subpath_p50, provider_usage, timing_totals, late_arrivals, evidence_usage, ledger_rejections, redaction, injection_scan, text_functions,
    )
}

_LOG = "WITH r AS (SELECT * FROM retrieval_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at) = 1)"
_WIN = _LOG + f", w AS (SELECT * FROM r WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}')"
_SRC = """WITH s AS (SELECT * REPLACE (lower(content_hash) AS content_hash) FROM knowledge_sources
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, lower(content_hash), filename, status) = 1)"""
_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in runs.TIMING_NAMES.items()) + "}"


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _redacted(col: str) -> str:
    for pattern, name in txt.CREDENTIALS:
        col = f"regexp_replace({col}, '{_re2(pattern)}', '\\1{name}', 'g')"
    return col


def _signs(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{_re2(p)}') THEN '{n}' END" for n, p in rules.items()) + "], lambda x: x IS NOT NULL)"


SQL = {
    "exact_refs": """WITH f AS (SELECT DISTINCT ref FROM (SELECT repo_path AS ref FROM projects UNION ALL SELECT upper(alias) FROM projects UNION ALL SELECT knowledge_scope_id::VARCHAR FROM projects UNION ALL SELECT substr(repo_path, 2, 9) FROM projects) WHERE ref <> ''),
m AS (SELECT ref, project_id, knowledge_scope_id FROM f LEFT JOIN projects p ON p.project_id::VARCHAR = ref OR p.knowledge_scope_id::VARCHAR = ref OR lower(alias) = lower(ref) OR repo_path = ref)
SELECT *, count(project_id) OVER (PARTITION BY ref) AS n, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM m""",
    "publish_by_source": f"""WITH d AS (SELECT version_id FROM versions WHERE status = 'draft'), o AS (SELECT version_id FROM chunks WHERE source_id IN (SELECT source_id FROM chunks WHERE version_id IN (FROM d)))
SELECT version_id, CASE WHEN version_id IN (FROM d) THEN 'published' WHEN status = 'published' AND version_id IN (FROM o) THEN 'superseded' ELSE status END AS status, CASE WHEN version_id IN (FROM d) THEN TIMESTAMP '{NOW}' ELSE published_at END AS published_at FROM versions""",
    "unique_scope_names": "SELECT DISTINCT name FROM (SELECT name FROM projects UNION ALL SELECT name FROM scopes) WHERE name NOT IN (SELECT name FROM scopes WHERE scope_type = 'public' AND status = 'active')",
    "schema_check": "SELECT unnest(['name: string, not int', 'owner: missing, not string']) AS difference",
    "clamped_requests": _LOG + " SELECT run_id, least(3, greatest(1, evidence_count)) AS top_k FROM r",
    "resolve_refs": """WITH f AS (SELECT DISTINCT ref FROM (SELECT name AS ref FROM projects UNION ALL SELECT alias FROM projects UNION ALL SELECT project_id::VARCHAR FROM projects
  UNION ALL SELECT substr(name, 1, 3) FROM projects UNION ALL SELECT '/srv/repos') WHERE ref IS NOT NULL AND ref <> ''),
m AS (SELECT ref, project_id, knowledge_scope_id FROM f LEFT JOIN projects p ON p.project_id::VARCHAR = ref OR p.knowledge_scope_id::VARCHAR = ref OR lower(alias) = lower(ref) OR repo_path = ref OR contains(lower(repo_path), lower(ref)))
SELECT *, count(project_id) OVER (PARTITION BY ref) AS n, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM m""",
    "scope_names": "SELECT scope_id, scope_type, CASE WHEN scope_type = 'public' THEN s.name ELSE coalesce(p.name, s.name) END AS name, project_id FROM scopes s LEFT JOIN projects p ON p.knowledge_scope_id = scope_id",
    "next_version": "SELECT knowledge_scope_id, coalesce(max(version_number), 0) + 1 AS next_version FROM versions GROUP BY 1",
    "publish_drafts": f"""WITH d AS (SELECT * FROM versions WHERE status = 'draft')
SELECT version_id, knowledge_scope_id, CASE WHEN version_id IN (SELECT version_id FROM d) THEN 'published' WHEN status = 'published' AND knowledge_scope_id IN (SELECT knowledge_scope_id FROM d) THEN 'superseded' ELSE status END AS status,
  CASE WHEN version_id IN (SELECT version_id FROM d) THEN TIMESTAMP '{NOW}' ELSE published_at END AS published_at FROM versions""",
    "published_chunks": "SELECT DISTINCT chunk_id, version_id FROM chunks WHERE version_id IN (SELECT version_id FROM versions WHERE status = 'published')",
    "purge_superseded": "SELECT DISTINCT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.version_id = c.version_id AND status = 'superseded')",
    "purge_archived_scopes": "SELECT DISTINCT chunk_id, knowledge_scope_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM scopes WHERE scope_id = c.knowledge_scope_id AND status <> 'active')",
    "newest_graph_version": """SELECT knowledge_scope_id, version_id, version_number FROM versions WHERE status = 'published' AND capabilities.graph_ready AND capabilities.dense_ready AND capabilities.lexical_ready
QUALIFY row_number() OVER (PARTITION BY knowledge_scope_id ORDER BY version_number DESC, version_id) = 1""",
    "ttl_purge": _LOG + f" SELECT run_id, expires_at FROM r WHERE coalesce(expires_at >= TIMESTAMP '{NOW}', true)",
    "ttl_audit": _LOG + f" SELECT count(*) AS purged_runs, count(provider_usage) AS purged_usage, TIMESTAMP '{NOW}' AS purged_at, TIMESTAMP '{NOW}' + INTERVAL 30 DAY AS expires_at FROM r WHERE expires_at < TIMESTAMP '{NOW}'",
    "free_worker_ids": "SELECT i AS id FROM range(1024) t(i) WHERE i NOT IN (SELECT version_number FROM versions) ORDER BY 1 LIMIT 2",
    "latest_sources": _SRC + " SELECT * FROM s",
    "repeated_uploads": _SRC + " SELECT content_hash, count(*) AS copies, min(source_id) AS first_source_id FROM s WHERE content_hash IS NOT NULL GROUP BY 1 HAVING copies > 1",
    "source_integrity": _SRC + """, c AS (SELECT source_id, count(*) AS n, string_agg(content_text, chr(10) || chr(10) ORDER BY chunk_id) AS t FROM (SELECT DISTINCT source_id, chunk_id, content_text FROM chunks) GROUP BY 1)
SELECT source_id, coalesce(n, 0)::INT AS chunks, sha256(t) = content_hash AS hash_matches FROM s LEFT JOIN c USING (source_id)""",
    "index_versions": "SELECT DISTINCT knowledge_scope_id, index_version, embedding_model FROM chunks",
    "run_violations": _LOG + """, v AS (SELECT count(*) FILTER (completion_status NOT IN ('complete', 'partial', 'no_evidence', 'failed')) AS known_status,
  count(*) FILTER (retrieval_mode NOT IN ('dense', 'hybrid', 'graph_enhanced', 'agentic')) AS known_mode, count(*) FILTER (completion_status = 'no_evidence' AND evidence_count <> 0) AS no_evidence_is_empty,
  count(*) FILTER (retrieval_mode IN ('hybrid', 'graph_enhanced') AND subpath_timings IS NULL) AS hybrid_has_timings, count(*) FILTER (evidence_count <> len(evidence_ref_ids)) AS count_is_refs,
  count(*) FILTER (expires_at <= created_at) AS expires_later FROM r)
SELECT rule, rows FROM (UNPIVOT v ON COLUMNS(*) INTO NAME rule VALUE rows)""",
    "request_totals": _WIN + " SELECT instance_mode, tool, count(*) AS requests FROM w GROUP BY ALL",
    "status_distribution": _WIN + " SELECT instance_mode, completion_status, count(*) AS requests FROM w GROUP BY ALL",
    "latency_p50_p95": _WIN + " SELECT tool, round_even(quantile_cont(duration_ms, 0.5), 0)::BIGINT AS p50_ms, round_even(quantile_cont(duration_ms, 0.95), 0)::BIGINT AS p95_ms FROM w WHERE duration_ms >= 0 AND duration_ms < 2147483647 GROUP BY 1",
    "subpath_p50": _WIN + f""", e AS (SELECT tool, unnest(map_entries(subpath_timings)) AS e FROM w), m AS (SELECT tool, {_NAMES}[e.key] AS subpath, e.value AS v FROM e)
SELECT tool, subpath, round_even(list(v ORDER BY v)[count(*) // 2 + 1], 0)::BIGINT AS p50_ms FROM m WHERE subpath IS NOT NULL AND v IS NOT NULL GROUP BY ALL""",
    "provider_usage": _WIN + " SELECT " + ", ".join(f"coalesce(sum(provider_usage.{c}), 0)::BIGINT AS {c}" for c in runs.USAGE) + " FROM w",
    "timing_totals": _LOG + ", e AS (SELECT unnest(map_entries(subpath_timings)) AS e FROM r) SELECT e.key AS k, round(sum(e.value), 3) AS total_ms, count(e.value) AS runs FROM e GROUP BY 1",
    "late_arrivals": "SELECT floor((epoch_us(logged_at) - epoch_us(created_at)) / 86400000000)::INT AS days_late, count(*) AS deliveries, count(DISTINCT run_id) AS runs FROM retrieval_runs GROUP BY 1",
    "evidence_usage": _LOG + """, e AS (SELECT TRY_CAST(unnest(evidence_ref_ids) AS BIGINT) AS chunk_id, unnest(range(len(evidence_ref_ids))) AS pos FROM r)
SELECT chunk_id, count(*) AS runs, count(*) FILTER (pos = 0) AS first_places, chunk_id IN (SELECT chunk_id FROM chunks) AS known FROM e WHERE chunk_id IS NOT NULL GROUP BY 1""",
    "ledger_rejections": _LOG + """, c AS (SELECT chunk_id, min(knowledge_scope_id) AS knowledge_scope_id FROM chunks GROUP BY 1), e AS (SELECT run_id, TRY_CAST(unnest(evidence_ref_ids) AS BIGINT) AS chunk_id, unnest(range(len(evidence_ref_ids))) AS pos FROM r),
f AS (SELECT run_id, c.knowledge_scope_id FROM e JOIN c USING (chunk_id) WHERE pos = 0)
SELECT run_id, e.pos::INT AS pos, e.chunk_id, f.knowledge_scope_id FROM e JOIN f USING (run_id) LEFT JOIN c ON c.chunk_id = e.chunk_id WHERE c.knowledge_scope_id IS DISTINCT FROM f.knowledge_scope_id""",
    "redaction": f"SELECT chunk_id, md5(clean) AS clean_md5 FROM (SELECT DISTINCT chunk_id, content_text, {_redacted('content_text')} AS clean FROM chunks) WHERE clean <> content_text",
    "injection_scan": f"WITH s AS (SELECT coalesce({_signs(txt.HIGH_RISK)}, []) AS h, coalesce({_signs(txt.LOW_RISK)}, []) AS l, doc_id FROM documents) SELECT doc_id, CASE WHEN len(h) > 0 THEN 'high' WHEN len(l) > 0 THEN 'low' ELSE 'none' END AS risk, array_to_string(h || l, ',') AS matched FROM s",
    "text_functions": f"""SELECT doc_id, sha256(text) AS hash, greatest(1, ceil(length(text) / 4))::INT AS chars_estimate, substr(text, 1, 500) AS excerpt,
  len(list_filter(regexp_extract_all(lower(text), '{txt.TOKEN}'), lambda x: x NOT IN ({', '.join(f"'{w}'" for w in txt.STOP_WORDS)})))::INT AS tokens FROM documents WHERE text IS NOT NULL""",
}
