"""Chinese words of the documents, and term statistics over texts cut into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import segment
from sparquill.functions import text as txt
from sparquill.operators import sparse
from sparquill.scratch import Scratch
from sparquill.session import table

_LEAST, _COHESION = 20, 20.0


def _words(spark, sf_dir):
    return Scratch(spark).keep(segment.fit_words(table(spark, sf_dir, "documents"), "text", least=_LEAST, cohesion=_COHESION))


def chinese_words(spark, sf_dir):
    return _words(spark, sf_dir).select("word", "n", F.round("cohesion", 3).alias("cohesion"))


def segmented_terms(spark, sf_dir):
    cut = segment.segmenter(_words(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("pos", "term")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def segmented_term_stats(spark, sf_dir):
    """Document frequencies and idf of the chunks' terms, Chinese ones by word."""
    cut = segment.segmenter(_words(spark, sf_dir))
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "content_text").dropDuplicates(["chunk_id"])
    counts = sparse.term_counts(chunks, "chunk_id", "content_text", tokens=cut)
    return sparse.term_stats(Scratch(spark).keep(counts)).withColumn("idf", F.round("idf", 6))


QUERIES = {f.__name__: f for f in (chinese_words, segmented_terms, segmented_term_stats)}

_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)
_FIT = f"""
WITH r AS (SELECT unnest(regexp_extract_all(text, '{segment.HAN}+')) AS run FROM documents), tt AS (SELECT sum(length(run)) AS total FROM r),
g AS (SELECT gram, count(*) AS n FROM (SELECT substr(run, i, k) AS gram FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM r), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= length(run)) GROUP BY 1 HAVING n >= {_LEAST}),
s AS (SELECT gram AS word, n, unnest(range(1, length(gram))) AS cut FROM g WHERE length(gram) > 1),
k AS (SELECT word, s.n, min(s.n * total / (a.n * b.n)::DOUBLE) AS cohesion FROM s JOIN g a ON a.gram = substr(word, 1, cut) JOIN g b ON b.gram = substr(word, cut + 1), tt GROUP BY ALL HAVING cohesion >= {_COHESION}),
p AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) || '|[a-z0-9_]+|{segment.HAN}' AS pattern FROM k)
"""
_CUT = "list_filter(regexp_extract_all(lower({}), pattern), lambda x: x NOT IN (" + _STOP + "))"
SQL = {
    "chinese_words": _FIT + "SELECT word, n, round(cohesion, 3) AS cohesion FROM k",
    "segmented_terms": _FIT + f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_CUT.format('text')}) AS term FROM documents, p) GROUP BY 1",
    "segmented_term_stats": _FIT + f""", c AS (SELECT chunk_id, min(content_text) AS content_text FROM chunks GROUP BY 1), l AS (SELECT DISTINCT chunk_id, unnest({_CUT.format('content_text')}) AS term FROM c, p), n AS (SELECT count(*) AS n_docs FROM c)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM l, n GROUP BY 1""",
}
