"""op12: the best 50 documents of each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import read_documents
from .treaps import BETWEEN, LOWER, UPPER, search


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{BETWEEN[1:-2]}]+')"
SQL = {
    "op12_ranked_search": f"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT doc, doc_id, len(terms) AS n, terms FROM words WHERE len(terms) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS total_docs, sum(n)::BIGINT AS total_terms FROM held
), queries AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL
), postings AS (
  SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM queries) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), corpus
), lengths AS (
  SELECT doc, doc_id, 100 - 50 + ((50 * n * total_docs) // total_terms) AS m FROM held, corpus
), scored AS (
  SELECT item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM queries JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc)
  GROUP BY item_id, doc_id, doc
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
""",
}
