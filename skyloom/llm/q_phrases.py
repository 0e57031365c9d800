"""op13: collocations of all documents, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import phrases
from .shared import read_documents


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read_documents(spark, sf_dir))


_CUT = "((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT"
SQL = {
    "op13_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), runs AS (
  SELECT lang, unnest(flatten([
    [[w[i]] for i in range(1, len(w) + 1)],
    [[w[i], w[i + 1]] for i in range(1, len(w))],
    [[w[i], w[i + 1], w[i + 2]] for i in range(1, len(w) - 1)]])) AS p
  FROM words
), counts AS (
  SELECT lang, p, count(*)::BIGINT AS a FROM runs GROUP BY lang, p HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), cuts AS (
  SELECT c.lang, c.p, c.a, l.a AS l, r.a AS r, k, {_CUT} AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1) c
  JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:c.k]
  JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part AS p, max(a) AS most
  FROM (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS part FROM counts WHERE len(p) = 3) GROUP BY lang, part
), kept AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest LEFT JOIN longer USING (lang, p)
  WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
}
