"""op8: documents sampled to tempered weights of sources, languages and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import BLANK, DIMENSIONS, FINAL, OPEN, SETTLED, WORD, mix_attainable, with_topics
from .shared import read_documents

SHARE = 0.5


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_topics(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    probability = F.round("probability", 6).alias("probability")
    return mix_attainable(rows, SHARE).select("doc_id", "source", "lang", "topic", "tokens", probability, "kept")


def _target(d: str) -> str:
    """Values in the order of what they hold; those before the first that its share wouldn't exceed are taken whole."""
    only = f"WHERE {d} IS NOT NULL" if d in OPEN else ""
    before = "OVER (ORDER BY have, {0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)".format(d)
    return f"""
have_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS have, sqrt(sum(tokens)::DOUBLE) AS wish FROM cells {only} GROUP BY {d} HAVING sum(tokens) > 0),
scale_{d} AS (SELECT have, wish, (sum(have) OVER () * {SHARE} - coalesce(sum(have) {before}, 0)) / (sum(wish) OVER () - coalesce(sum(wish) {before}, 0)) AS scale FROM have_{d}),
target_{d} AS MATERIALIZED (SELECT {d}, least(have, wish * (SELECT min_by(scale, have) FROM scale_{d} WHERE have > wish * scale)) AS target FROM have_{d})"""


def _sql() -> str:
    n, rounds = len(DIMENSIONS), len(DIMENSIONS) * SETTLED
    turn = lambda f, whole: " ".join(["CASE", f"WHEN k >= {rounds} THEN {whole}", *[f"WHEN k % {n} = {i} THEN {f(d)}" for i, d in enumerate(DIMENSIONS)], "END"])
    value = turn(lambda d: f"coalesce('={{}}' || {d}, 'null')".replace("{}", d), "'all'")
    want = turn(lambda d: f"target_of_{d}", f"total * {SHARE}")
    names = ", ".join([*DIMENSIONS, "tokens", "total", *[f"target_of_{d}" for d in DIMENSIONS]])
    joins = " ".join(f"LEFT JOIN target_{d} ON cells.{d} IS NOT DISTINCT FROM target_{d}.{d}" for d in DIMENSIONS)
    own = ", ".join([*[f"cells.{d}" for d in DIMENSIONS], "tokens", *[f"target_{d}.target AS target_of_{d}" for d in DIMENSIONS]])
    same = " AND ".join(f"d.{d} IS NOT DISTINCT FROM f.{d}" for d in DIMENSIONS)
    return f"""
WITH RECURSIVE topics AS (SELECT vec_id, min(label) AS topic FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
docs AS (
  SELECT doc_id, source, lang, topic,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '{WORD}', 'a', 'g'), '{BLANK}', '', 'g'))::BIGINT AS tokens
  FROM documents LEFT JOIN topics ON doc_id = vec_id
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
{",".join(map(_target, DIMENSIONS))},
base AS MATERIALIZED (SELECT {own}, (SELECT sum(tokens)::DOUBLE FROM cells) AS total FROM cells {joins}),
raked AS (
  SELECT 0 AS k, {names}, tokens * {SHARE}::DOUBLE AS weight FROM base
  UNION ALL
  SELECT k + 1, {names}, least(tokens::DOUBLE, weight * CASE WHEN have > 0 THEN coalesce(want / have, 1) ELSE 1 END)
  FROM (SELECT *, {want} AS want, sum(weight) OVER (PARTITION BY {value}) AS have FROM raked WHERE k < {rounds + FINAL}) steps
), fit AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE {SHARE} END AS probability FROM raked WHERE k = {rounds + FINAL})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(f.probability, 6) AS probability,
       ('0x' || left(md5('mix' || coalesce(d.doc_id::VARCHAR, 'null')), 13))::BIGINT / 4503599627370496.0::DOUBLE < f.probability AS kept
FROM docs d JOIN fit f ON {same}
"""


SQL = {"op8_mixing": _sql()}
