"""op9: Merkle fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .merkle import PARAGRAPH, fingerprints
from .shared import read_documents


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_documents(spark, sf_dir).select("doc_id", "text"))


def _tree(text: str) -> str:
    return f"[[md5(p) for p in regexp_extract_all(s, '{PARAGRAPH}')] for s in string_split({text}, chr(10))]"


_FINGER = "{0}_root || ':' || array_to_string([left(md5('s' || coalesce(array_to_string(s, ''), '')), 8) || coalesce(array_to_string([left(p, 8) for p in s], ''), '') for s in {0}], '/')"
_NEAR = "CASE WHEN own_root = {0}_root THEN 1.0::DOUBLE WHEN len(list_distinct(own_short)) + len(list_distinct({0}_short)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(own_short, {0}_short)) / (len(list_distinct(own_short)) + len(list_distinct({0}_short))) END"
SQL = {
    "op9_fingerprints": f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), ordered AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
), edited AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM ordered
), trees AS (
  SELECT *, {_tree("text")} AS own, {_tree("edited")} AS edit, {_tree("next_text")} AS "next" FROM edited
), roots AS (
  SELECT *, {", ".join(f'''md5('r' || array_to_string([md5('s' || coalesce(array_to_string(s, ''), '')) for s in "{x}"], '')) AS {x}_root, [left(p, 8) for p in flatten("{x}")] AS {x}_short''' for x in ("own", "edit", "next"))}
  FROM trees
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_FINGER.format("own")} AS fingerprint,
       {_FINGER.format("edit")} AS edited_fingerprint, {_NEAR.format("edit")} AS near_edited, {_NEAR.format("next")} AS near_next
FROM roots
""",
}
