"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .q_langid import op1_language_id
from .q_lines import SQL as LINE_SQL
from .q_lines import op5_line_dedup
from .q_merkle import SQL as MERKLE_SQL
from .q_merkle import op9_fingerprints
from .q_mixing import SQL as MIXING_SQL
from .q_mixing import op8_mixing
from .q_near import op10_near_dedup
from .q_phrases import SQL as PHRASE_SQL
from .q_phrases import op13_collocations
from .q_quality import op3_quality
from .q_search import SQL as SEARCH_SQL
from .q_search import op12_ranked_search
from .q_spans import op4_substring_dedup
from .q_tokens import op2_token_files, op6_packing, op11_token_counts
from .q_vectors import op7_embedding_dedup

_ALL = (
    op1_language_id,
    op2_token_files,
    op3_quality,
    op4_substring_dedup,
    op5_line_dedup,
    op6_packing,
    op7_embedding_dedup,
    op8_mixing,
    op9_fingerprints,
    op10_near_dedup,
    op11_token_counts,
    op12_ranked_search,
    op13_collocations,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {**LINE_SQL, **MIXING_SQL, **MERKLE_SQL, **SEARCH_SQL, **PHRASE_SQL}
