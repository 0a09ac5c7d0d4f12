"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from iterix.llm.html_text import op3_html_text
from iterix.llm.language_id import op2_language_id
from iterix.llm.near_dup import op5_minhash_near_dup
from iterix.llm.packing import op8_packing
from iterix.llm.quality import op10_quality
from iterix.llm.quality_rules import SQL as QUALITY_RULES_SQL
from iterix.llm.quality_rules import op1_quality_rules
from iterix.llm.segmentations import op4_segmentations
from iterix.llm.token_counts import op6_token_counts
from iterix.llm.token_files import op7_token_files
from iterix.llm.vector_dup import SQL as VECTOR_DUP_SQL
from iterix.llm.vector_dup import op9_vector_dup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_html_text": op3_html_text,
    "op4_segmentations": op4_segmentations,
    "op5_minhash_near_dup": op5_minhash_near_dup,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_vector_dup": op9_vector_dup,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {"op1_quality_rules": QUALITY_RULES_SQL, "op9_vector_dup": VECTOR_DUP_SQL}
