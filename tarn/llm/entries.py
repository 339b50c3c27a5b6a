"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import bounded
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .fingerprint import op2_fingerprint
from .jaccard import OP7_SQL, op7_jaccard
from .language_id import op8_language_id
from .mixing import OP6_SQL, op6_mixing
from .packing import op10_packing
from .quality import op4_quality
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .token_file import op1_token_file
from .warc import OP5_SQL, op5_warc



def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {name: _query(f) for name, f in {
    "op1_token_file": op1_token_file,
    "op2_fingerprint": op2_fingerprint,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_jaccard": op7_jaccard,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
}.items()}

ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_jaccard": OP7_SQL,
    "op9_substring_dedup": OP9_SQL,
}
