"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from skein.llm.decontaminate import op5_decontaminate
from skein.llm.html import op9_html
from skein.llm.langid import op4_langid
from skein.llm.neighbours import op2_neighbours
from skein.llm.quality import op3_quality
from skein.llm.secrets import OP8_SQL, op8_secrets
from skein.llm.sentencepiece_scan import op7_sentencepiece
from skein.llm.simhash import op1_simhash
from skein.llm.substrings import op6_substrings
from skein.llm.warc import OP10_SQL, op10_warc
from skein.session import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_neighbours": op2_neighbours,
    "op3_quality": op3_quality,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_substrings": op6_substrings,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_secrets": op8_secrets,
    "op9_html": op9_html,
    "op10_warc": op10_warc,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {"op8_secrets": OP8_SQL, "op10_warc": OP10_SQL}
