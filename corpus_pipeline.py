"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.

1. quality_classifier: documents that the classifier rejects go. It learns from the labels beside the documents, never
   from the held-out fold.
2. simhash_near_dedup: of each group of documents linked by a five-word Jaccard similarity of 0.8 or more the one with
   the smallest id stays. Candidates come from SimHash's covering search, and from MinHash bands beyond its radius.
3. benchmark_decontamination: documents that hold a benchmark passage go.
4. secret_scan: secrets are cut out of the texts; live-looking and copied ones get different tags.
5. sentencepiece_encode: texts become piece ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import materialize
from skein.llm.decontaminate import drop_leaks
from skein.llm.quality import fit, score_documents
from skein.llm.secrets import redact_secrets
from skein.llm.sentencepiece_scan import encode
from skein.llm.simhash import keep_one
from skein.session import ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select(*COLUMNS), model, keep=True)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return redact_secrets(docs.select(*COLUMNS))


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = encode(docs, keep=["doc_id", "lang", "source"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_encode", sentencepiece_encode),
]

#: The learned and iterative stages can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
