"""A corpus from raw documents to packed sequences, in five stages.

Every stage calls one operator of ``keybalance.llm`` on all that the stage before it kept.
The first four return the columns of documents:

1. quality rules: documents that a rule rejects go;
2. SimHash near-dedup: of each group of linked documents the one with the smallest id stays
   (unlike texts under one id are documents of their own);
3. benchmark decontamination: contaminated documents go;
4. secret scans: secrets in texts are masked, no document goes;
5. packing: pieces of full-length token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keybalance.llm import decontaminate, packing, quality, secret_scan, simhash
from keybalance.llm.queries import table, tokenizer_path
from keybalance.workdir import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, by_id=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: Fingerprints, randomness tests and tokens are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
