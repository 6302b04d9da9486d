"""A corpus through the stages of training-data preparation, each on all that its predecessor kept.

The quality classifier rejects documents; of exact copies one stays, then one of each group of near
copies (five words, similarity 0.8); passages of about 50 words and more that repeat are cut from the
texts; what is left is packed into sequences.

Defined results: null text counts as empty, and all empty texts are copies of one another; a null id
stays only where its copies have none, and is in no group of near copies; rows that repeat id and text
stay together; columns are carried along up to packing, whatever their names, and `n_chars` follows the
text where there is one; without labels nothing is rejected; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.exact_dedup import exact_dedup
from pagetrail.llm.minhash import near_dedup
from pagetrail.llm.packing import pack
from pagetrail.llm.quality import fit, graded, select_quality
from pagetrail.llm.shared import TOKENIZER_JSON, table, written
from pagetrail.llm.suffix_dedup import suffix_dedup

#: Bytes of a repeated passage: 50 short words have more.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return select_quality(docs, fit(docs, graded(table(spark, sf_dir, "labels"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER_JSON))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("minhash near-dedup", near), ("suffix-array dedup", passages), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
