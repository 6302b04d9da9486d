"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetrail.sources.scratch import fresh_path, shared_dir, written

__all__ = ["TOKENIZER_JSON", "TOKENIZER_RANKS", "fresh_path", "shared_dir", "table", "written"]

#: Files of the public tokenizers; their folder is a parameter of the operators.
TOKENIZER_JSON, TOKENIZER_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
