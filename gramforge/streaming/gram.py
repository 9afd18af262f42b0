"""A Gram matrix kept up to date over a stream of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.sources.tables import vector_products


def streaming_gram(vectors: DataFrame, vector: str, n: int) -> DataFrame:
    """Upper cells (i, j, v) of X^T X of a streaming frame of n-vectors; write with outputMode complete or update."""
    return vector_products(vectors, vector, n).groupBy("i", "j").agg(F.sum("v").alias("v"))
