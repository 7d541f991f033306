"""Functions of tables and groups: a table function and an aggregate over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Words:
    def eval(self, name: str):
        for place, word in enumerate((name or "").split(" "), 1):
            if word:
                yield place, word


def words_of_names(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """(p_partkey, place, word) by a table function joined laterally to its rows."""
    spark.udtf.register("loomwork_words", F.udtf(_Words, returnType="place int, word string"))
    return spark.sql("SELECT p_partkey, place, word FROM {parts}, LATERAL loomwork_words(p_name)", parts=parts)


def trimmed_range(values: Column) -> Column:
    """Distance of the ninth decile of a group from its first."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.quantile(0.9) - x.quantile(0.1))

    return spread(values)
