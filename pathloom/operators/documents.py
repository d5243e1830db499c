"""Documents assembled from flat tables: a parent row with its children as an ordered array of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: list[Column], to: str) -> DataFrame:
    """parents with an array of the fields of their children, ordered by the fields from the first on; empty where there are none.

    Children are gathered on their side first, so the join moves one row per parent.
    """
    gathered = children.groupBy(F.col(child_key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(to))
    joined = parents.join(gathered, parents[parent_key] == gathered["_key"], "left").drop("_key")
    kind = joined.schema[to].dataType
    return joined.withColumn(to, F.coalesce(F.col(to), F.array().cast(kind)))
