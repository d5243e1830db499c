"""Functions that look outside a document, as joins.

resolve() is a left join with a table of resources on (type, id); memberOf() an existence join with
expanded value sets.  Neither collects its other side; Spark broadcasts it only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.api import compile_path, fresh
from pathloom.plans.compiler import Items


def resource_key(kind: Column, id_: Column) -> Column:
    return F.concat(kind, F.lit("/"), id_)


def resolve(df: DataFrame, expression: str, resources: DataFrame, col: str | None = None, to: str = "resolved", key: str = "key", value: str = "resource", **options) -> DataFrame:
    """df with the resources that the references of expression point to: a value for a single path, an array in order for a collection.

    resources has a unique key (Type/id) and the resource.  References without counterpart are left out.
    Rows need no id: equal lists of references have equal results, so each distinct list is resolved once.
    """
    schema = df.schema if col is None else df.schema[col].dataType
    refs = compile_path(f"({expression}).getReferenceKey()", schema, col, **options).items
    kind = resources.schema[value].dataType
    if refs.kind == "Empty":
        return df.withColumn(to, F.lit(None).cast(kind))
    at, found = fresh(df, "key"), fresh(df, "value")
    kept = [c for c in df.columns if c.lower() != to.lower()]
    side = resources.select(F.col(key).alias("k"), F.col(value).alias("x"))
    keyed = df.withColumn(at, refs.c)
    if not refs.many:
        return keyed.join(side.withColumnsRenamed({"k": at, "x": found}), at, "left").select(*kept, F.col(found).alias(to))
    lists = keyed.select(F.col(at).alias("l")).filter(F.size("l") > 0).distinct()
    each = lists.select("l", F.posexplode("l").alias("i", "k")).join(side, "k")
    resolved = each.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r")).select(F.col("l").alias(at), F.col("r.x").alias(found))
    return keyed.join(resolved, at, "left").select(*kept, F.coalesce(F.col(found), F.array().cast(T.ArrayType(kind))).alias(to))


def codings(c: Column, kind: T.DataType) -> Column:
    """The codings (system, code) of a code (a string, without system), a Coding or a CodeableConcept."""
    pair = "struct<system:string,code:string>"

    def one(x: Column, fields: list[str]) -> Column:
        return F.struct((x["system"] if "system" in fields else F.lit(None)).cast("string").alias("system"), x["code"].cast("string").alias("code"))

    if isinstance(kind, T.StructType):
        if "coding" in kind.fieldNames():
            inner = kind["coding"].dataType
            many = c["coding"] if isinstance(inner, T.ArrayType) else F.array(c["coding"])
            fields = (inner.elementType if isinstance(inner, T.ArrayType) else inner).fieldNames()
            return F.filter(F.transform(many, lambda x: one(x, fields)), lambda x: x["code"].isNotNull())
        return F.when(c["code"].isNotNull(), F.array(one(c, kind.fieldNames()))).otherwise(F.array().cast(f"array<{pair}>"))
    return F.when(c.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("system"), c.cast("string").alias("code")))).otherwise(F.array().cast(f"array<{pair}>"))


def member_of(df: DataFrame, expression: str, value_sets: DataFrame, url: str, col: str | None = None, to: str = "member", **options) -> DataFrame:
    """df with a Boolean: whether the first item of expression is in the value set url of value_sets (url, system, code).

    A Coding, or any coding of a CodeableConcept, must have the code's system, unless either has none; a
    plain code has none.  Null where there is no code.
    """
    schema = df.schema if col is None else df.schema[col].dataType
    path = compile_path(expression, schema, col, **options)
    at, found = fresh(df, "codings"), fresh(df, "member")
    kept = [c for c in df.columns if c.lower() != to.lower()]
    if path.items.kind == "Empty":
        return df.select(*kept, F.lit(None).cast("boolean").alias(to))
    keyed = df.withColumn(at, codings(path.first(), df.select(path.first().alias("x")).schema["x"].dataType))
    system = F.col("system").cast("string") if "system" in value_sets.columns else F.lit(None).cast("string")
    members = value_sets.filter(F.col("url") == url).select(F.col("code").alias("c"), system.alias("s")).distinct()
    each = keyed.select(F.col(at).alias("l")).filter(F.size("l") > 0).distinct().select("l", F.explode("l").alias("x"))
    same = (F.col("x.code") == F.col("c")) & (F.col("x.system").isNull() | F.col("s").isNull() | (F.col("x.system") == F.col("s")))
    hits = each.join(members, same, "left_semi").select(F.col("l").alias(at), F.lit(True).alias(found)).distinct()
    return keyed.join(hits, at, "left").select(*kept, F.when(F.size(at) > 0, F.coalesce(F.col(found), F.lit(False))).alias(to))


def literal_member_of(sets: dict[str, list[str]]):
    """A memberOf() for small, fixed value sets, for compile_path(member_of=...)."""

    def test(url: str, x: Items) -> Column:
        c = x.c
        codes = F.array(*map(F.lit, sets.get(url, []))).cast("array<string>")
        return F.when(F.size(c) > 0, F.arrays_overlap(c, codes)) if x.many else F.when(c.isNotNull(), F.array_contains(codes, c))

    return test
