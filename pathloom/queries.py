"""Queries of the path engine over the driver's tables, each with the same result in SQL.

A query evaluates named path expressions on documents assembled from the tables: orders with their
lines, customers with their orders, parts, events (JSON text), texts.  Result types: b Boolean, i
bigint, s string, d double.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import references
from pathloom.operators.api import compile_path, interpret, where
from pathloom.operators.documents import nest
from pathloom.plans.compiler import names
from pathloom.plans.syntax import parse

TYPES = {"b": "boolean", "i": "bigint", "s": "string", "d": "double"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Functions whose result depends on the order of children, so on all the fields that they are ordered by.
ORDERED = frozenset("first last tail skip take single aggregate join".split())


def child_fields(expressions: list[str]) -> set[str] | None:
    """The child fields that expressions name, or None if they need all of them in order."""
    used: set[str] = set()
    for e in expressions:
        tree = parse(e)
        fields, calls = names(tree)
        if calls & ORDERED or "[" in e or "$index" in e:
            return None
        used |= fields
    return used


def kept(fields: dict[str, Column], used: set[str] | None) -> list[Column]:
    """The first field, by which children are ordered, and the used ones; the scan reads no others."""
    return [f.alias(n) for k, (n, f) in enumerate(fields.items()) if used is None or k == 0 or n in used]


def order_documents(spark: SparkSession, sf_dir: str, used: set[str] | None = None) -> DataFrame:
    c = F.col
    orders = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("key"), c("o_orderstatus").alias("status"), c("o_totalprice").cast("decimal(15,2)").alias("amount"), c("o_orderdate").cast("date").alias("date"), F.date_format(c("o_orderdate").cast("date"), "yyyy-MM-dd").alias("written"), c("o_orderpriority").alias("priority"), F.struct(F.concat(F.lit("Customer/"), c("o_custkey").cast("string")).alias("reference")).alias("customer")
    )
    lines = {
        "n": c("l_linenumber").cast("bigint"), "partkey": c("l_partkey"), "suppkey": c("l_suppkey"), "quantity": c("l_quantity").cast("bigint"), "price": c("l_extendedprice").cast("decimal(15,2)"), "discount": c("l_discount").cast("decimal(4,2)"),
        "returnflag": c("l_returnflag"), "linestatus": c("l_linestatus"), "shipdate": c("l_shipdate").cast("date"),
    }
    return nest(orders, table(spark, sf_dir, "lineitem"), "key", "l_orderkey", kept(lines, used), "lines")


ORDERS = """d AS (SELECT o_orderkey AS key, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS priority, o_custkey AS custkey, coalesce(l.lines, []) AS lines
FROM orders LEFT JOIN (SELECT okey, list({'n': n, 'partkey': partkey, 'suppkey': suppkey, 'quantity': quantity, 'price': price, 'discount': discount, 'returnflag': returnflag, 'linestatus': linestatus, 'shipdate': shipdate} ORDER BY n, partkey, suppkey, quantity, price, discount, returnflag, linestatus, shipdate) AS lines
FROM (SELECT l_orderkey AS okey, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(15,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount, l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(l_shipdate AS DATE) AS shipdate FROM lineitem) GROUP BY okey) l ON o_orderkey = l.okey)"""


def customer_documents(spark: SparkSession, sf_dir: str, used: set[str] | None = None) -> DataFrame:
    c = F.col
    customers = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"), c("c_acctbal").cast("decimal(15,2)").alias("balance"),
        F.when(c("c_custkey") % 3 == 0, F.struct(c("c_acctbal").cast("decimal(15,2)").alias("value"), F.lit("mg").alias("unit"))).alias("valueQuantity"), F.when(c("c_custkey") % 3 == 1, c("c_name")).alias("valueString"),
        F.array(F.struct(F.lit("http://example.org/segment").alias("url"), c("c_mktsegment").alias("valueString")), F.struct(F.lit("http://example.org/nation").alias("url"), c("c_nationkey").cast("string").alias("valueString"))).alias("extension"),
    )
    orders = {"key": c("o_orderkey"), "status": c("o_orderstatus"), "amount": c("o_totalprice").cast("decimal(15,2)"), "date": c("o_orderdate").cast("date"), "priority": c("o_orderpriority")}
    return nest(customers, table(spark, sf_dir, "orders"), "key", "o_custkey", kept(orders, used), "orders")


CUSTOMERS = """d AS (SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(15,2)) AS balance, c_nationkey AS nationkey, coalesce(o.orders, []) AS orders
FROM customer LEFT JOIN (SELECT o_custkey, list({'key': o_orderkey, 'status': o_orderstatus, 'amount': CAST(o_totalprice AS DECIMAL(15,2)), 'date': CAST(o_orderdate AS DATE), 'priority': o_orderpriority} ORDER BY o_orderkey, o_orderstatus, o_totalprice) AS orders FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey)"""


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("key"), c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_type").alias("type"), c("p_size").cast("bigint").alias("size"), c("p_retailprice").cast("decimal(15,2)").alias("price"))


PARTS = "d AS (SELECT p_partkey AS key, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, CAST(p_retailprice AS DECIMAL(15,2)) AS price FROM part)"


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "lang", "source", "n_chars")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("value").cast("decimal(15,2)").alias("value"))


EVENTS = "d AS (SELECT event_id AS key, ts, event_type AS type, CAST(value AS DECIMAL(15,2)) AS value FROM events)"
TEXTS = "d AS (SELECT doc_id AS key, text, lang, source, n_chars FROM documents)"
SOURCES = {"order": (order_documents, ORDERS), "customer": (customer_documents, CUSTOMERS), "part": (part_documents, PARTS), "text": (text_documents, TEXTS), "event": (event_documents, EVENTS)}


@dataclass(frozen=True)
class Query:
    source: str
    columns: dict[str, tuple[str, str, str]]  # name: expression, type, SQL

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        used = child_fields([e for e, _, _ in self.columns.values()])
        df = SOURCES[self.source][0](spark, sf_dir, **({"used": used} if self.source in ("order", "customer") else {}))
        return df.select("key", *[compile_path(e, df.schema).first().cast(TYPES[t]).alias(n) for n, (e, t, _) in self.columns.items()])

    def sql(self) -> str:
        kinds = {"b": "BOOLEAN", "i": "BIGINT", "s": "VARCHAR", "d": "DOUBLE"}
        return f"WITH {SOURCES[self.source][1]} SELECT key, " + ", ".join(f"CAST({q} AS {kinds[t]}) AS {n}" for n, (_, t, q) in self.columns.items()) + " FROM d"


R = "list_filter(lines, lambda x: x.returnflag = 'R')"
QTY = "list_transform(lines, lambda x: x.quantity)"
FLAGS = "list_transform(lines, lambda x: x.returnflag)"
SUPP = "list_transform(lines, lambda x: x.suppkey)"
PLAN = {
    "nav_member": Query("order", {"n_lines": ("lines.count()", "i", "len(lines)"), "first_quantity": ("lines.quantity.first()", "i", "lines[1].quantity"), "customer": ("customer.reference", "s", "'Customer/' || custkey")}),
    "nav_polymorphic": Query("customer", {"amount": ("value.ofType(Quantity).value", "d", "CASE WHEN key % 3 = 0 THEN balance END"), "text": ("valueString", "s", "CASE WHEN key % 3 = 1 THEN name END")}),
    "nav_indexer": Query("order", {"third": ("lines[2].partkey", "i", "lines[3].partkey"), "out": ("lines[1000].partkey", "i", "NULL"), "negative": ("lines[-1].partkey", "i", "NULL")}),
    "nav_this_index_total": Query("order", {"odd": ("lines.where($index mod 2 = 1).quantity.sum()", "i", "coalesce(list_sum([lines[i].quantity FOR i IN range(1, len(lines) + 1) IF i % 2 = 0]), 0)"), "this": ("lines.quantity.select($this * 2).sum()", "i", f"coalesce(list_sum({QTY}), 0) * 2"), "total": ("lines.quantity.aggregate($this + $total, 0)", "i", f"coalesce(list_sum({QTY}), 0)")}),
    "nav_variables": Query("order", {"root": ("lines.where(n = 1).select(%resource.key + n).first()", "i", "list_filter(lines, lambda x: x.n = 1)[1].n + CASE WHEN len(list_filter(lines, lambda x: x.n = 1)) > 0 THEN key END"), "ucum": ("%ucum", "s", "'http://unitsofmeasure.org'"), "context": ("%context.status", "s", "status")}),
    "op_arithmetic": Query("part", {"plus": ("size + 3", "i", "size + 3"), "minus": ("size - 30", "i", "size - 30"), "times": ("price * size", "d", "price * size"), "div": ("(size - 25) div 7", "i", "CAST(trunc((size - 25) / 7.0) AS BIGINT)"), "mod": ("(size - 25) mod 7", "i", "(size - 25) % 7"), "negate": ("-size", "i", "-size"), "halves": ("size / 2", "d", "size / 2.0")}),
    "op_division_by_zero": Query("part", {"none": ("size / (size - size)", "d", "NULL"), "div": ("1 div (size - size)", "i", "NULL")}),
    "op_string": Query("part", {"joined": ("name + ' ' + brand", "s", "name || ' ' || brand"), "amp": ("name & {} & '!'", "s", "name || '!'")}),
    "op_compare": Query("part", {"lt": ("size < 20", "b", "size < 20"), "le": ("price <= 1000.5", "b", "price <= 1000.5"), "gt": ("name > 'm'", "b", "name > 'm'"), "ge": ("size >= 20.0", "b", "size >= 20"), "empty": ("size > {}", "b", "NULL")}),
    "op_equality": Query("part", {"eq": ("size = 11", "b", "size = 11"), "ne": ("size != 11", "b", "size <> 11"), "mixed": ("size = 11.0", "b", "size = 11"), "other": ("name = 1", "b", "false"), "none": ("name = {}", "b", "NULL")}),
    "op_equivalence": Query("part", {"eqv": ("name.upper() ~ name", "b", "true"), "spaces": ("name.replace(' ', '   ') ~ name", "b", "true"), "none": ("{} ~ name", "b", "false"), "not": ("size !~ 11", "b", "size <> 11"), "both": ("{} ~ {}", "b", "true")}),
    "op_collection_equality": Query("order", {"many": ("lines.quantity = 5", "b", "CASE WHEN len(lines) = 1 THEN lines[1].quantity = 5 END")}),
    "op_logic": Query("part", {"both": ("size > 10 and price > 1000", "b", "size > 10 AND price > 1000"), "either": ("size > 40 or brand = 'Brand#2'", "b", "size > 40 OR brand = 'Brand#2'"), "one": ("size > 40 xor brand = 'Brand#2'", "b", "(size > 40) <> (brand = 'Brand#2')"), "then": ("size > 40 implies price > 1000", "b", "NOT (size > 40) OR price > 1000"), "unknown_and": ("{} and size > 40", "b", "CASE WHEN size > 40 THEN NULL ELSE false END"), "unknown_or": ("{} or size > 40", "b", "CASE WHEN size > 40 THEN true END"), "negated": ("(size > 40).not()", "b", "NOT (size > 40)")}),
    "op_membership": Query("order", {"in_": ("status in ('F' | 'O')", "b", "status IN ('F', 'O')"), "contains_": ("lines.returnflag contains 'R'", "b", f"list_contains({FLAGS}, 'R')"), "missing": ("'Z' in lines.returnflag", "b", "false")}),
    "op_union": Query("order", {"united": ("(lines.returnflag | lines.linestatus).count()", "i", f"len(lines) + len(list_distinct(list_filter(list_transform(lines, lambda x: x.linestatus), lambda y: NOT list_contains({FLAGS}, y))))")}),
    "op_is_as": Query("order", {"number": ("key is Integer", "b", "true"), "text": ("status is String", "b", "true"), "wrong": ("status is Integer", "b", "false"), "as_": ("status as String", "s", "status"), "as_none": ("status as Integer", "s", "NULL"), "dates": ("date.is(Date)", "b", "true"), "kept": ("lines.quantity.ofType(Integer).count()", "i", "len(lines)")}),
    "fn_existence": Query("order", {"empty_": ("lines.empty()", "b", "len(lines) = 0"), "exists_": ("lines.exists()", "b", "len(lines) > 0"), "with_": ("lines.exists(returnflag = 'R')", "b", f"len({R}) > 0"), "all_": ("lines.all(quantity > 5)", "b", "len(list_filter(lines, lambda x: NOT (x.quantity > 5))) = 0"), "count_": ("lines.count()", "i", "len(lines)")}),
    "fn_all_any": Query("order", {"all_true": ("lines.select(quantity > 5).allTrue()", "b", "len(list_filter(lines, lambda x: x.quantity <= 5)) = 0"), "any_true": ("lines.select(quantity > 45).anyTrue()", "b", "len(list_filter(lines, lambda x: x.quantity > 45)) > 0"), "all_false": ("lines.select(quantity > 45).allFalse()", "b", "len(list_filter(lines, lambda x: x.quantity > 45)) = 0"), "any_false": ("lines.select(quantity > 5).anyFalse()", "b", "len(list_filter(lines, lambda x: x.quantity <= 5)) > 0")}),
    "fn_distinct": Query("order", {"distinct_": ("lines.returnflag.distinct().count()", "i", f"len(list_distinct({FLAGS}))"), "is_distinct": ("lines.returnflag.isDistinct()", "b", f"len(list_distinct({FLAGS})) = len(lines)")}),
    "fn_subsets": Query("order", {"subset": ("lines.returnflag.subsetOf('A' | 'R')", "b", f"len(list_filter({FLAGS}, lambda x: x NOT IN ('A', 'R'))) = 0"), "superset": ("lines.returnflag.supersetOf('A' | 'R')", "b", f"list_contains({FLAGS}, 'A') AND list_contains({FLAGS}, 'R')")}),
    "fn_where_select": Query("order", {"returned": ("lines.where(returnflag = 'R').quantity.sum()", "i", f"coalesce(list_sum(list_transform({R}, lambda x: x.quantity)), 0)"), "chosen": ("lines.select(price * (1 - discount)).sum()", "d", "coalesce(list_sum(list_transform(lines, lambda x: x.price * (1 - x.discount))), 0)"), "both": ("lines.where(returnflag = 'R' and quantity > 20).count()", "i", "len(list_filter(lines, lambda x: x.returnflag = 'R' AND x.quantity > 20))"), "repeated": ("lines.repeat(quantity).count()", "i", "len(lines)")}),
    "fn_subsetting": Query("order", {"first_": ("lines.first().partkey", "i", "lines[1].partkey"), "last_": ("lines.last().partkey", "i", "lines[-1].partkey"), "tail_": ("lines.tail().quantity.sum()", "i", f"coalesce(list_sum(({QTY})[2:]), 0)"), "skip_": ("lines.skip(2).quantity.sum()", "i", f"coalesce(list_sum(({QTY})[3:]), 0)"), "take_": ("lines.take(2).quantity.sum()", "i", f"coalesce(list_sum(({QTY})[1:2]), 0)"), "page": ("lines.skip(1).take(1).partkey", "i", "lines[2].partkey"), "single_": ("lines.single().partkey", "i", "CASE WHEN len(lines) = 1 THEN lines[1].partkey END")}),
    "fn_set_functions": Query("order", {"intersect_": ("lines.returnflag.intersect('A' | 'R').count()", "i", f"len(list_filter(list_distinct({FLAGS}), lambda x: x IN ('A', 'R')))"), "exclude_": ("lines.returnflag.exclude('R').count()", "i", "len(list_filter(lines, lambda x: x.returnflag <> 'R'))"), "combine_": ("lines.returnflag.combine(%resource.lines.linestatus).count()", "i", "2 * len(lines)"), "union_": ("lines.suppkey.union(%resource.lines.partkey).count()", "i", f"len(lines) + len(list_distinct(list_filter(list_transform(lines, lambda x: x.partkey), lambda y: NOT list_contains({SUPP}, y))))")}),
    "fn_aggregates": Query("order", {"sum_": ("lines.price.sum()", "d", "coalesce(list_sum(list_transform(lines, lambda x: x.price)), 0)"), "min_": ("lines.quantity.min()", "i", f"list_min({QTY})"), "max_": ("lines.shipdate.max().toString()", "s", "strftime(list_max(list_transform(lines, lambda x: x.shipdate)), '%Y-%m-%d')"), "avg_": ("lines.quantity.avg().round(4)", "d", f"round(CAST(list_sum({QTY}) AS DECIMAL(20,0)) / len(lines), 4)"), "product": ("lines.take(3).quantity.aggregate($this * $total, 1)", "i", f"coalesce(list_product(({QTY})[1:3]), 1)")}),
    "fn_values": Query("order", {"has_value": ("amount.hasValue()", "b", "true"), "object_value": ("customer.hasValue()", "b", "false"), "get_value": ("amount.getValue()", "d", "amount"), "not_": ("(status = 'F').not()", "b", "status <> 'F'")}),
    "fn_strings": Query("part", {"starts": ("name.startsWith('s')", "b", "starts_with(name, 's')"), "ends": ("name.endsWith('t')", "b", "ends_with(name, 't')"), "has": ("name.contains('e')", "b", "contains(name, 'e')"), "replaced": ("name.replace('e', 'E')", "s", "replace(name, 'e', 'E')"), "at": ("name.indexOf('e')", "i", "instr(name, 'e') - 1"), "part": ("name.substring(2, 3)", "s", "CASE WHEN length(name) > 2 THEN substring(name, 3, 3) END"), "rest": ("name.substring(4)", "s", "CASE WHEN length(name) > 4 THEN substring(name, 5) END"), "lower_": ("brand.lower()", "s", "lower(brand)"), "upper_": ("name.upper()", "s", "upper(name)"), "length_": ("name.length()", "i", "strlen(name)")}),
    "fn_string_lists": Query("part", {"chars": ("name.toChars().count()", "i", "length(name)"), "words": ("name.split(' ').count()", "i", "len(string_split(name, ' '))"), "joined": ("name.split(' ').join('-')", "s", "replace(name, ' ', '-')"), "trimmed": ("('  ' & name & ' ').trim()", "s", "name")}),
    "fn_regex": Query("part", {"matches_": ("brand.matches('#1[0-9]$')", "b", "regexp_matches(brand, '#1[0-9]$')"), "replaced": ("brand.replaceMatches('([0-9]+)', '<$1>')", "s", "regexp_replace(brand, '([0-9]+)', '<\\1>', 'g')")}),
    "fn_unicode": Query("text", {"bytes": ("text.length()", "i", "strlen(text)"), "words": ("text.split(' ').count()", "i", "len(string_split(text, ' '))"), "at": ("text.indexOf('é')", "i", "CASE WHEN instr(text, 'é') = 0 THEN -1 ELSE strlen(substring(text, 1, instr(text, 'é') - 1)) END")}),
    "fn_math": Query("part", {"abs_": ("(size - 25).abs()", "i", "abs(size - 25)"), "ceil_": ("price.ceiling()", "i", "ceil(price)"), "floor_": ("price.floor()", "i", "floor(price)"), "trunc_": ("(0 - price).truncate()", "i", "trunc(-price)"), "round_": ("price.round(1)", "d", "round(price, 1)"), "sqrt_": ("price.sqrt().round(6)", "d", "round(CAST(sqrt(price) AS DECIMAL(38,18)), 6)"), "power_": ("size.power(2)", "d", "size * size"), "ln_": ("price.ln().round(6)", "d", "round(CAST(ln(price) AS DECIMAL(38,18)), 6)"), "log_": ("price.log(10).round(6)", "d", "round(CAST(log10(price) AS DECIMAL(38,18)), 6)"), "exp_": ("(size / 10).exp().round(4)", "d", "round(CAST(exp(size / 10.0) AS DECIMAL(38,18)), 4)"), "none": ("(0 - size).sqrt()", "d", "NULL")}),
    "fn_conversion": Query("part", {"text": ("size.toString()", "s", "CAST(size AS VARCHAR)"), "back": ("size.toString().toInteger()", "i", "size"), "number": ("brand.substring(6).toDecimal()", "d", "CAST(substring(brand, 7) AS DOUBLE)"), "none": ("name.toInteger()", "i", "NULL"), "bool": ("(size mod 2).toBoolean()", "b", "size % 2 = 1"), "whole": ("price.toInteger()", "i", "trunc(price)"), "choice": ("iif(size > 25, 'big', 'small')", "s", "CASE WHEN size > 25 THEN 'big' ELSE 'small' END"), "quantity": ("size.toQuantity('mg') = 11 'mg'", "b", "size = 11")}),
    "fn_converts": Query("part", {"int_": ("brand.substring(6).convertsToInteger()", "b", "true"), "not_int": ("name.convertsToInteger()", "b", "false"), "dec": ("price.convertsToDecimal()", "b", "true"), "bool_": ("name.convertsToBoolean()", "b", "lower(name) IN ('true','t','yes','y','1','1.0','false','f','no','n','0','0.0')"), "str": ("price.convertsToString()", "b", "true"), "date_": ("name.convertsToDate()", "b", "true"), "datetime_": ("name.convertsToDateTime()", "b", "true"), "time_": ("name.convertsToTime()", "b", "true"), "qty": ("size.convertsToQuantity()", "b", "true")}),
    "fn_temporal": Query("order", {"year_": ("date.year()", "i", "year(date)"), "month_": ("date.month()", "i", "month(date)"), "day_": ("date.day()", "i", "day(date)"), "before": ("date < @1996-01-01", "b", "date < DATE '1996-01-01'"), "in_year": ("date > @1996", "b", "CASE WHEN year(date) <> 1996 THEN year(date) > 1996 END"), "same": ("date = @1996-01-02", "b", "date = DATE '1996-01-02'")}),
    "fn_date_arithmetic": Query("order", {"days": ("(date + 10 days).toString()", "s", "strftime(date + 10, '%Y-%m-%d')"), "weeks": ("(date - 2 weeks).toString()", "s", "strftime(date - 14, '%Y-%m-%d')"), "months": ("(date + 1 month).toString()", "s", "strftime(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) + CAST(day(date) - 1 AS INTEGER), '%Y-%m-%d')"), "years": ("(date + 1 year).toString()", "s", "strftime(CAST(date_trunc('month', date) + INTERVAL 12 MONTH AS DATE) + CAST(day(date) - 1 AS INTEGER), '%Y-%m-%d')")}),
    "fn_datetime": Query("event", {"hour_": ("ts.hour()", "i", "hour(ts)"), "minute_": ("ts.minute()", "i", "minute(ts)"), "second_": ("ts.second()", "i", "second(ts)"), "milli": ("ts.millisecond()", "i", "millisecond(ts) % 1000"), "year_": ("ts.year()", "i", "year(ts)"), "late": ("ts > @2024-01-15T12:00:00.000Z", "b", "ts > TIMESTAMP '2024-01-15 12:00:00'"), "shifted": ("(ts + 36 hours).day()", "i", "day(ts + INTERVAL 36 HOUR)"), "months": ("(ts + 2 months).month()", "i", "month(date_trunc('month', ts) + INTERVAL 2 MONTH + to_days(CAST(day(ts) - 1 AS INTEGER)))"), "day_": ("ts.toDate() = @2024-01-15", "b", "CAST(ts AS DATE) = DATE '2024-01-15'")}),
    "fn_clock": Query("part", {"now_": ("now() > @2020-01-01T00:00:00.000Z", "b", "true"), "today_": ("today() > @2020-01-01", "b", "true"), "time_": ("timeOfDay().exists()", "b", "true"), "noon": ("@T12:30:15.minute()", "i", "30")}),
    "fn_to_temporal": Query("part", {"date_": ("'2024-02-30'.toDate().day()", "i", "30"), "none": ("name.toDate()", "s", "NULL"), "datetime_": ("name.toDateTime()", "s", "name"), "time_": ("name.toTime()", "s", "name")}),
    "fn_text_dates": Query("order", {"days": ("(written + 10 days).toString()", "s", "strftime(date + 10, '%Y-%m-%d')"), "weeks": ("(written - 2 weeks).toString()", "s", "strftime(date - 14, '%Y-%m-%d')"), "months": ("(written + 1 month).toString()", "s", "strftime(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) + CAST(day(date) - 1 AS INTEGER), '%Y-%m-%d')"), "later": ("written + 1 year > @1996-06-30", "b", "CAST(date_trunc('month', date) + INTERVAL 12 MONTH AS DATE) + CAST(day(date) - 1 AS INTEGER) > DATE '1996-06-30'")}),
    "fn_several_types": Query("customer", {"same": ("value = name", "b", "CASE key % 3 WHEN 0 THEN false WHEN 1 THEN true END"), "other": ("name != value", "b", "CASE key % 3 WHEN 0 THEN true WHEN 1 THEN false END"), "n": ("value.count()", "i", "CASE WHEN key % 3 < 2 THEN 1 ELSE 0 END")}),
    "fn_as": Query("customer", {"amount": ("value.as(Quantity).value", "d", "CASE WHEN key % 3 = 0 THEN balance END"), "text": ("value.as(String)", "s", "CASE WHEN key % 3 = 1 THEN name END")}),
    "nav_type_name": Query("order", {"status": ("Order.status", "s", "status"), "n": ("Order.lines.count()", "i", "len(lines)")}),
    "fn_boundaries": Query("order", {"low": ("date.toString().substring(0, 7).toDate().lowBoundary().toString()", "s", "strftime(date_trunc('month', date), '%Y-%m-%d')"), "high": ("date.toString().substring(0, 7).toDate().highBoundary().toString()", "s", "strftime(last_day(date), '%Y-%m-%d')"), "amount_low": ("amount.lowBoundary()", "d", "amount - 0.005"), "amount_high": ("amount.highBoundary()", "d", "amount + 0.005"), "whole": ("key.lowBoundary()", "i", "key")}),
    "fn_quantity": Query("part", {"same": ("size.toQuantity('mg') = 0.011 'g'", "b", "size = 11"), "more": ("size.toQuantity('kg') > 25000 'g'", "b", "size > 25"), "apart": ("size.toQuantity('kg') = 1 'm'", "b", "false"), "like": ("size.toQuantity('MG') ~ 11 'mg'", "b", "size = 11"), "sum_": ("(size.toQuantity('mg') + 5 'mg') = 16 'mg'", "b", "size = 11"), "calendar": ("1 year = 12 months", "b", "false")}),
    "fn_extension": Query("customer", {"value": ("extension('http://example.org/segment').valueString", "s", "segment"), "has": ("hasExtension('http://example.org/nation')", "b", "true"), "has_not": ("hasExtension('http://example.org/none')", "b", "false"), "got": ("getExtensionValue('http://example.org/nation')", "s", "CAST(nationkey AS VARCHAR)")}),
    "fn_reference_key": Query("order", {"ref": ("customer.getReferenceKey()", "s", "'Customer/' || custkey"), "kind": ("customer.getReferenceKey('type')", "s", "'Customer'"), "id": ("customer.getReferenceKey('id')", "s", "CAST(custkey AS VARCHAR)")}),
    "fn_trace": Query("order", {"traced": ("lines.trace('lines').quantity.sum()", "i", f"coalesce(list_sum({QTY}), 0)")}),
    "nested_customers": Query("customer", {"n": ("orders.where(status = 'F').count()", "i", "len(list_filter(orders, lambda x: x.status = 'F'))"), "s": ("orders.where(status = 'F').key.sum()", "i", "coalesce(list_sum(list_transform(list_filter(orders, lambda x: x.status = 'F'), lambda x: x.key)), 0)")}),
}


def events_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text without a schema, by the row interpreter."""
    return interpret(table(spark, sf_dir, "events").select("event_id", "props"), "(k + 1) | descendants().count()", "props").select("event_id", F.col("result")[0].cast("bigint").alias("k1"), F.element_at("result", -1).cast("bigint").alias("n"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """children() and descendants() of JSON text."""
    nested = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"b":[1,null,"x"],"c":{"d":{"e":true}}}')).alias("resource"))
    out = interpret(interpret(nested, "children().count()", to="c"), "descendants().count()", to="d")
    return out.select("event_id", F.col("c")[0].cast("bigint").alias("n_children"), F.col("d")[0].cast("bigint").alias("n_descendants"))


def conforms_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = part_documents(spark, sf_dir)
    path = compile_path("conformsTo('http://example.org/small')", df.schema, profiles={"http://example.org/small": ["size < 20", "name.exists()"]})
    return df.select("key", path.column().alias("conforms"))


def value_set_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    path = compile_path("segment.memberOf('http://example.org/vs')", df.schema, member_of=references.literal_member_of({"http://example.org/vs": ["MACHINERY", "BUILDING"]}))
    return df.select("key", path.column().alias("member"))


def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path as the filter of a table; its comparisons are pushed to the scan."""
    return where(table(spark, sf_dir, "lineitem"), "l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber")


def resolve_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer/"), F.col("c_custkey").cast("string")).alias("key"), F.struct("c_name", "c_mktsegment").alias("resource"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.concat(F.lit("Customer/"), F.col("o_custkey").cast("string")).alias("reference")).alias("customer"))
    return references.resolve(orders, "customer", resources).select("o_orderkey", F.col("resolved.c_name").alias("name"), F.col("resolved.c_mktsegment").alias("segment"))


def member_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "customer").filter("c_mktsegment LIKE '%A%'").select(F.lit("http://example.org/vs").alias("url"), F.lit("").alias("system"), F.col("c_mktsegment").alias("code"))
    return references.member_of(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", sets, "http://example.org/vs").select("c_custkey", "member")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level aggregation over values that paths compute."""
    df = order_documents(spark, sf_dir, {"returnflag", "price"})
    returned = compile_path("lines.where(returnflag = 'R').price.sum()", df.schema).column()
    return df.groupBy("status").agg(F.count("*").alias("n"), F.sum(returned).cast("double").alias("returned"))


OTHER: dict[str, tuple[Callable, str]] = {
    "src_json_dynamic": (events_dynamic, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1, 1::BIGINT AS n FROM events"),
    "fn_tree": (tree, "SELECT event_id, 4::BIGINT AS n_children, 7::BIGINT AS n_descendants FROM events"),
    "fn_conforms_to": (conforms_to, "SELECT p_partkey AS key, p_size < 20 AS conforms FROM part"),
    "fn_member_of_literal": (value_set_literal, "SELECT c_custkey AS key, c_mktsegment IN ('MACHINERY', 'BUILDING') AS member FROM customer"),
    "row_filter": (row_filter, "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'"),
    "fn_resolve": (resolve_join, "SELECT o_orderkey, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "fn_member_of": (member_of_join, "SELECT c_custkey, c_mktsegment LIKE '%A%' AS member FROM customer"),
    "row_grouped": (grouped, f"WITH {ORDERS} SELECT status, count(*) AS n, CAST(sum(coalesce(list_sum(list_transform({R}, lambda x: x.price)), 0)) AS DOUBLE) AS returned FROM d GROUP BY status"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.run for n, q in PLAN.items()} | {n: f for n, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql() for n, q in PLAN.items()} | {n: s for n, (_, s) in OTHER.items()}
