import json
import time

import pytest
from pyspark.sql import functions as F

from pathloom.operators import references
from pathloom.operators.api import compile_path, evaluate, from_rows, interpret, traced, within
from pathloom.plans.errors import ExpressionTimeoutError
from pathloom.sources import readers
from pathloom.streaming import streams


def test_resolve(spark):
    resources = spark.createDataFrame([("P/1", "one"), ("P/2", "two")], "key string, resource string")
    df = spark.createDataFrame([(1, "x/P/1", ["P/2", "P/9", "P/1", "P/2"]), (2, None, None), (2, None, None)], "id long, one string, many array<string>")
    single = references.resolve(df, "one", resources).orderBy("id").select("id", "resolved").collect()
    assert [tuple(r) for r in single] == [(1, "one"), (2, None), (2, None)]
    many = references.resolve(df, "many", resources).orderBy("id").select("resolved").collect()
    assert [r[0] for r in many] == [["two", "one", "two"], [], []]


def test_member_of(spark):
    sets = spark.createDataFrame([("u", "s", "a"), ("u", "t", "a"), ("v", "s", "b")], "url string, system string, code string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    assert [r["member"] for r in references.member_of(df, "code", sets, "u").orderBy("code").collect()] == [None, True, False]
    local = references.literal_member_of({"u": ["a"]})
    assert [r[0] for r in df.orderBy("code").select(compile_path("code.memberOf('u')", df.schema, member_of=local).column()).collect()] == [None, True, False]


def test_conforms_to(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "id long, name string")
    path = compile_path("conformsTo('p')", df.schema, profiles={"p": ["id.exists()", "name.length() > 0"]})
    assert [r[0] for r in df.orderBy("name").select(path.column()).collect()] == [True, False]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "tags": ["x"]}\n{"id": 2}\n')
    assert readers.read_json_texts(spark, str(tmp_path / "in")).count() == 2
    typed = readers.read_documents(spark, str(tmp_path / "in"), "id long, tags array<string>")
    assert [r.id for r in typed.orderBy("id").collect()] == [1, 2]
    parsed = readers.parse(readers.read_json_texts(spark, str(tmp_path / "in")), "id long")
    assert sorted(r.document.id for r in parsed.collect()) == [1, 2]
    roots = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"a":3}',)], "resource string")
    assert readers.explode_array_roots(roots).count() == 3
    assert from_rows([{"a": 1}], spark).first()[0] == '{"a": 1}'
    bundle = spark.createDataFrame([([((7, "P"),)],)], "entry array<struct<resource:struct<id:int,kind:string>>>")
    assert tuple(readers.bundle_entries(bundle).first()) == (7, "P")
    readers.write(typed, str(tmp_path / "out"))
    assert readers.read_parquet(spark, str(tmp_path / "out")).count() == 2


def test_streams_run_the_same_columns(spark, tmp_path):
    spark.range(10).selectExpr("id", "array(id, id + 1) AS v").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = readers.read_parquet(spark, str(tmp_path / "in"), stream=True, schema=schema)
    done = streams.project(stream, {"s": "v.sum()"})
    streams.start(done, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i + 1 for i in range(10)]


def test_windowed_count_drops_late_rows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:10",), ("2024-01-01 00:00:50",), ("2024-01-01 00:02:00",)], "t string").select(F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp").parquet(str(tmp_path / "in"))
    query = streams.windowed_count(stream, "t", "1 minute", "30 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["count"] for r in spark.table("counts").collect()) == [1, 2]


def test_trace_counts(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c"],), (None,)], "t array<string>")
    seen, observation = traced(df, "t.trace('tags').where($this > 'a').trace('kept').count()")
    seen.collect()
    assert observation.get == {"documents": 3, "tags": 3, "kept": 2}


def test_timeout(spark):
    @F.udf("int")
    def slow(x):
        time.sleep(20)
        return x

    with pytest.raises(ExpressionTimeoutError):
        within(spark, 1.0, lambda: spark.range(4).select(slow(F.col("id").cast("int"))).collect())
    assert within(spark, 30, lambda: spark.range(4).count()) == 4


def test_member_of_codings_and_their_systems(spark):
    coding = "struct<system:string,code:string>"
    rows = [(1, ("s", "a"), ([("t", "x"), ("s", "a")],)), (2, ("t", "a"), ([("t", "a")],)), (3, (None, "a"), ([],)), (4, None, None), (5, ("s", "b"), ([("s", "b")],))]
    df = spark.createDataFrame(rows, f"id int, one {coding}, concept struct<coding:array<{coding}>>").withColumn("codings", F.lit("kept"))
    sets = spark.createDataFrame([("u", "s", "a"), ("u", "s2", "a"), ("v", "t", "a")], "url string, system string, code string")
    found = lambda e: [r.member for r in references.member_of(df, e, sets, "u").orderBy("id").collect()]
    assert found("one") == [True, False, True, None, False]
    assert found("concept") == [True, False, None, None, False]
    assert references.member_of(df, "one", sets, "u").columns == [*df.columns, "member"]


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([("Patient/1", ["Patient/1", "Patient/2"], "k", "v", '{"a": 1}')], "one string, many array<string>, key string, value string, path string").withColumn("_key", F.lit(1))
    df = df.withColumns({"one": F.struct(F.col("one").alias("reference")), "many": F.transform("many", lambda x: F.struct(x.alias("reference")))})
    resources = spark.createDataFrame([("Patient/1", "p1"), ("Patient/2", "p2")], "key string, resource string")
    for e, want in (("one", "p1"), ("many", ["p1", "p2"])):
        out = references.resolve(df, e, resources)
        row = out.first()
        assert out.columns == [*df.columns, "resolved"] and (row.key, row.value, row._key, row.resolved) == ("k", "v", 1, want)
    assert interpret(df, "a + 1", col="path").columns == [*df.columns, "result"]


def test_bytes_cut_inside_a_character(spark):
    df = spark.createDataFrame([("é",), ("a€b",), ("plain",)], "s string")
    assert [r[0] for r in df.select(compile_path("s.substring(0, 1)", df.schema).column()).collect()] == ["\ufffd", "a", "p"]
    assert df.select(compile_path("s.substring(1, 3)", df.schema).column()).collect()[1][0] == "€"


def both(spark, schema, documents, expression, **options):
    """What the column and the row interpreter give for each document, as text; a failure is empty."""
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, resource string").withColumn("d", F.from_json("resource", schema))
    path = compile_path(expression, df.schema["d"].dataType, "d", cache=None, **options)
    column = [r[0] for r in df.orderBy("i").select(path.to_strings()).collect()]
    return column, [r.result or [] for r in interpret(df, expression).orderBy("i").collect()]


@pytest.mark.parametrize("move", ["+ 1 month", "- 13 months", "+ 40 days", "- 2 weeks", "+ 3 years"])
def test_text_that_is_a_date(spark, move):
    texts = ["1990-01-15", "2024-01-31", "2023-02", "1999", "2020-02-29T10:30:00Z", "2020-12-31T23:00:00+02:00", "no date", "1990-13-01", "", None]
    column, rows = both(spark, "birthDate string", [{"birthDate": t} for t in texts], f"birthDate {move}")
    assert column == rows
    assert [len(r) for r in rows] == [1] * 6 + [0, 1, 0, 0]  # months run over


def test_text_and_times_of_day_go_through_the_row_interpreter(spark):
    df = spark.createDataFrame([("1990-01-15T10:00:00Z",), (None,)], "at string")
    with pytest.warns(UserWarning, match="row interpreter"):
        out = evaluate(df, "at + 2 hours", col=None)
    assert [r.result for r in out.collect()] == [["1990-01-15T12:00:00Z"], []]


MIXED = "extension array<struct<url:string,valueString:string,valueInteger:long,valueBoolean:boolean>>, valueString string, valueInteger long"
MIXED_DOCUMENTS = [
    {"extension": [{"url": "a", "valueString": "wet"}, {"url": "b", "valueInteger": 4}], "valueInteger": 4},
    {"extension": [{"url": "b", "valueBoolean": True}, {"url": "c", "valueInteger": 9}, {"url": "a", "valueInteger": 7}], "valueString": "four"},
    {"extension": [{"url": "a"}, {"url": "b", "valueString": "4"}, {"url": "a", "valueBoolean": False}]},
    {"extension": [{"url": "a", "valueString": "x"}, {"url": "a", "valueInteger": 1}], "valueString": "4"},
    {},
]


@pytest.mark.parametrize(
    "expression",
    ["value.toString()", "value = 4", "value = '4'", "value != 4", "value ~ 'FOUR'", "4 = value", "value.exists()", "value + 1 = 5", "value.ofType(Integer)", "value.first().toString()", "value.count()", "value.toInteger()",
     "extension('a').value.first().toString()", "extension('a').value.last().toString()", "extension('a').value.count()", "extension.value.count()", "extension('b').value = 4", "extension('b').value.toString()", "extension('a').value.exists()",
     "getExtensionValue('b').toString()", "getExtensionValue('b') = '4'", "getExtensionValue('a').first().toString()", "getExtensionValue('a').count()", "getExtensionValue('b').ofType(Integer)", "extension.where(value = 4).url", "extension.select(value.toString())"],
)
def test_values_of_several_types(spark, expression):
    column, rows = both(spark, MIXED, MIXED_DOCUMENTS, expression)
    assert column == rows


def test_values_of_several_types_without_a_single_one(spark):
    df = spark.createDataFrame([(json.dumps(d),) for d in MIXED_DOCUMENTS], "resource string").select(F.from_json("resource", MIXED).alias("resource"))
    with pytest.warns(UserWarning, match="row interpreter"):
        assert [r.result for r in evaluate(df, "extension.value").collect()][0] == ["wet", "4"]
