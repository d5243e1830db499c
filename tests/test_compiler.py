import pytest
from cases import CASES
from pyspark.sql import functions as F

from pathloom.operators.api import DEFAULT_CACHE, ExpressionCache, compile_path, evaluate, interpret, must_compile, where
from pathloom.operators.interpreter import evaluate_json
from pathloom.plans.errors import NotCompilable, PathError
from pathloom.plans.values import show


def norm(v):
    try:
        return str(round(float(v), 9))
    except ValueError:
        return v


@pytest.mark.parametrize("name", list(CASES))
def test_columns_agree_with_the_row_interpreter(spark, name):
    document, schema, expressions = CASES[name]
    df = spark.createDataFrame([(document,)], "resource string").select(F.from_json("resource", schema).alias("d"))
    expressions = expressions.split("\n")
    row = df.select(*[compile_path(e, df.schema["d"].dataType, "d", cache=None).to_strings().alias(f"c{i}") for i, e in enumerate(expressions)]).first()
    wrong = {}
    for e, got in zip(expressions, row, strict=True):
        try:
            expected = [show(v) for v in evaluate_json(document, e)]
        except PathError:
            expected = []
        if list(map(norm, got)) != list(map(norm, expected)):
            wrong[e] = got, expected
    assert not wrong


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, ["a", None], 5), (2, None, None), (None, [], 7)], "id long, tags array<string>, n int")


def test_nulls_are_empty(people):
    path = lambda e: compile_path(e, people.schema)
    rows = people.select(path("tags.count()").column().alias("c"), path("tags.empty()").column().alias("e"), path("n + 1").column().alias("n"), path("id.exists()").column().alias("x"), path("missing").exists().alias("m")).collect()
    assert [tuple(r) for r in rows] == [(1, False, 6, True, False), (0, True, None, True, False), (0, True, 8, False, False)]


def test_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS n", "struct(id AS h) AS s", "array(struct(id AS q, 'R' AS rf, 'long' AS other)) AS lines").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = where(df, "n >= 5 and s.h = 40")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,5)" in plan and "EqualTo(s.h,40)" in plan
    plan = df.select(compile_path("lines.where(rf = 'R').q.sum()", df.schema, null_elements=False).column())._jdf.queryExecution().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "rf" in schema and "other" not in schema


def test_typed_helpers(people):
    df = people.filter("id = 1")
    one = lambda e, f: df.select(getattr(compile_path(e, df.schema), f)()).first()[0]
    assert one("id = 1", "to_boolean") is True and one("missing", "to_boolean") is False
    assert one("tags", "to_string") == "a" and one("missing", "to_string") == ""
    assert one("tags", "to_strings") == ["a"] and one("tags", "count") == 1 and one("n", "array") == [5]


def test_errors_null_or_raise(spark):
    df = spark.createDataFrame([(["a", "b"],)], "t array<string>")
    assert df.select(compile_path("t + 'x'", df.schema).column()).first()[0] is None
    with pytest.raises(Exception, match="one item"):
        df.select(compile_path("t + 'x'", df.schema, on_error="raise").column()).collect()
    with pytest.raises(ValueError, match="f"):
        must_compile("f()", df.schema)
    with pytest.raises(Exception, match="over 1 items"):
        df.select(compile_path("t.where(true)", df.schema, max_collection_size=1).column()).collect()


def test_fallback_and_json(spark):
    df = spark.createDataFrame([('{"a":[1,"x"]}',), (None,), ("broken",)], "resource string")
    assert [r[0] for r in evaluate(df, "a").select("result").collect()] == [["1", "x"], [], []]
    out = interpret(df, "a + 1", errors_to="why").select("result", "why").collect()
    assert out[0]["result"] is None and out[0]["why"].startswith("SingletonError") and out[1]["result"] == []
    parsed = evaluate(df.limit(1), "a.count()", schema="a array<string>")
    assert parsed.columns == ["resource", "result"] and parsed.first()["result"] == 2
    assert evaluate(df.limit(1), "descendants().count()", schema="a array<string>").first()["result"] == ["2"]
    typed = spark.createDataFrame([(1, "x")], "a long, b string")
    assert evaluate(typed, "a | b", None).first()["result"] == ["1", "x"]


def test_choice_of_several_types(spark):
    df = spark.createDataFrame([(None, "x"), (4, None), (None, None)], "valueInteger long, valueString string")
    rows = df.select(*[compile_path(e, df.schema).column().alias(n) for n, e in {"i": "value.ofType(Integer)", "is_": "value is String", "e": "value.exists()"}.items()]).collect()
    assert [tuple(r) for r in rows] == [(None, True, True), (4, False, True), (None, None, False)]
    with pytest.raises(NotCompilable):
        compile_path("value", df.schema)


def test_cache():
    cache = ExpressionCache(2)
    for k in ("a", "b", "a", "c", "b"):
        cache.get((k,), lambda: k)
    assert (cache.hits, cache.misses, len(cache.kept)) == (1, 4, 2) and cache.hit_rate() == 0.2
    assert DEFAULT_CACHE.limit == 1000
