import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.functions import coerce, format_duration, placeholders, resolve, spark_type, template_column


def test_placeholders():
    assert placeholders("") == frozenset()
    assert placeholders("{{kept}}") == frozenset()
    assert placeholders("a_{x}_{y}/z.pkl") == {"x", "y"}
    for bad in ("a_{}", "a_{open"):
        with pytest.raises(ValueError, match="Invalid key template"):
            placeholders(bad)


def test_resolve_keeps_unknown_names():
    assert resolve("{a}_{b}.csv", {"a": 3}) == "3_{b}.csv"
    assert resolve("plain", {"a": 1}) == "plain"
    assert resolve("{a:03d}", {"a": 7}) == "007"


@given(st.dictionaries(st.sampled_from("abc"), st.integers(), max_size=3))
def test_resolve_matches_format_map(values):
    assert resolve("{a}-{b}-{c}", values) == "-".join(str(values.get(n, "{" + n + "}")) for n in "abc")


def test_template_column(spark):
    row = spark.range(1).select(template_column("x_{id}_{other}", {"id": F.col("id")}).alias("t")).first()
    assert row["t"] == "x_0_{other}"


@pytest.mark.parametrize(("seconds", "text"), [(0.25, "250 ms"), (1, "1.00 s"), (59.5, "59.50 s"), (61.5, "1 min 1.50 s")])
def test_format_duration(seconds, text):
    assert format_duration(seconds) == text


def test_spark_types():
    assert spark_type(int) == T.LongType()
    assert spark_type(int | None) == T.LongType()
    assert spark_type(list[str]) == T.ArrayType(T.StringType())
    assert spark_type(dict[str, float]) == T.MapType(T.StringType(), T.DoubleType())
    assert spark_type(tuple[int, str]).simpleString() == "struct<_1:bigint,_2:string>"
    with pytest.raises(TypeError):
        spark_type(object)


def test_coerce():
    assert [coerce("3", int), coerce("yes", bool), coerce("no", bool), coerce("x", str), coerce("none", int | None), coerce("2.5", float)] == [3, True, False, "x", None, 2.5]
