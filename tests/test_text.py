from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callsheet.functions import joined_names, register_functions, word_count

EDGES = {
    "": 1,
    " ": 1,
    "   ": 1,
    "a b ": 2,
    " a": 2,
    "a  b": 3,
    "a\tb": 1,
    "a \t": 2,
    "é ß": 2,
    None: None,
    "x" * 587: 1,
}


def test_word_count_edges(spark):
    df = spark.createDataFrame([(t,) for t in EDGES], "text string")
    counted = df.select("text", word_count(F.col("text")).alias("n")).collect()
    assert {r.text: r.n for r in counted} == EDGES


def test_word_count_in_sql(spark):
    register_functions(spark)
    df = spark.createDataFrame([(t,) for t in EDGES], "text string")
    counted = spark.sql("SELECT text, word_count(text) AS n FROM {df}", df=df).collect()
    assert {r.text: r.n for r in counted} == EDGES


def test_joined_names(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (1, None), (1, "b"), (2, None)], "k int, name string"
    )
    listed = df.groupBy("k").agg(
        joined_names(F.col("name")).alias("x"),
        joined_names(F.col("name"), "/", leading_blank=False).alias("y"),
    )
    assert {tuple(r) for r in listed.collect()} == {(1, " a, b, b", "a/b/b"), (2, None, None)}


@settings(
    max_examples=10,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.text(alphabet=" ab\té\n", max_size=30), min_size=1, max_size=50))
def test_word_count_equals_its_definition(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    counted = df.select("i", word_count(F.col("text")).alias("n")).collect()
    for row in counted:
        text = texts[row.i]
        assert row.n == len(text.rstrip(" ")) - len(text.replace(" ", "")) + 1
