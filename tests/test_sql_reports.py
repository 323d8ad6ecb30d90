"""The reports with parameters as SQL table functions, against the operators."""

import random
from decimal import Decimal

import pytest
from tables import rows

from callsheet.functions import sql as sql_functions
from callsheet.plans import create_views, extreme_share, nth_ranked


def made(spark, seed):
    rnd = random.Random(seed)
    entity = [(i, f"e{i}", rnd.choice([None, 1, 2, 2, 3])) for i in range(25)]
    partition = [(p, f"p{p}", rnd.randrange(1, 9), rnd.randrange(10**9)) for p in (4, 5, 6)]
    spoken = [(i, p, rnd.choice([None, 0, 1, 5])) for i in range(27) for p in (4, 5, 7) if rnd.random() < 0.8]
    return {
        "entity": spark.createDataFrame(entity, "id INT, name STRING, score INT"),
        "partition": spark.createDataFrame(partition, "part_id INT, name STRING, words_total INT, money BIGINT"),
        "rollup": spark.createDataFrame(spoken, "entity_id INT, part_id INT, words INT"),
    }


@pytest.mark.parametrize("seed", range(2))
def test_extreme_share_in_sql(spark, seed):
    tables = made(spark, seed)
    create_views(tables, {})
    for mode in ("most", "LEAST"):
        wanted = extreme_share(tables["rollup"], tables["partition"], tables["entity"], mode)
        assert rows(spark.sql("SELECT * FROM extreme_share(:m)", args={"m": mode})) == rows(wanted)
    with pytest.raises(Exception, match="mode must be"):
        spark.sql("SELECT * FROM extreme_share('best')").collect()
    one = spark.sql("SELECT entity_name FROM extreme_share('most') WHERE part_id = 4")
    assert one.columns == ["entity_name"] and one.count() == 1


@pytest.mark.parametrize("seed, ranges", [(0, 64), (1, 4), (2, 2)])
def test_every_rank_in_sql(spark, monkeypatch, seed, ranges):
    monkeypatch.setattr(sql_functions, "RANGES", ranges)
    tables = made(spark, seed)
    create_views(tables, {})
    people = tables["rollup"].where("part_id = 5").join(tables["entity"], tables["entity"]["id"] == tables["rollup"]["entity_id"])
    n = people.count()
    wanted = [nth_ranked(tables["entity"], tables["rollup"], 5, k).first() for k in (1, 2, n // 2, n)]
    for k, row in zip((1, 2, n // 2, n), wanted, strict=True):
        found = spark.sql("SELECT * FROM nth_ranked(5, :n)", args={"n": k}).collect()
        assert [tuple(r) for r in found] == [(row["id"], row["name"], row["score"], row["words"], k)]
    for k in ("0", "-1", str(n + 1), "NULL"):
        assert spark.sql(f"SELECT * FROM nth_ranked(5, {k})").collect() == []
    assert spark.sql("SELECT * FROM nth_ranked(99, 1)").collect() == []


def test_functions_follow_the_views(spark):
    tables = made(spark, 3)
    tables["entity"] = tables["entity"].selectExpr("id", "name", "CAST(score AS DECIMAL(9,2)) AS score")
    create_views(tables, {})
    before = spark.sql("SELECT score FROM nth_ranked(5, 1)").first()["score"]
    assert isinstance(before, Decimal)
    tables["entity"].selectExpr("id", "name", "CAST(score * 2 AS DECIMAL(9,2)) AS score").createOrReplaceTempView("entity")
    assert spark.sql("SELECT count(*) FROM nth_ranked(5, 1)").first()[0] == 1
    spark.catalog.dropTempView("entity")
    tables["entity"].createOrReplaceTempView("entity")
