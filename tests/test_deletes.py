import pytest
from pyspark.sql import functions as F
from tables import rows

from callsheet.operators import DeleteRefused, delete_rows, orphans, refusals
from callsheet.schemas import CASCADE, FOREIGN_KEYS, REFUSE, ForeignKey


def test_deleting_a_partition_cascades(derived):
    after = delete_rows(derived, FOREIGN_KEYS, "partition", F.col("part_id") == 4)
    assert rows(after["partition"].select("part_id")) == [(5,), (6,)]
    for name in ("turn", "rollup", "contest"):
        assert rows(after[name].select("part_id").distinct()) == [(5,), (6,)]
    for fk in FOREIGN_KEYS:
        assert orphans(after[fk.child], fk.column, after[fk.parent], fk.key).isEmpty()


def test_deleting_a_location_sets_null(derived):
    after = delete_rows(derived, FOREIGN_KEYS, "location", F.col("id") == 1)
    places = {r.id: r.location_id for r in after["entity"].collect()}
    assert places == {0: 0, 1: None, 2: 2, 3: 3, 4: 4, 5: 5, 6: None, 7: None, 8: 6, 9: 7}
    assert after["entity"].columns == derived["entity"].columns


def test_deleting_a_related_entity_is_refused(derived):
    with pytest.raises(DeleteRefused, match="still refers to entity"):
        delete_rows(derived, FOREIGN_KEYS, "entity", F.col("id") == 2)


def test_a_reference_that_goes_by_cascade_does_not_refuse(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id int")
    edges = spark.createDataFrame([(1, 1), (2, 2), (2, None)], "src int, dst int")
    links = [
        ForeignKey("edge", "src", "node", "id", CASCADE),
        ForeignKey("edge", "dst", "node", "id", REFUSE),
    ]
    after = delete_rows({"node": nodes, "edge": edges}, links, "node", F.col("id") == 1)
    assert rows(after["edge"]) == [(2, 2), (2, None)]
    with pytest.raises(DeleteRefused):
        more = edges.union(spark.createDataFrame([(2, 1)], edges.schema))
        delete_rows({"node": nodes, "edge": more}, links, "node", F.col("id") == 1)


def test_cascade_runs_level_by_level(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(10, 1), (20, 2)], "id int, a int")
    c = spark.createDataFrame([(100, 10), (200, 20), (300, None)], "id int, b int")
    links = [ForeignKey("b", "a", "a", "id", CASCADE), ForeignKey("c", "b", "b", "id", CASCADE)]
    after = delete_rows({"a": a, "b": b, "c": c}, links, "a", F.col("id") == 1)
    assert rows(after["a"]) == [(2,), (None,)]
    assert rows(after["b"]) == [(20, 2)]
    assert rows(after["c"]) == [(200, 20), (300, None)]


def test_references_in_a_circle_end(spark):
    """A chain of three within one table, and two tables that refer to each other."""
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 5)], "id int, boss int")
    link = ForeignKey("staff", "boss", "staff", "id", CASCADE)
    after = delete_rows({"staff": staff}, [link], "staff", F.col("id") == 1)
    assert rows(after["staff"]) == [(4, None), (5, 5)]
    after = delete_rows({"staff": staff}, [link], "staff", F.col("id") == 5)
    assert rows(after["staff"].select("id")) == [(1,), (2,), (3,), (4,)]
    a = spark.createDataFrame([(1, 20), (2, 10), (3, None)], "id int, b int")
    b = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id int, a int")
    links = [ForeignKey("b", "a", "a", "id", CASCADE), ForeignKey("a", "b", "b", "id", CASCADE)]
    after = delete_rows({"a": a, "b": b}, links, "a", F.col("id") == 1)
    assert rows(after["a"]) == [(3, None)]
    assert rows(after["b"]) == [(30, 3)]


def test_refusals_are_the_rows_that_block(spark):
    node = spark.createDataFrame([(1,), (2,)], "id int")
    edge = spark.createDataFrame([(7, 1), (8, 2), (9, None)], "id int, node int")
    links = [ForeignKey("edge", "node", "node", "id", REFUSE)]
    found = refusals({"node": node, "edge": edge}, links, "node", F.col("id") == 1)
    assert rows(found["edge"]) == [(7, 1)]
    assert refusals({"node": node, "edge": edge}, links, "node", F.col("id") == 5) == {}
