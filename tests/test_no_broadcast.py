"""Tables that grow with the pixels aren't sent to the driver to be broadcast."""

from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import grid
from tidemark.operators.components import components


def test_one_way_tracks_broadcast_nothing(spark):
    found = plans.queries()["i30_one_way_tracks"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def executed(spark) -> dict[int, str]:
    """The plans of all that has run so far, tables that were written on the way included."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {e.executionId(): e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size()))}


def broadcasts(spark, run) -> list[str]:
    before = executed(spark)
    run()
    new = [plan for k, plan in executed(spark).items() if k not in before]
    assert new
    return [plan for plan in new if "BroadcastExchange" in plan]


def test_no_step_of_one_way_tracks_broadcasts(spark):
    found = plans.queries()["i30_one_way_tracks"]
    assert not broadcasts(spark, lambda: found(spark, "/root/testdata/sf0.001").collect())


def test_rounds_of_components_broadcast_nothing(spark):
    edges = spark.range(60).where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = []
    assert not broadcasts(spark, lambda: got.extend(components(edges, few=5).collect()))
    assert {(r["node"], r["root"]) for r in got} == {(n, n // 10 * 10) for n in range(60)}


def test_labels_of_half_of_the_steps(spark):
    on = spark.createDataFrame([(7, 0, 2), (7, 1, 1), (7, 2, 0), (7, 2, 1), (7, 5, 5), (7, 4, 6), (7, 0, 6), (8, 0, 2), (8, 0, 3)], "image long, y int, x int")
    both = grid.neighbours(on).select("image", "y", "x", "ny", "nx")
    half = grid.neighbours(on, grid.ONWARD).select("image", "y", "x", "ny", "nx")
    turned = half.select("image", F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("y").alias("ny"), F.col("x").alias("nx"))
    assert sorted(map(tuple, half.unionByName(turned).collect())) == sorted(map(tuple, both.collect()))
    names = {(r["image"], r["y"], r["x"]): r["label"] % (1 << 40) for r in grid.label(on).collect()}
    first = {(7, 0, 2): (0, 2), (7, 1, 1): (0, 2), (7, 2, 0): (0, 2), (7, 2, 1): (0, 2), (7, 5, 5): (4, 6), (7, 4, 6): (4, 6), (7, 0, 6): (0, 6), (8, 0, 2): (0, 2), (8, 0, 3): (0, 2)}
    assert names == {k: (y << 20) + x for k, (y, x) in first.items()}
