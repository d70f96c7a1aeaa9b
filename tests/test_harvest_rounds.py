"""Harvesting goes through its rounds inside images: as many tables are written whatever the rounds are."""

import random

from tidemark.operators import tracing as T


def grids(spark, n=12):
    rng = random.Random(7)
    rows = [(i, y, x) for i in range(n) for y in range(9) for x in range(9) if rng.random() < 0.3 + 0.03 * i]
    # A ring, a lone pixel, and a pixel that comes twice.
    rows += [(99, y, x) for y, x in ((0, 1), (1, 0), (1, 2), (2, 1), (7, 7), (7, 7))]
    return spark.createDataFrame(rows, "image long, y int, x int")


def test_few_tables_are_written_and_joins_give_the_same(spark, monkeypatch):
    written, stash = [], T.stash
    monkeypatch.setattr(T, "stash", lambda df, name: written.append(name) or stash(df, name))
    on = grids(spark)
    got = T.harvest(on, 8)
    rows = sorted(map(tuple, got.collect()))
    assert len(written) <= 3 and max(r[1] for r in rows) == 1
    joined = T.harvest(on, 8, few=40)
    assert any(name == "harvest-tracks" for name in written) and sorted(map(tuple, joined.collect())) == rows and joined.schema == got.schema


def test_traces_of_one_group_and_of_joins_agree(spark, monkeypatch):
    written, stash = [], T.stash
    monkeypatch.setattr(T, "stash", lambda df, name: written.append(name) or stash(df, name))
    on = grids(spark)
    got = T.trace(on, 1)
    rows = sorted(map(tuple, got.collect()))
    assert len(written) <= 3 and {r[0] for r in rows} >= {0, 11, 99}
    joined = T.trace(on, 1, few=0)
    assert any(name.startswith("chains") for name in written) and sorted(map(tuple, joined.collect())) == rows and joined.schema == got.schema
