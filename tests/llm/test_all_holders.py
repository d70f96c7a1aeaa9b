"""Line dedup that tries every earlier document with a run, against the plain version without a bound."""

import numpy as np
import pytest

from tests.llm.test_text import aligned_blocks, removed_lines
from tidemark.llm import line_dedup, queries


@pytest.mark.parametrize("depth", [64, 2])
def test_every_holder_is_tried(spark, monkeypatch, depth):
    monkeypatch.setattr(line_dedup, "DEPTH", depth)
    r = np.random.default_rng(11)
    rows = [(i, "\n".join(" ".join([f"w{x}"] * (5 + x % 2)) for x in r.integers(0, 4, 16).tolist())) for i in range(40)]
    got = removed_lines(spark, rows, rounds=None)
    assert got == aligned_blocks(rows, 40) and got != aligned_blocks(rows)


def test_query_tries_every_holder(spark, tmp_path):
    block = " ".join(f"o{j}" for j in range(7))
    rows = [(i, "\n".join([block] * (1 if i < 8 else 6) + [f"own{i} b c d e f"])) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in queries.op2_line_alignment(spark, str(tmp_path)).collect()} == {0: 0, **{i: 1 for i in range(1, 8)}, 8: 6}
