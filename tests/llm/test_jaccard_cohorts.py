"""Cohorts of several blocks whose numbers stand next to those of other cohorts."""

import pytest

pytest.importorskip("engram.llm")
from engram.llm import jaccard


def test_cohorts_are_compared_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
    text = lambda group, i: " ".join([*(f"w{group}x{k}" for k in range(60)), f"end{i}"])
    groups = {0: range(0, 800, 50), **{c: (c, 1000 + c) for c in range(1, 16)}}  # the first has four blocks, so 16 tasks
    rows = [(i, text(c, i), c, 57) for c, ids in groups.items() for i in ids]
    t = spark.createDataFrame(rows, "doc_id long, text string, cohort long, n_shingles long")
    links = {tuple(sorted(r)) for r in jaccard.verified(t.select("doc_id", "text"), t.drop("text"), len(rows)).collect()}
    for c in range(1, 16):
        assert (c, 1000 + c) in links
    assert len([1 for a, b in links if a in groups[0] and b in groups[0]]) >= len(groups[0]) - 1
