"""Connected components: what the driver plans at one time stays small."""

from __future__ import annotations

from ledgerflow.llm.common import Scratch
from ledgerflow.llm.components import connected_components


def test_a_round_is_planned_step_by_step(spark, monkeypatch):
    """A path and a star: right roots, and no written table's plan has more than a few shuffles and broadcasts."""
    plans, save = [], Scratch.save

    def watched(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", watched)
    edges = [(i, i + 1) for i in range(100, 130)] + [(1_000 + i, 999) for i in range(600)] + [(5, 5)]
    roots = connected_components(spark, spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "test"))
    got = sorted(tuple(r) for r in roots.collect())
    assert got == sorted([(i, 100) for i in range(100, 131)] + [(999 + i, 999) for i in range(601)])
    assert len(plans) > 2 and max(p.count("Exchange ") for p in plans) <= 12
