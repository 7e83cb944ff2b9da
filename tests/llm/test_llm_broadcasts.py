"""Rows that are unfolded, many for one, are not sent to every task, however small Spark takes them to be."""

from __future__ import annotations

import numpy as np

from wardline.llm import simhash


def _sent(plan: str) -> list[str]:
    """Operators below each broadcast of a plan's text, which shows depth by indentation."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : below]))
    return out


def test_unfolded_fingerprints_are_joined_by_shuffle(spark):
    draw = np.random.default_rng(3)
    prints = draw.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    close = np.concatenate([prints, prints[:100] ^ 1, prints[:50] ^ (1 << 40), prints[0] ^ (1 << np.arange(60))])
    rows = spark.createDataFrame([(int(x),) for x in close], "fp long").distinct()
    found = simhash.links(rows, crowd=8)
    linked = {frozenset(r) for r in found.collect()}
    assert frozenset((int(prints[1]), int(prints[1] ^ 1))) in linked
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Generate" in plan
    assert not [x for x in _sent(plan) if "MapInPandas" in x or "Generate" in x]
