"""Components over long chains of shared keys."""

import random

from tidemark.operators import identity


def test_components_follow_shuffled_chains(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    rows = [(c, f"k{i + d}") for i, c in enumerate(order) for d in (0, 1)] + [(1000, "x"), (1001, "x"), (1002, "y")]
    got = {r["candidate"]: r["component"] for r in identity.components(spark.createDataFrame(rows, "candidate long, key string")).collect()}
    assert got == dict.fromkeys(range(300), 0) | {1000: 1000, 1001: 1000, 1002: 1002}
