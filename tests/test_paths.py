import random

import pytest

from nodeweave.operators.paths import expand


def trails(edges, start, low, high, both):
    """Ends of all paths without a repeated edge, by brute force."""
    out = []

    def walk(at, used, depth):
        if depth >= low:
            out.append((start, at))
        if high is not None and depth == high:
            return
        for e, (a, b) in enumerate(edges):
            if e in used:
                continue
            for x, y in {(a, b), (b, a)} if both else {(a, b)}:
                if x == at:
                    walk(y, used | {e}, depth + 1)

    walk(start, frozenset(), 0)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(5), r.randrange(5)) for _ in range(7)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "_eid long, _src long, _dst long")
    sources = spark.createDataFrame([(i,) for i in range(5)], "_start long")
    both = seed % 2 == 1
    for low, high in ((1, 3), (0, 2), (2, 4), (1, None)) if seed < 4 else ((1, None),):
        got = sorted(map(tuple, expand(df, sources, "BOTH" if both else "OUTGOING", low, high).collect()))
        want = sorted(p for s in range(5) for p in trails(edges, s, low, high, both))
        assert got == want
        if not both and low <= 1:
            assert sorted(map(tuple, expand(df, sources, "OUTGOING", low, high, True).collect())) == sorted(set(want))
