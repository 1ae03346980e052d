"""The pipeline's similarity stage against brute-force Jaccard."""

import numpy as np
import pytest

from tributary.llm import common, simhash


def sets(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("part,bound", [(1 << 21, 16 << 20), (900, 16 << 20), (1 << 21, 0)])
def test_keep_one_is_exact_jaccard(spark, monkeypatch, part, bound):
    """Pairs on both sides of 0.8, and chains of them; with lists cut into parts; with all joins shuffled."""
    monkeypatch.setattr(simhash, "PART_SHINGLES", part)
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(11)
    rows = []
    for g in range(150 if part > 900 and bound else 50):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(60, 300)))]
        for _ in range(4):
            words = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 28))):
                words[at] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    own = {i: sets(t) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    below = 0
    for a in own:
        for b in range(a - a % 4, a):
            s = len(own[a] & own[b]) / len(own[a] | own[b])
            below += 0.6 <= s < 0.8
            if s >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert below > 20
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i in own if find(i) == i}


def test_keep_one_decides_on_rows(spark):
    """Ids that repeat with other texts, null ids, repeated rows."""
    long = " ".join(f"a{i}" for i in range(80))
    other = " ".join(f"b{i}" for i in range(80))
    third = " ".join(f"c{i}" for i in range(80))
    rows = [(1, long), (2, long), (2, other), (None, third), (None, third + " end"), (None, long), (7, other), (7, other), (9, None), (8, "")]
    got = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert [r for r in got if r[0] is not None] == [(1, long), (2, other), (8, "")]
    assert [r[1][:3] for r in got if r[0] is None] == ["c0 "]
