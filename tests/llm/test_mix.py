import random
from collections import Counter, defaultdict

import pytest

from lakevault.llm.mix import mix, pivot, pooled


def water(sizes):
    """Targets by sharing the excess again and again; sizes by source, in order."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sizes)}
    total, capped, left = sum(sizes.values()), {}, dict(sizes)
    while left:
        share = (total - sum(capped.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * share > 3 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * share for s in left}
        for s in over:
            capped[s] = 3.0 * sizes[s]
            del left[s]
    return capped


def test_pivot_keeps_mass_and_expectation():
    rows = [(7, 0.3), (50, 0.6), (3, 0.9), (20, 0.5), (9, 0.0), (4, 1.0)]
    hits = Counter()
    for k in range(4000):
        given, at, q = pivot(rows, random.Random(k))
        mass = sum(g * s for g, (s, _) in zip(given, rows, strict=True)) + (q * rows[at][0] if at >= 0 else 0)
        assert mass == pytest.approx(sum(s * p for s, p in rows))
        for j, g in enumerate(given):
            hits[j] += g + (q if j == at else 0)
    assert all(abs(hits[j] / 4000 - p) < 0.04 for j, (_, p) in enumerate(rows))


def test_pool_keeps_mass_and_expectation():
    sizes, hits = [40, 30, 22, 15, 9, 5, 4, 2, 1, 1, 0], Counter()
    for k in range(4000):
        given, open_ = pooled(sizes, 0.4, random.Random(k))
        assert sum(g * s for g, s in zip(given, sizes, strict=True)) + sum(p * sizes[j] for j, p in open_) == pytest.approx(0.4 * sum(sizes))
        for j, g in enumerate(given):
            hits[j] += g + dict(open_).get(j, 0)
    assert all(abs(hits[j] / 4000 - 0.4) < 0.04 for j in range(len(sizes) - 1))


def documents(spark, n=3000):
    rng = random.Random(3)
    rows = [(k, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "B", "é", None, "small"] if k % 50 == 0 else ["a", "b", "B", "é", None])) for k in range(n)]
    rows += [rows[7]] * 400 + [(None, "x y", "a"), (None, None, "b"), (5, "other text", "a")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark, monkeypatch):
    from lakevault.llm import mix as module

    monkeypatch.setattr(module, "BUCKET", 64)
    monkeypatch.setattr(module, "FAN", 4)
    rows, docs = documents(spark)
    got = mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len((t or "").split())) for d, t, s in rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    ordered = {s: size[s] for s in [*sorted(s for s in size if s is not None), None]}
    want, taken, largest = water(ordered), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) < largest[s]
    again = mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, "  ", "b")], [(1, "a b c", "x")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken == r.target == r.size for r in got)
