import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakevault.llm import leaks, ngram_join, substrings
from lakevault.llm.shards import mixed
from lakevault.llm.words import Words, run_hashes
from tests.llm.helpers import corpus, frame, near, prose, shingles, words


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab \t\n\x0b\x0c\r\x1c é"), max_size=60))
def test_words(text):
    raw = (text + "\n").encode()
    found = Words(np.frombuffer(raw, np.uint8))
    assert [raw[a:b].decode() for a, b in zip(found.begin, found.end, strict=True)] == words(text)
    assert len(set(found.hash.tolist())) == len(set(words(text)))


def test_run_hashes_tell_runs_apart():
    w = [random.Random(4).randrange(40) for _ in range(3000)]
    for which in (0, 1):
        h = run_hashes(mixed(np.array(w, np.uint64)), 3, which)
        assert len(h) == len(w) - 2
        assert len(set(h.tolist())) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def test_covers():
    for p, cover in substrings.COVERS.items():
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def brute_windows(texts, window):
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("window", "shard"), [(35, 1 << 22), (35, 2000), (8, 3000), (3, 500), (1, 4000)])
def test_substrings(spark, monkeypatch, window, shard):
    texts = [*corpus(), "z " * 200, *(f"w{k}" * 70 + " tail" for k in (1, 1, 2))]
    sharded = substrings.sharded
    monkeypatch.setattr(substrings, "sharded", lambda docs, text: sharded(docs, text, shard))
    got = {r.doc_id: r for r in substrings.deduplicated(frame(spark, texts).withColumnRenamed("n_chars", "n_words"), window=window).collect()}
    assert len(got) == len(texts)
    for k, (n, gone, sha, kept) in enumerate(brute_windows(texts, window)):
        r = got[k]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha), k
        assert r.text == (kept if gone else texts[k])


def test_substrings_of_repeated_rows_and_none(spark):
    text = prose(random.Random(3), 50)
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.deduplicated(docs).collect())
    assert got == [(0, 0), (1, 50), (1, 50)]
    assert substrings.deduplicated(docs.limit(0)).collect() == []


def test_needed_matches():
    for n in (8, 40, 72):
        least = ngram_join.needed(n)
        assert 0 <= least < n
        # by integration: the posterior of similarities above the threshold
        x = np.linspace(0, 1, 200_001)
        for m in range(max(0, least - 1), least + 1):
            d = x**m * (1 - x) ** (n - m)
            part = d[x >= ngram_join.THRESHOLD].sum() / d.sum()
            assert (part >= ngram_join.TOLERANCE) == (m >= least)


@pytest.mark.parametrize(("classes", "size"), [(512, 1 << 19), (4, 1 << 19), (512, 300)])
def test_near_copies(spark, monkeypatch, classes, size):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", size)
    rng = random.Random(8)
    base = prose(rng, 60).split()
    group = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 60, 2)] * 2
    texts = corpus(2) + group
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in ngram_join.joined(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == near(texts)


@pytest.mark.parametrize("few", [64, 2])
def test_near_copies_by_few_and_many(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(18)
    base = prose(rng, 60).split()
    texts = corpus(4) + [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 60, 2)]
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in ngram_join.joined(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == near(texts)


def test_a_chain_sends_sets_a_few_times(spark, monkeypatch):
    """1,000 texts, each similar by about 0.6 to the next one: one component, and hardly any link."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 16)
    placed, sent = ngram_join.placed, []

    def counted(near, members):
        out = placed(near, members)
        sent.append((out.count(), members.agg({"blocks": "max"}).first()[0], members.count()))
        return out

    monkeypatch.setattr(ngram_join, "placed", counted)
    w = [f"w{k}" for k in range(25 * 1000 + 100)]
    rows = ngram_join.joined(frame(spark, [" ".join(w[25 * k : 25 * k + 104]) for k in range(1000)])).collect()
    assert {r.n_links for r in rows} == {0} and len(rows) == 1000
    ((rows, blocks, members),) = sent
    assert blocks > 8 and rows < 7 * members  # to all blocks of its component, a set would be sent 10 times and more


def test_near_copies_of_odd_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, ""), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id, r.n_links, r.group_id) for r in ngram_join.joined(docs).collect() if r.class_id is not None)
    assert got == [(-1, 3, 2, 3), (3, 3, 2, 3), (3, 3, 2, 3), (4, 4, 0, 4), (4, 4, 0, 4)]
    assert ngram_join.joined(docs.limit(0)).collect() == []


def test_leaks(spark, monkeypatch):
    rng = random.Random(12)
    items = [prose(rng, n, 5000) for n in (3, 5, 8, 14, 20, 21, 30, 37, 59, 140, 300)] + [None, "", "one two three four"]
    texts = corpus(3)
    for k, item in enumerate(items):
        w = words(item)
        if w:
            texts.append(prose(rng, 400 * (k % 3)) + " " + " ".join(w) + " " + prose(rng, 700))
            w[len(w) // 2] = "changed"
            texts.append(prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 50))
    texts += [items[0], prose(rng, 20000, 5000) + " " + items[4], items[5] + " " + items[6]]
    docs = frame(spark, texts)
    table = spark.createDataFrame([*enumerate(items), (4, items[4])], "item_id long, text string").withColumnRenamed("lang", "x")
    want = Counter()
    for d, t in enumerate(texts):
        has = shingles(t)
        for i, item in [*enumerate(items), (4, items[4])]:
            s = shingles(item)
            if s and len(s & has) >= 0.8 * len(s):
                want[d, i, len(s), len(s & has)] += 1
    assert sum(want.values()) > 15
    for block in (20_000, 3):
        monkeypatch.setattr(leaks, "BLOCK_ITEMS", block)
        got = leaks.leaks(docs, table).collect()
        assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got) == want
    kept = {r.doc_id for r in leaks.kept(docs, table).collect()}
    assert kept == set(range(len(texts))) - {d for d, *_ in want}
    assert leaks.leaks(docs.limit(0), table).collect() == [] == leaks.leaks(docs, table.limit(0)).collect()


def test_leaks_of_short_items():
    rng = random.Random(31)
    items = [prose(rng, n, 100_000) for n in range(1, 25) for _ in range(25)]
    texts = items + [" ".join([prose(rng, 200), t, prose(rng, 200)]) for t in items]
    few = leaks.Items(list(range(len(items))), items)
    got = {(t, i, n, both) for t, i, n, both in leaks.verified(leaks.Shingles(texts), few, 0.8)}
    sets = [shingles(t) for t in items]
    want = set()
    for t, text in enumerate(texts):
        has = shingles(text)
        want |= {(t, i, len(s), len(s & has)) for i, s in enumerate(sets) if len(s & has) >= 0.8 * len(s)}
    assert len(want) >= 1100 and got == want
    # scattered, and at any threshold
    one = words(items[-200])
    apart = " ".join([*one[:9], prose(rng, 100), *one[5:]])
    for threshold in (0.1, 0.5, 0.8, 1.0):
        some = leaks.Items([7], [items[-200]], threshold)
        for text in (apart, " ".join(one[:8]), items[0]):
            share = len(sets[-200] & shingles(text)) / len(sets[-200])
            assert len(list(leaks.verified(leaks.Shingles([text]), some, threshold))) == (share >= threshold)
