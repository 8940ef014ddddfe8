import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakevault.llm import shards, suffixes
from lakevault.llm.suffixes import common_prefixes, deduplicated, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text("ab", max_size=300).map(str.encode), st.tuples(st.binary(min_size=1, max_size=4), st.integers(1, 80)).map(lambda x: x[0] * x[1])))
def test_suffix_array_and_common_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    before, common = common_prefixes(text, order)
    for i, (b, c) in enumerate(zip(before.tolist(), common.tolist(), strict=True)):
        if b >= 0:
            x, y = data[i:], data[b:]
            assert c == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        else:
            assert c == 0


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text, by counting all strings."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    words = ["".join(chr(rng.integers(97, 110)) for _ in range(rng.integers(2, 9))) for _ in range(400)] + ["é", "日本"]
    prose = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    passages = [prose(40) for _ in range(4)]
    texts = [None, "", " ", "x", passages[0]]
    for k in range(60):
        texts.append(prose(int(rng.integers(1, 120))) + " " + passages[k % 4] + " " + prose(int(rng.integers(1, 60))))
    return texts + texts[5:12] + [prose(200) for _ in range(20)] + ["a" * 700, "ab" * 500]


@pytest.mark.parametrize(("shard", "fan", "keys"), [(1 << 20, 512, 1 << 19), (3000, 512, 1 << 19), (3000, 2, 100), (1 << 14, 3, 40)])
def test_against_all_strings(spark, monkeypatch, shard, fan, keys):
    """With shards of 3,000 bytes, each of four passages is in a quarter of nearly all documents; with a fan of 2 the tree has many levels."""
    texts = corpus(np.random.default_rng(5))
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(shards, "FAN", fan)
    monkeypatch.setattr(shards, "NODE_KEYS", keys)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[7], "x")], "doc_id long, text string, n_bytes string").repartition(3)
    rows = {r.doc_id: r for r in deduplicated(docs, length=64).collect()}
    want = brute([*texts, texts[7]], 64)
    assert len(rows) == len(texts) + 1
    for k, w in zip([*range(len(texts)), None], want, strict=True):
        r = rows[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, k


def test_long_text_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    long = "".join(chr(x) for x in rng.integers(97, 123, 40_000))
    texts = [long, long[10_000:30_000], "q" + long[39_000:], "".join(chr(x) for x in rng.integers(97, 123, 5000))]
    monkeypatch.setattr(suffixes, "ARRAY", 7000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # the workers have the module's own limit; pieces are tested in this process
    x = suffixes.Pieces.__new__(suffixes.Pieces)
    shard = type("S", (), {"buf": np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8).copy(), "begin": None, "end": None})()
    lens = np.array([len(t) for t in texts])
    shard.begin = np.cumsum(lens + 1) - lens - 1
    shard.end = shard.begin + lens
    suffixes.Pieces.__init__(x, shard, 200)
    assert len(x.cuts) > 5
    first, last, _ = x.stretches()
    covered = np.zeros(len(shard.buf), bool)
    for a, b in zip(first, last, strict=True):
        assert not covered[a : b + 1].any()
        covered[a : b + 1] = True
    assert (covered == x.room).all()
    rows = sorted(deduplicated(docs).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts, 200)


def test_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
