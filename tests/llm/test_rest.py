import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakevault.llm import chat, embeddings, toxicity, urls, warc
from lakevault.llm import components as cc
from lakevault.llm.common import met, new_path
from tests.llm.helpers import components, frame, prose

# --- chat


def told(spark, rows):
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    read = chat.parsed(chat.render(chat.messages(events)))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.formatted) for r in read.collect()}


def test_deltas_edits_and_regenerations(spark):
    m = "message"
    rows = [
        (1, 1, 0, m, "user", "hi"), (1, 2, 1, m, "assistant", ""), (1, 3, 1, "delta", None, "Hel"), (1, 4, 1, "delta", None, "lo"),
        (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "Good "), (1, 7, 1, "delta", None, "day"), (1, 8, 2, m, "user", "bye"),
        (2, 1, 0, m, "user", "first"), (2, 2, 1, m, "assistant", "gone"), (2, 3, 0, "edit", "user", "second"), (2, 4, 1, m, "assistant", "kept"),
        (3, 1, 5, "delta", "tool", "a b"), (3, 1, 5, "delta", "tool", "a c"), (4, 1, 0, m, None, None), (None, 1, 0, m, "user", "x"),
        (5, 1, 0, m, "user", "same"), (5, 1, 0, m, "user", "same"), (6, 9, 1, m, "user", "late"), (6, 3, 2, m, "user", "early"),
    ]
    random.Random(1).shuffle(rows)
    got = told(spark, rows)
    assert got[1][0] == [("user", "hi"), ("assistant", "Good day"), ("user", "bye")]
    assert got[1][1] == "[INST]hi[/INST]<s>Good day</s>[INST]bye[/INST]"
    assert got[2][0] == [("user", "second"), ("assistant", "kept")]
    assert got[3][0] == [("tool", "a ba c")]
    assert got[4][0] == [("", "")] and got[None][0] == [("user", "x")]
    assert got[5][0] == [("user", "same")] * 2
    assert got[6][0] == [("user", "late"), ("user", "early")]
    assert told(spark, [(1, 1, 1, m, "user", "x")])[1][0]


def test_ties_do_not_depend_on_order(spark):
    rows = [(1, 1, 0, "message", "user", "a"), (1, 2, 1, "message", "assistant", "b"), (1, 2, 0, "edit", "user", "c"), (1, 2, 1, "delta", "assistant", "b"), (1, 3, 1, "delta", "assistant", "d"), (1, 3, 1, "edit", "assistant", "d"), (1, 3, 0, "regenerate", None, None), (1, None, None, "message", None, "x")]
    got = set()
    for k in range(6):
        random.Random(k).shuffle(rows)
        got.add(str(told(spark, rows)))
    assert len(got) == 1


CONTROL = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:a]", "[/ROLE]", "\\", "[", "<", "/", "s>", "\n", "$1", "é", "x "]), max_size=8).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool x]", "[INST]", ""]), CONTROL), min_size=20, max_size=40))
def test_any_text_comes_back(spark, turns):
    rows = [(1, k, k, "message", r, t) for k, (r, t) in enumerate(turns)]
    assert told(spark, rows)[1][0] == turns


def test_empty_log_and_long_text(spark):
    empty = spark.createDataFrame([], "conv_id long, seq long, turn long, kind string, role string, text string")
    assert chat.digests(chat.parsed(chat.render(chat.messages(empty)))).collect() == []
    long = "[INST] ok </s> " * 40_000
    assert told(spark, [(1, 0, 0, "message", "assistant", long)])[1][0] == [("assistant", long)]


# --- components


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, links):
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(41, links)
    assert got == {x: want[x] for p in links for x in p if p[0] != p[1]}


def test_components_of_a_path_a_star_and_words(spark, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK", 4)
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [*zip(order, order[1:], strict=False), *((1000, 1000 + k) for k in range(1, 200)), (None, 3), (4, None)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == {x: 0 for x in range(n)} | {1000 + k: 1000 for k in range(200)}
    got = {r.node: r.root for r in cc.components(spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "y")], "a string, b string"), "string").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_a_hub_is_split(spark):
    """Of 30,000 edges, a third at one node: no task joins more than a few times the mean."""
    n, hub = 30_000, 10**6
    edges = spark.range(n).select(F.when(F.col("id") % 3 == 0, hub).otherwise(F.col("id")).alias("a"), (F.col("id") + n).alias("b"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    facts = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    parts = met(both, facts, "u", "v", n).repartition(16, "u", "v")
    assert sorted(parts.collect()) == sorted(both.join(facts.drop("n"), "u").collect())
    salted = met(both, facts, "u", "v", n).withColumn("of", F.pmod(F.xxhash64("v"), F.lit(64))).where(F.col("u") == hub).groupBy("of").count()
    assert salted.agg({"count": "max"}).first()[0] < n / 3 / 30
    links = [(r.a, r.b) for r in edges.where("b < 33000").collect()]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots: dict = {}
    for a, b in links:
        roots[a] = min(roots.get(a, a), b, a)
    assert got == {x: roots[a] for a, b in links for x in (a, b)}


def test_nodes_with_many_edges_are_dealt_out(spark, monkeypatch):
    """A node with many larger and many smaller neighbours is in no window whole, and components are the same."""
    for name, value in (("BLOCK", 4), ("LEAST", 12), ("SALTS", 4)):
        monkeypatch.setattr(cc, name, value)
    links = [*((500, k) for k in range(400, 480)), *((500, k) for k in range(600, 700)), (699, 499), (499, 480), (900, 901), (901, 902)]
    links += [(k, 600 + k % 100) for k in range(1000, 1100)]
    random.Random(3).shuffle(links)
    edges = spark.createDataFrame([(max(x), min(x)) for x in links], "u long, v long")
    done, hot = cc.surveyed(edges)
    assert not done and {tuple(r) for r in hot.collect()} == {(500, 400, True)}
    larger = cc.large_star(edges, hot).collect()
    assert len(larger) == len(links) and all((r.u, 400) in {tuple(x) for x in larger} for r in edges.where("v = 500").collect())
    # one of each window; 499 is what 699 tells its neighbour 500
    assert len({r.v for r in cc.small_star(edges, hot).where("u = 500").collect()} - {499}) == 4
    got = {r.node: r.root for r in cc.components(edges.repartition(8)).collect()}
    assert got == {x: 900 if 900 <= x < 1000 else 400 for p in links for x in p}


# --- urls


def test_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "https://a.example.org/es/1", ""), (2, "http://EXAMPLE.ORG/en/12?x#y", None), (3, "http://example.org/en/2", ""), (4, "http://notexample.com/fr", ""),
        (5, "http://m.COM/de/x", ""), (6, None, ""), (7, "no scheme", ""), (8, "http://b.net/q", link("http://m.com/de/x")),
        (9, "http://c.net/old", '<META HTTP-EQUIV=refresh CONTENT="0; URL=/new">'), (10, "http://c.net/new", link("http://b.net/q#part")), (11, "http://d.org/x", link("http://c.net/new")),
        (12, "http://e.net/x", "<a href='http://m.com/de/x'>"), (1, "https://a.example.org/es/1", ""), (13, "https://org?/x", ""), (14, "https://x.org", ""),
        (15, "http://f.net/a/b", link("c")), (16, "http://f.net/a/c", link("//m.com/de/x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == (None, "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("", "", None, "allow") == got[7]
    assert [got[k][3] for k in (8, 9, 10)] == ["block"] * 3
    assert got[11][2:] == ("org/", "allow") and got[12][3] == "allow"
    assert got[13] == ("org", "", None, "allow") and got[14][2] is None
    assert got[15][3] == got[16][3] == "block"
    assert urls.judged(df.limit(0)).collect() == []
    more = spark.createDataFrame([("http://e.net/x", "http://m.com/de/x")], "x string, y string")
    assert {r.page_id: r.verdict for r in urls.judged(df, edges=more).collect()}[12] == "block"


def test_links_of_pages(spark):
    link = '<link rel="{}" href="{}">'.format
    pages = [
        ("http://h.net/x/y/p.html", link("canonical", "../z.html"), "http://h.net/x/z.html"), ("http://h.net", link("canonical", "./s"), "http://h.net/s"),
        ("http://h.net/x/p.html", link("canonical", "?q=1"), "http://h.net/x/p.html?q=1"), ("http://h.net/1", link("canonical", "/a?b=1&amp;c=2"), "http://h.net/a?b=1&c=2"),
        ("http://h.net/2", link("nofollow Canonical", "/t"), "http://h.net/t"), ("http://h.net/3", "<!-- " + link("canonical", "/no") + " -->", None), ("http://h.net/4", link("canonicals", "/no"), None),
        ("http://h.net/5", '<base href="/deep/"><meta content="3;url=\'r\'" http-equiv="Refresh">', "http://h.net/deep/r"), ("http://h.net/6", link("canonical", "http://[bad"), None),
        ("HTTP://H.net/7", link("canonical", "#part"), "http://h.net/7"), ("http://h.net/8", "<script>" + link("canonical", "/no") + "</script>", None),
    ]
    df = spark.createDataFrame([(u, h) for u, h, _ in pages], "url string, html string")
    got = {r.a: r.b for r in urls.links(df).collect()}
    assert got == {("http://h.net/7" if u.startswith("HTTP") else u): to for u, _, to in pages if to}


# --- archives


def test_archives(spark):
    big, same = "<p>" + "é\r\n\r\n" * 60, "s" * 100
    pages = [
        (5, "http://x/a b\r\nc", big), (3, "http://x/2", big), (9, None, big), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", same), (11, "u", same), (10, "u", same),
        (3, "http://x/2", big), (12, "u", "WARC/1.1\r\n\r\n" * 20_000), (13, "u", "t" * 99), (14, "u", "t" * 99),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    path = new_path(spark, "test-warc")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next(h or "" for p, _, h in pages if p == r.page_id)
        ids = [p for p, _, h in pages if (h or "") == html and p is not None]
        original = min(ids) if len(html.encode()) >= 100 else r.page_id
        revisit = r.page_id != original
        assert (r.record_type, r.refers_to) == (("revisit", original) if revisit else ("response", None))
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert r.html == (None if revisit else html)
    assert {r.url for r in got if r.page_id == 5} == {"http://x/a%20b%20%20c"}
    warc.write_archives(df.limit(0), path := new_path(spark, "test-warc"))
    assert warc.read_archives(spark, path).collect() == []


def test_bad_archive():
    import gzip

    for data in (b"WARC/1.0\r\nA: b\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(gzip.compress(data)))


# --- embeddings


def brute(vectors, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = []
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(vectors[k], np.float64) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links.append((i, j))
    return links


def neighbourhoods(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    rows = [c + rng.normal(size=dim) * s for c in centres for s in (0, 0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5)]
    return [np.float32(x).tolist() for x in rows]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_neighbours(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [1.0], [-2.0], [3.0], [1e30] * 16, [1e-30] * 16, [-0.0] * 16]
    vectors = neighbourhoods(240, 16, 3) + odd
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near(df).collect()}
    links = brute(vectors)
    n, group = np.bincount(np.array(links).ravel(), minlength=len(vectors)), components(len(vectors), links)
    for k in range(len(vectors)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n[k], group[k], group[k] == k), k


def test_neighbours_of_odd_rows(spark):
    v = [1.0] * 8
    df = spark.createDataFrame([(2, v), (2, v), (None, v), (5, [-1.0] * 8), (None, None)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near(df).collect()) == [(0, 0, 0, True), (0, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (5, 0, 5, True)]
    assert embeddings.near(df.limit(0)).collect() == []


def test_rotations_keep_angles_and_plans_grow():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(embeddings.hadamard(x) @ embeddings.hadamard(x).T, 16 * x @ x.T)
    assert embeddings.plan(10, 64)[0] == 1 and embeddings.plan(10**7, 64)[0] == 2 and embeddings.plan(10**9, 64)[0] == 3
    many = embeddings.codes(embeddings.unit_rows([v.tobytes() for v in x]), 3, 2, 4)
    assert many.shape == (5, 3, 4) and many.max() < 32**2 and all(len(set(many[i, t])) == 4 for i in range(5) for t in range(3))


def test_recall_beyond_one_part():
    """Of pairs just over the threshold, a plan for many vectors misses few."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(2000, 64))
    b = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    for parts in (1, 2):
        tables = embeddings.plan(1024 * 128**parts, 64)[1]
        x, y = embeddings.codes(a, tables, parts), embeddings.codes(b, tables, parts)
        assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.98


# --- toxicity


def edits(a, b):
    """Least number of letters put in, left out, changed, or swapped with the next (each letter in one edit)."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=5), st.text("abcx", max_size=8), st.integers(0, 2))
def test_automaton(terms, word, k):
    match = toxicity.Automaton(terms, k).match(word)
    least = min(edits(t, word) for t in terms)
    assert (match is not None) == (least <= k)
    if match:
        assert match[0] == least == edits(match[1], word)


def test_context_and_misspellings():
    x = toxicity.Lexicon({"idiot": 3.0, "worthless": 3.0, "vequ*": 3.0}, ["idion"])
    x.ready()
    score = lambda t: x.score(t)[0]
    assert score("") == 0 == score("a fine day") and score("You IDIOT!") >= 0.7
    assert 0 < score("you idoit") < 0.7 <= score("you 1diot, wor7hles person")
    assert score("an idion here") == 0 and score("les vequoi") >= 0.7
    assert score('they said "you idiot" and left') < 0.3 < score("they said you idiot and left")
    assert score('he said "hello there" you idiot, "go away"') >= 0.7


def test_learns_and_holds_out(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = prose(rng, 60, 3000).split()
        if bad:
            for t in rng.sample(["blockhead", "nitwit", "zorgal", "zorgun", "zorgim"], 3):
                w.insert(rng.randrange(len(w)), t if rng.random() < 0.9 else t[:3] + t[4:])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = frame(spark, [*texts, None, ""]).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(k, t, 0) for k, t in enumerate(toxic)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity.judged(docs, labels).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held and r.doc_id < 600]
    assert len(rows) == 602 and 150 < len(held) < 260
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.score for r in rows if r.doc_id >= 600} == {0.0}
    none = toxicity.judged(docs, labels.limit(0)).collect()
    assert len(none) == 602 and {r.score for r in none} == {0.0}
    assert toxicity.judged(docs.limit(0), labels).collect() == []


def test_sf_accuracy(spark):
    """Held-out accuracy on the small table."""
    import os

    from lakevault.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    rows = QUERIES["op1_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.94


def test_misspelt_inflections_and_short_terms(spark):
    x = toxicity.Lexicon({"idiot*": 3.0, "scum": 3.0}, ["scam"], ["idiot", "idiots", "idiotic"])
    x.ready()
    weights = {w: x.judge(w) for w in ("idiots", "idiotas", "idoit", "ideot", "idoits", "idoitic", "scmu", "skum", "scm", "scam", "idle", "sc")}
    full, less = 3.0, toxicity.MISSPELT * 3.0
    assert weights == {"idiots": full, "idiotas": full, "idle": 0, "scam": 0, "sc": 0} | dict.fromkeys(["idoit", "ideot", "idoits", "idoitic", "scmu", "skum", "scm"], pytest.approx(less))
    # learned, end to end: a term with inflections, and a short one
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(400):
        w = prose(rng, 40, 2000).split()
        if k % 3 == 0:
            w[7:7] = [rng.choice(["dunder", "dunders", "dunderish"]), "zorg"]
        texts.append(" ".join(w))
        labels.append((k, int(k % 3 == 0)))
    plain = prose(rng, 40, 2000).split()
    texts += [" ".join([*plain[:9], *bad, *plain[9:]]) for bad in (["dudner", "dundrish"], ["zrog", "dunbers"], ["zorge", "xorg"], [])]
    rows = {r.doc_id: r for r in toxicity.judged(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 400").collect()}
    assert [(rows[k].n_hits, rows[k].predicted) for k in range(400, 404)] == [(2, 1)] * 3 + [(0, 0)]


def test_rare_sure_terms_among_many_common_words(spark):
    # 60,000 words of 3 digits' length and more that 12 of 20 toxic documents hold come before a term that only 9 hold
    common = " ".join(f"{k:05d}x" for k in range(60_000))
    texts = [common + (" zorgul" if k < 9 else "") if k < 12 else f"other{k} zebra{k}" for k in range(20)] + [f"plain{k} words here" for k in range(160)] + [common] * 12
    rng = random.Random(3)
    texts = [t + " " + prose(rng, 30, 10**6) for t in texts]
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(len(texts))], "doc_id long, toxic int")
    docs = frame(spark, texts)
    whole = lambda rows: rows
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "without_copies", whole)  # the common words make near copies
        terms = toxicity.learn(docs, labels).terms
    assert any("zorgul".startswith(t.rstrip("*")) for t in terms)
    counts = spark.createDataFrame([("a", 9, 0), ("b", 2, 0), ("c", 6, 5), ("d", 9, 5), ("e", 3, 0)], "feature string, p long, q long")
    assert [r.feature for r in toxicity.telling(counts, 100, 900).collect()] == [f for f, p, q in counts.collect() if p >= 3 and p / (p + q) >= toxicity.PRECISION and toxicity.evidence(p, q, 100, 900) >= toxicity.EVIDENCE]


def test_only_verified_copies_are_left_out(spark):
    rng = random.Random(6)
    shared = prose(rng, 40, 10**6)
    texts = [f"{shared} {prose(rng, 40, 10**6)}" for _ in range(40)]
    copy = texts[0].split()
    copy[60] = "changed"
    rows = [(k, int(k % 2), t) for k, t in enumerate(texts)] + [(40, 0, " ".join(copy)), (41, 1, texts[0]), (42, 2, texts[0]), (43, 0, ""), (44, 0, "")]
    left = toxicity.without_copies(spark.createDataFrame(rows, "id long, toxic int, text string")).collect()
    assert sorted(r.id for r in left) == [*range(40), 41, 43, 44]
