"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lakevault.llm.common import new_path
from tests.llm.helpers import corpus, near, prose, shingles, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [prose(rng, n, 4000) for n in (12, 25, 40)]
    texts = corpus(7) + [prose(rng, 80) for _ in range(60)]
    texts += [prose(rng, 30) + " " + items[k % 3] + " " + prose(rng, 90) for k in range(6)]
    toxic = {}
    for k, t in enumerate(texts):
        if t and k % 5 == 0 and len(t.split()) > 20:
            w = t.split()
            for term in ("blockhead", "nitwit", "dunderhead"):
                w.insert(rng.randrange(len(w)), term)
            texts[k] = " ".join(w)
            toxic[k] = 1
    for k in range(400):  # what is learned from
        bad = k % 3 == 0
        w = prose(rng, 30, 3000).split()
        texts.append(" ".join(w[:15] + (["blockhead", "nitwit", "dunderhead"] if bad else []) + w[15:]))
        toxic[len(texts) - 1] = int(bad)
    rows = [(k, t, "en", [None, "a", "b", "c"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, None, None, None, None), (40, "another text under an id that was there", "en", "a", 39)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def test_stages(spark, tables):
    d, rows, items = tables
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "mixing"]
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, d).write.parquet(path := new_path(spark, name))
        docs = spark.read.parquet(path)
        kept[name] = [tuple(r) for r in docs.collect()]
        assert name == "mixing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    bad = lambda t: bool({"blockhead", "nitwit", "dunderhead"} & set((t or "").split()))
    assert sorted(map(key, kept["toxicity"])) == sorted(key(r) for r in rows if not bad(r[1]))

    before = kept["toxicity"]
    # by id: repeated rows are one, and of an id's texts in a group one stays
    order = sorted(range(len(before)), key=lambda k: (before[k][0] is None, before[k][0] or 0))
    groups = near([before[k][1] for k in order])
    want = {before[order[g]][0] for k, (_, _, g) in zip(order, groups, strict=True)}
    after = kept["near_duplicates"]
    assert {r[0] for r in after} == want
    assert {key(r) for r in after} <= {key(r) for r in before}
    got = defaultdict(list)
    for r in after:
        got[r[0]].append(r)
    assert all(len(x) == 1 for x in got.values())

    split = [words(r[1]) for r in after]
    count = defaultdict(int)
    for w in split:
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] += 1
    want = []
    for r, w in zip(after, split, strict=True):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone:
            want.append(r)
        elif left:
            want.append((r[0], left, r[2], r[3], len(left)))
    assert len(want) < len(after) or any(a != b for a, b in zip(want, after, strict=True))
    assert sorted(map(key, kept["substring_dedup"])) == sorted(map(key, want))

    leaks = [shingles(t) for t in items]
    clean = [r for r in kept["substring_dedup"] if not any(len(s & shingles(r[1])) >= 0.8 * len(s) for s in leaks)]
    assert len(clean) < len(kept["substring_dedup"])
    assert sorted(map(key, kept["decontamination"])) == sorted(map(key, clean))

    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for doc_id, source, n, source_size, goal, copies, took in kept["mixing"]:
        size[source] += n
        taken[source] += took
        target[source] = goal
        largest[source] = max(largest[source], n)
        assert took == copies * n and copies <= 3 and (doc_id is None or source_size > 0)
    assert len(kept["mixing"]) == len(clean)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) < largest[s] for s in target)


def test_run(spark, tables):
    rows = cp.run(spark, tables[0])
    assert rows.count() > 100 and rows.columns[:2] == ["doc_id", "source"]


def test_texts_that_share_an_id_are_no_copies(spark):
    rng = random.Random(5)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    near_a, near_c = [" ".join([*t.split()[:-1], "changed"]) for t in (a, c)]
    rows = [(40, a), (40, b), (41, near_a), (40, b), *((None, prose(rng, 20)) for _ in range(30)), (None, c), (None, c), (None, near_c), (7, ""), (7, " "), (7, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()]
    heads = [r for r in got if r[1] in (c, near_c)]
    assert len(heads) == 1
    gone = {(41, near_a), (None, c), (None, near_c)}
    assert sorted(map(key, got)) == sorted(map(key, [*set(rows) - gone, *heads]))


def test_stages_keep_extra_columns(spark, tables):
    d, rows, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 150 OR doc_id IS NULL")
    names = ["id", "hash", "least", "n_words", "kept_sha256", "row", "n", "number"]
    more = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names), F.create_map(F.lit("k"), F.lit("v")).alias("salt"))
    for name, stage in cp.STAGES[:-1]:
        plain = sorted(key(r) for r in stage(spark, docs, d).collect())
        got = stage(spark, more, d)
        assert got.columns == more.columns, name
        got = got.collect()
        assert sorted(key(r[:5]) for r in got) == plain, name
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in got for n in names), name
    assert sorted(map(key, cp.mix_sources(spark, more, d).collect())) == sorted(map(key, cp.mix_sources(spark, docs, d).collect()))


def test_stages_of_empty_tables(spark, tables, tmp_path):
    d = tables[0]
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 20")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [] == stage(spark, docs.limit(0), d).collect()
    for stage in (cp.drop_toxic, cp.drop_leaks):  # nothing to learn, nothing to look for
        assert sorted(map(key, stage(spark, docs, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))
    assert cp.run(spark, str(tmp_path)).collect() == []
