import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakevault.engine import Engine
from lakevault.functions import cipher, gear
from lakevault.functions.digests import EMPTY, ancestors, base_name, iso_time, normal_path, parent, units, version_digest
from lakevault.operators import changes, chunking, store, trees
from lakevault.operators.cache import looked_up
from lakevault.sources.tables import byte_range, folder, scan_counts

# --- chunker


@given(st.integers(0, 100), st.integers(0, 100))
def test_distribute(ones, width):
    assert gear.distribute(ones, width).bit_count() == min(ones, width, 64)


def test_known_values():
    assert gear.gear_table()[:2] == (10193714898394695666, 11002174208600951934)
    c = gear.GearConfig()
    assert (c.strict, c.loose) == (0x92494924A492, 0x888911222444)
    assert (c.min_size, c.max_size, c.hard_limit) == (8192, 131072, 262144)
    with pytest.raises(ValueError):
        gear.GearConfig(4, 8)


CONFIG = st.builds(gear.GearConfig, st.integers(0, 3), st.integers(8, 16))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=32), max_size=50), CONFIG)
def test_chunks(pieces, config):
    data = b"".join(pieces)
    spans = gear.boundaries(data, config)
    assert spans == gear.boundaries_by_byte(data, config)
    assert b"".join(data[a:b] for a, b in spans) == data
    assert all(b - a <= config.hard_limit for a, b in spans)
    assert all(b - a >= config.min_size for a, b in spans[:-1])


@pytest.mark.parametrize("config", [gear.GearConfig(2, 256), gear.GearConfig(0, 100), gear.GearConfig(2, 4096)])
def test_chunks_of_long_inputs(config):
    for data in (random.Random(1).randbytes(300_000), b"\0" * 50_000, b"ab" * 40_000, random.Random(2).randbytes(99) * 900):
        assert gear.boundaries(data, config) == gear.boundaries_by_byte(data, config)


@given(st.lists(st.binary(max_size=80), max_size=20), st.integers(2, 257))
def test_compact(pieces, n):
    out = gear.compact(pieces, n)
    assert b"".join(out) == b"".join(pieces)
    assert all(len(x) == n for x in out[:-1]) and all(0 < len(x) <= n for x in out)


def test_chunk_column_equals_kernel(spark):
    data = [b"", None, b"x" * 100, random.Random(3).randbytes(20_000)]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, content binary")
    got = {r.k: [(x.begin, x.end) for x in r.c] for r in df.select("k", gear.chunk_column(F.col("content"), gear.GearConfig(2, 256)).alias("c")).collect()}
    assert got == {k: gear.boundaries(d or b"", gear.GearConfig(2, 256)) for k, d in enumerate(data)}


# --- scalar functions


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c",), ("x",)], "p string")
    rows = df.select(ancestors(F.col("p")), base_name(F.col("p")), parent(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(["", "a", "a/b"], "c", "a/b"), ([""], "x", "")]
    paths = spark.createDataFrame([(".",), ("./a/",), ("a//",), ("",)], "p string").select(normal_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["", "a", "a", ""]


def test_times_and_units(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:00.250Z",), ("2024-01-02T03:04:50.000010Z",)], "t string")
    assert [r[0] for r in df.select(iso_time(F.to_timestamp("t"))).collect()] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:00.25Z", "2024-01-02T03:04:50.00001Z"]
    one = df.limit(1).select(version_digest(F.to_timestamp("t"), F.lit("ab" * 32))).first()[0]
    assert one == "deda5b883d9b5d25598cc69232c95afb755cc0effa0c474188cd545b3cb9b180"
    sizes = spark.createDataFrame([(0.0,), (1023.0,), (1024.0,), (5.5 * 1024**3,)], "n double")
    assert [r[0] for r in sizes.select(units(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.00 KiB", "5.50 GiB"]


def test_byte_range_and_counts(spark):
    df = spark.createDataFrame([("a/b/x", b"0123456789"), ("a/y", b"01")], "path string, content binary")
    assert [bytes(r[0]) for r in df.select(byte_range(F.col("content"), F.lit(1), F.lit(3))).collect()] == [b"123", b"1"]
    assert tuple(scan_counts(df).first()) == (2, 3)
    assert tuple(scan_counts(df.limit(0)).first()) == (0, 1)


# --- cipher


def test_counter_mode(spark):
    """NIST SP 800-38A, F.5.1."""
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    stream = spark.range(1).select(cipher.keystream(F.lit(0).cast("long"), F.lit(16).cast("long"), key)).first()[0]
    assert len(stream) == 16
    data = [b"", b"a", b"x" * 16, random.Random(4).randbytes(1000)]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k long, content binary")
    sealed = df.withColumn("s", cipher.ctr(F.col("content"), F.col("k") * 100, key))
    back = sealed.select("k", "s", cipher.ctr(F.col("s"), F.col("k") * 100, key).alias("b")).collect()
    assert [bytes(r.b) for r in back] == data and bytes(back[3].s) != data[3]


def test_first_block_of_the_published_vector(spark):
    key, block = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    out = spark.range(1).select(F.substring(F.aes_encrypt(F.lit(block), F.lit(key), F.lit("ECB"), F.lit("PKCS")), 1, 16)).first()[0]
    assert bytes(out).hex() == "ec8cdf7398607cb0f2d21675ea9ea1e4"


def test_passwords(spark):
    key = cipher.new_key()
    wrapped = cipher.wrap(spark, b"one", key)
    assert cipher.unwrap(spark, b"one", wrapped) == key and len(wrapped.verify) == 4
    with pytest.raises(PermissionError):
        cipher.unwrap(spark, b"two", wrapped)
    assert cipher.unwrap(spark, b"two", cipher.rewrap(spark, b"one", b"two", wrapped)) == key


def test_counters_do_not_overlap(spark):
    rows = [("chunk", f"{k:04x}", random.Random(k).randrange(0, 200)) for k in range(500)]
    got = cipher.allotted(spark.createDataFrame(rows, "kind string, digest string, size long"), 7).collect()
    spans = sorted((r.counter, r.counter + -(-r.size // 16)) for r in got if r.size)
    assert spans[0][0] == 7 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


# --- changes


def fold(rows):
    """The last change of each path, without those below another; by brute force, segment by segment."""
    last = {p: (k, a) for _, p, k, a in sorted(rows)}
    above = lambda p: [p[:i] for i in range(len(p)) if p[i] == "/"] + ([""] if p else [])
    return {p: c for p, c in last.items() if not any(x in last for x in above(p))}


CHANGES = st.lists(st.tuples(st.lists(st.sampled_from(["a", "ab", "b"]), min_size=1, max_size=4).map("/".join), st.sampled_from(["remove", "new", "fresh"])), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None)
@given(CHANGES)
def test_normal_form(spark, found):
    rows = [(k, p, kind, None if kind == "remove" else f"/x/{p}") for k, (p, kind) in enumerate(found)]
    df = spark.createDataFrame(rows, "seq long, path string, kind string, local_path string")
    assert {r.path: (r.kind, r.local_path) for r in changes.normalised(df).collect()} == fold(rows)


def test_parse(spark):
    lines = ["  a/b remove", "a/c new /x/y", "", "d fresh /z  ", "   "]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    assert [tuple(r) for r in changes.parsed(df).collect()] == [(0, "a/b", "remove", None), (1, "a/c", "new", "/x/y"), (3, "d", "fresh", "/z")]
    for bad in ("a remove /x", "a new", "a move /x", "a new x", "/a remove"):
        with pytest.raises(Exception, match="not a change"):
            changes.parsed(spark.createDataFrame([(0, bad)], "seq long, value string")).collect()


# --- the store


def files(spark, contents):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")


def tree(seed, n=40):
    rng = random.Random(seed)
    names = ["a", "ab", "b", "c c"]
    blocks = [rng.randbytes(700) for _ in range(6)]
    out = {}
    for k in range(n):
        out["/".join(rng.choice(names) for _ in range(rng.randint(0, 3))) + f"/f{k}"] = b"".join(rng.choice(blocks) for _ in range(rng.randint(0, 4)))
    return {p.lstrip("/"): c for p, c in out.items()}


CUT = gear.GearConfig(2, 256)
T1, T2 = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"


def test_backup_and_restore(spark):
    content = tree(1)
    run = store.backup(files(spark, content), T1, CUT)
    root = run.dirs.where("path = ''").select("tree_digest")
    assert {r.path: bytes(r.content) for r in store.restored(run.store, root).collect()} == content
    assert store.corrupt(run.store).collect() == []
    listed = {r.path for r in trees.listing(run.store.tree_entries, root).where("kind = 'file'").collect()}
    assert listed == {f"/{p}" for p in content}
    p = next(p for p in content if "/" in p)
    hit = trees.search(run.store.tree_entries, root, p).first()
    assert hit.kind == "file" and hit.digest == run.files.where(F.col("path") == p).first().file_digest
    assert trees.search(run.store.tree_entries, root, "no/where").collect() == []


def test_empty_backup(spark):
    run = store.backup(files(spark, {"x": b""}).limit(0), T1, CUT)
    assert run.dirs.collect()[0].tree_digest == EMPTY
    assert store.corrupt(run.store).collect() == []


def test_same_directories_share_a_tree(spark):
    run = store.backup(files(spark, {"x/1": b"a", "y/1": b"a", "z/1": b"b", "e": b""}), T1, CUT)
    assert run.dirs.count() == 4 and run.store.trees.count() == 3 and run.store.files_obj.count() == 3


def test_garbage(spark):
    a, b = (store.backup(files(spark, tree(k)), t, CUT).store for k, t in ((1, T1), (2, T2)))
    s = a.plus(b)
    only = store.Store(s.chunks, s.file_chunks, s.files_obj, s.trees, s.tree_entries, b.versions)
    kept = store.collected(only).digests().collect()
    assert sorted(kept) == sorted(b.digests().collect())
    assert store.garbage(s, store.live(s)).collect() == []
    with pytest.raises(store.NoVersions):
        store.collected(store.Store(s.chunks, s.file_chunks, s.files_obj, s.trees, s.tree_entries, s.versions.limit(0)))


def test_patch_equals_full_build(spark):
    before = tree(3)
    rng = random.Random(9)
    after, rows = dict(before), []
    for p in sorted(before):
        x = rng.random()
        if x < 0.15:
            del after[p]
            rows.append((p, "remove", None))
        elif x < 0.3:
            after[p] = rng.randbytes(500)
            rows.append((p, "fresh", f"/l/{p}"))
    after |= {"top": b"t", "new/deep/f": b"n"}
    rows += [("top", "new", "/l/top"), ("new", "new", "/l/new"), ("no/dir/x", "new", "/l/top"), ("gone", "fresh", "/l/top")]
    run, full = (store.backup(files(spark, c), T1, CUT) for c in (before, after))
    local = full.files.select(F.concat(F.lit("/l/"), "path").alias("local_path"), "file_digest")
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, path string, kind string, local_path string")
    normal = changes.normalised(df)
    dirs, _ = changes.patched(run.dirs, run.files, normal, local)
    assert dirs.where("path = ''").first().tree_digest == full.dirs.where("path = ''").first().tree_digest
    lost = {r.path for r in changes.unmatched(run.dirs, run.files, normal).collect()}
    assert {"no/dir/x", "gone"} <= lost


def test_counters(spark):
    content = {"a": b"x" * 1000, "b": b"x" * 1000, "d/c": b"y" * 10}
    run = store.backup(files(spark, content), T1, 500)
    row = store.statistics(run).first()
    assert (row.processed_file_count, row.new_file_count, row.processed_dir_count, row.processed_chunk_count, row.new_chunk_count, row.uploaded_bytes) == (3, 2, 2, 5, 2, 500 + 16 + 10 + 16)
    again = store.statistics(run, run.store).first()
    assert (again.new_file_count, again.new_dir_count, again.new_chunk_count, again.uploaded_bytes) == (0, 0, 0, 0)


def test_cache(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, 9), ("b", 2, 1, 5, 9)], "path string, inode long, device long, mtime long, size long")
    known = spark.createDataFrame([("v", 1, 1, 5, 9, "f")], "version_digest string, inode long, device long, mtime long, size long, file_digest string")
    assert {r.path: r.file_digest for r in looked_up(df, known).collect()} == {"a": "f", "b": None}


def test_new_objects(spark):
    new = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "chunk_digest string, size int")
    old = spark.createDataFrame([("b",)], "chunk_digest string")
    assert [tuple(r) for r in chunking.new_objects(new, old, "chunk_digest").collect()] == [("a", 1)]


# --- commands


@pytest.mark.parametrize("password", [None, b"secret"])
def test_engine(spark, tmp_path, password):
    e = Engine.init(spark, str(tmp_path / "repo"), password, CUT)
    with pytest.raises(FileExistsError):
        Engine.init(spark, str(tmp_path / "repo"))
    content = tree(5, 15)
    v1 = e.backup(files(spark, content), T1)
    tree1 = e.store().versions.first().ver_root
    lines = spark.createDataFrame([(0, "added new /l/added")], "seq long, value string")
    local = spark.createDataFrame([("/l/added", bytearray(b"more"))], "local_path string, content binary")
    v2 = e.patch(tree1, lines, local, T2)
    assert [r.version_digest for r in e.versions().collect()] == [v1, v2]
    root2 = e.store().versions.where(F.col("version_digest") == v2).first().ver_root
    assert {r.path: bytes(r.content) for r in e.restore(root2).collect()} == content | {"added": b"more"}
    assert e.integrity_check().collect() == []
    if password:
        raw = {bytes(r.content)[16:] for r in e.store().chunks.collect()}
        assert not raw & {bytes(r.content) for r in e.plain().chunks.collect()}
        with pytest.raises(PermissionError):
            Engine(spark, str(tmp_path / "repo"), b"wrong")
        e.change_password(b"secret", b"other")
        e = Engine(spark, str(tmp_path / "repo"), b"other")
    file = e.find(v2).where("path = '/added'").first().digest
    assert e.cat_file(file) == b"more"
    chunk = e.cat_file_chunks(file).first().chunk_digest
    assert e.cat_chunk(chunk) == b"more"
    assert e.ls(root2).where("level = 1").count() == e.cat_tree(root2).count()
    assert e.gc(dry_run=True).collect() == [] == e.gc().collect()
    (tmp_path / "out").mkdir()
    assert e.restore_to(root2, str(tmp_path / "out")) == len(content) + 1
    again = folder(spark, str(tmp_path / "out"))
    assert {r.path: bytes(r.content) for r in again.collect()} == content | {"added": b"more"}
    with pytest.raises(ValueError):
        e.restore_to(root2, str(tmp_path / "out"))


def test_engine_with_stat_cache(spark, tmp_path):
    e = Engine.init(spark, str(tmp_path / "repo"), cut=CUT)
    stat = lambda rows: spark.createDataFrame(rows, "path string, content binary, inode long, device long, mtime long, size long")
    v1 = e.backup(stat([("a", bytearray(b"one"), 1, 1, 1, 3), ("d/b", bytearray(b"two"), 2, 1, 1, 3)]), T1)
    # a hit is not read again: its new content goes unseen
    v2 = e.backup(stat([("a", bytearray(b"ONE"), 1, 1, 1, 3), ("d/b", bytearray(b"TWO"), 2, 1, 2, 3)]), T2)
    roots = {r.version_digest: r.ver_root for r in e.store().versions.collect()}
    assert {r.path: bytes(r.content) for r in e.restore(roots[v2]).collect()} == {"a": b"one", "d/b": b"TWO"}
    assert {r.path: bytes(r.content) for r in e.restore(roots[v1]).collect()} == {"a": b"one", "d/b": b"two"}


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_gc_and_passwords_free_what_they_say(spark, tmp_path):
    at = tmp_path / "repo"
    e = Engine.init(spark, str(at), b"one", CUT)
    v1 = e.backup(files(spark, {"keep": random.Random(1).randbytes(3000), "go": random.Random(2).randbytes(30_000)}), T1)
    v2 = e.backup(files(spark, {"keep": random.Random(1).randbytes(3000)}), T2)
    before = {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")}
    assert e.gc().collect() == [] and {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")} == before
    full = size_of(at)
    versions = e.store().versions.where(F.col("version_digest") == v2)
    e._write_tables(store.Store(**{t: getattr(e.store(), t) for t in store.SCHEMAS} | {"versions": versions}), ["versions"])
    kinds = {r.kind for r in e.gc().collect()}
    assert kinds == {"tree", "file", "chunk"} and size_of(at) < full - 25_000
    assert e.gc().collect() == [] and e.integrity_check().collect() == []
    root = e.store().versions.first().ver_root
    assert [r.path for r in e.restore(root).collect()] == ["keep"]
    e.change_password(b"one", b"two")
    assert len(list((at / "config").iterdir())) == 1
    with pytest.raises(PermissionError):
        Engine(spark, str(at), b"one")
    assert Engine(spark, str(at), b"two").cat_file(e.find(v2).where("path = '/keep'").first().digest) == random.Random(1).randbytes(3000)
    with pytest.raises(LookupError):
        e.find(v1)


def test_inputs_are_checked(spark, tmp_path):
    e = Engine.init(spark, str(tmp_path / "repo"), cut=CUT)
    v = e.familiar_backup({"etc/x": b"c"}, [("home", files(spark, {"u/f": b"1234"}))], T1)
    for bad in (lambda: e.cat_chunk("x"), lambda: e.find("zz"), lambda: e.find(v, "a/../b"), lambda: e.familiar_backup({}, [("a/b", files(spark, {"x": b""}))]), lambda: e.familiar_backup({}, [("a", spark.range(1))])):
        with pytest.raises(ValueError):
            bad()
    shares = e.find(v, depth=1).where("kind = 'dir' AND level = 1").collect()
    path = next(f"{r.path}home/u/f" for r in shares if not e.lookup(v, f"{r.path}home/u/f").isEmpty())
    assert [tuple(r) for r in e.lookup(v, path).collect()] == [(path, 0o100644, "file", 4)]
    assert e.lookup(v, path + "x").collect() == [] and e.lookup(v, "/").first().kind == "dir"
    assert "Asia/Tokyo 2024" in e.versions(zone="Asia/Tokyo").first().line and "09:00:00" in e.versions(zone="Asia/Tokyo").first().line
    out = store.backup(files(spark, {"../x": b"1"}), T2, CUT)
    e._commit(out.store)
    (tmp_path / "out").mkdir()
    with pytest.raises(ValueError, match="stay below"):
        e.restore_to(out.store.versions.first().ver_root, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_contents_of_new_chunks_only(spark):
    content = {"a": b"x" * 900 + b"y" * 500, "b": b"y" * 500, "c": b""}
    pieces = chunking.chunks(files(spark, content), 100).drop("chunk")
    every = store.contents(files(spark, content), pieces).collect()
    assert sorted(bytes(r.content) for r in every) == [b"x" * 100, b"y" * 100]
    known = pieces.where("path = 'b'").select("chunk_digest")
    assert [bytes(r.content) for r in store.contents(files(spark, content), pieces, known).collect()] == [b"x" * 100]


def test_progress_is_said(spark):
    from lakevault.operators.progress import reported

    said = []
    with reported(spark, said.append, 0.05):
        spark.range(0, 40_000_000, 1, 8).selectExpr("sum(hash(id, sha2(cast(id as string), 256)))").collect()
    assert said and all("tasks" in x for x in said)


def test_familiar(spark, tmp_path):
    e = Engine.init(spark, str(tmp_path / "repo"), cut=CUT)
    v = e.familiar_backup(files(spark, {"etc/x": b"c"}), [("home", files(spark, {"u/f": b"1"})), ("music", files(spark, {"s": b"2"}))], T1)
    assert sorted(r.name for r in e.familiar_shares(v).collect()) == ["home", "music"]
    got = e.familiar_restore(v, [("home", "/a"), ("home", "/b/"), ("none", "/c")]).collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("/b/u/f", b"1")]
    assert e.integrity_check().collect() == []


def test_stream_of_changes(spark, tmp_path):
    from lakevault.streaming.ingest import lines, patches

    e = Engine.init(spark, str(tmp_path / "repo"), cut=CUT)
    e.backup(files(spark, {"a": b"1", "d/b": b"2"}), T1)
    source = tmp_path / "changes"
    source.mkdir()
    (source / "1.txt").write_text("d/b remove\n")
    root = e.store().versions.first().ver_root
    nothing = spark.createDataFrame([], "local_path string, content binary")
    q = patches(e, root, lines(spark, str(source)), lambda _: nothing).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert e.store().versions.count() == 2
    new = e.store().versions.where(F.col("ver_root") != root).first().ver_root
    assert {r.path: bytes(r.content) for r in e.restore(new).collect()} == {"a": b"1"}


def test_streams_start_again(spark, tmp_path):
    from lakevault.streaming.ingest import distinct_chunks, lines, patches

    e = Engine.init(spark, str(tmp_path / "repo"), cut=CUT)
    e.backup(files(spark, {"a": b"1", "b": b"2", "c": b"3"}), T1)
    root = e.store().versions.first().ver_root
    (source := tmp_path / "changes").mkdir()
    nothing = spark.createDataFrame([], "local_path string, content binary")
    for k, name in enumerate("ab"):  # the second run knows nothing but the checkpoint and the repository
        (source / f"{k}.txt").write_text(f"{name} remove\n")
        e = Engine(spark, str(tmp_path / "repo"))
        patches(e, root, lines(spark, str(source)), lambda _: nothing).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    newest = e.versions().collect()[-1].version_digest
    assert [r.path for r in e.find(newest).where("kind = 'file'").collect()] == ["/c"]
    (chunks := tmp_path / "chunks").mkdir()
    for k, rows in enumerate((["x", "y", "x"], ["y", "z"])):
        spark.createDataFrame([(r,) for r in rows], "chunk_digest string").coalesce(1).write.mode("append").json(str(chunks))
        stream = spark.readStream.schema("chunk_digest string").json(str(chunks))
        distinct_chunks(stream, str(tmp_path / "known")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / "known")).count() == 2 + k


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)
