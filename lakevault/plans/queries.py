"""The queries over the snapshot store, by name, and their SQL.

Two snapshots are kept: the documents and conversations, and what a change list makes of them (copies removed, toxic
documents reviewed, the last conversation removed, pages and benchmark new). They are backed up once for a session and a
folder of tables, in fixed chunks where SQL has to follow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.functions import cipher
from lakevault.functions.digests import base_name, digest, entry_line, object_path, parsed_digest, units
from lakevault.functions.gear import GearConfig
from lakevault.operators import cache, changes, chunking, familiar, mount, progress, store, trees, versions
from lakevault.operators.store import Backup, Store
from lakevault.plans import oracle
from lakevault.plans.oracle import STEP, TIMES
from lakevault.session import durable
from lakevault.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Chunks of 256 bytes to 4 KiB around 1 KiB, for texts of this size.
CDC = GearConfig(2, 1024)

_made: dict[tuple, Backup] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files: a backup is kept only as long as these are."""
    p = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)))


def forget() -> None:
    """Lets go of all backups."""
    _made.clear()


def backed_up(spark: SparkSession, sf_dir: str, which: str) -> Backup:
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), which)
    if key not in _made:
        files = (src.snapshot_a if which == "a" else src.snapshot_b)(spark, sf_dir)
        run = store.backup(files, TIMES[which], STEP)
        kept = Store(**{f.name: durable(getattr(run.store, f.name)) for f in fields(Store)})
        _made[key] = replace(run, store=kept)
    return _made[key]


def root(run: Backup) -> DataFrame:
    return run.dirs.where("path = ''").select("tree_digest")


def both(spark: SparkSession, sf_dir: str) -> Store:
    return backed_up(spark, sf_dir, "a").store.plus(backed_up(spark, sf_dir, "b").store)


# --- scans and chunks


@query(oracle.sql("SELECT (SELECT count(*) FROM a_files) AS n_files, (SELECT count(DISTINCT d) FROM (SELECT unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS d FROM a_files)) AS n_dirs"))
def scan_counts(spark, d):
    return src.scan_counts(src.snapshot_a(spark, d))


@query(oracle.sql("SELECT path, sha256(array_slice(content, 17, 64)) AS range_digest FROM a_files"))
def byte_ranges(spark, d):
    """Bytes 16 to 63 of each file."""
    return src.snapshot_a(spark, d).select("path", digest(src.byte_range(F.col("content"), F.lit(16), F.lit(63))).alias("range_digest"))


@query(oracle.sql('SELECT path, ordinal, "begin", "end" FROM a_pieces', oracle.objects("a")))
def fixed_chunk_boundaries(spark, d):
    return chunking.chunks(src.snapshot_a(spark, d), STEP).select("path", "ordinal", "begin", "end")


@query(oracle.sql("SELECT path, ordinal, size, chunk_digest FROM a_pieces", oracle.objects("a")))
def chunk_digests(spark, d):
    return chunking.chunks(src.snapshot_a(spark, d), STEP).select("path", "ordinal", "size", "chunk_digest")


@query(oracle.sql("SELECT * FROM a_objects", oracle.objects("a")))
def file_digests(spark, d):
    files = src.snapshot_a(spark, d)
    return chunking.file_objects(files, chunking.chunks(files, STEP).drop("chunk"))


DEDUP = "SELECT sum(n)::BIGINT AS total_chunks, count(*) AS distinct_chunks, sum(n * size)::BIGINT AS total_bytes, sum(size)::BIGINT AS distinct_bytes FROM (SELECT chunk_digest, count(*) AS n, any_value(size) AS size FROM a_pieces GROUP BY 1)"


@query(oracle.sql(DEDUP, oracle.objects("a")))
def dedup_report(spark, d):
    return chunking.dedup_report(chunking.chunks(src.snapshot_a(spark, d), STEP).select("chunk_digest", "size"))


@query(oracle.both("SELECT DISTINCT chunk_digest, size FROM b_pieces WHERE chunk_digest NOT IN (SELECT chunk_digest FROM a_pieces)"))
def new_chunks_vs_snapshot(spark, d):
    return chunking.new_objects(backed_up(spark, d, "b").pieces.select("chunk_digest", "size"), backed_up(spark, d, "a").store.chunks, "chunk_digest")


@query(oracle.sql("SELECT path, sha256(content) AS content_digest FROM a_files WHERE octet_length(content) > 0"))
def cdc_reassembly(spark, d):
    """Content-defined chunks, stored once by digest, and put together again."""
    pieces = chunking.chunks(src.snapshot_a(spark, d), CDC)
    stored = pieces.select("chunk_digest", F.col("chunk").alias("content")).dropDuplicates(["chunk_digest"])
    return chunking.reassembled(pieces.select("path", "ordinal", "chunk_digest"), stored, "path").select("path", digest(F.col("content")).alias("content_digest"))


@query(oracle.sql("SELECT path, octet_length(content)::BIGINT AS size, true AS gapless, 0::BIGINT AS too_long, 0::BIGINT AS too_short FROM a_files WHERE octet_length(content) > 0"))
def cdc_size_bounds(spark, d):
    """Chunks follow on each other, none is over the hard limit, and only the last may be under the least size."""
    pieces = chunking.chunks(src.snapshot_a(spark, d), CDC).drop("chunk")
    spans = F.array_sort(F.collect_list(F.struct("begin", "end")))
    per = pieces.groupBy("path").agg(F.sum("size").alias("size"), spans.alias("s"), F.sum((F.col("size") > CDC.hard_limit).cast("long")).alias("too_long"))
    ends = F.transform("s", lambda x: x["end"])
    gapless = F.slice(F.transform("s", lambda x: x["begin"]), 2, F.size("s")) == F.slice(ends, 1, F.size("s") - 1)
    short = F.size(F.filter(F.slice("s", 1, F.size("s") - 1), lambda x: x["end"] - x["begin"] < CDC.min_size)).cast("long")
    return per.select("path", "size", gapless.alias("gapless"), "too_long", short.alias("too_short"))


@query(oracle.sql("SELECT sum(octet_length(content))::BIGINT AS total_bytes, true AS all_in_files, true AS no_digest_twice, true AS dedup_saves FROM a_files"))
def cdc_chunk_invariants(spark, d):
    """What SQL can say of content-defined chunks: they hold all bytes, distinct ones no more, and a digest has one size."""
    pieces = chunking.chunks(src.snapshot_a(spark, d), CDC).select("chunk_digest", "size")
    sizes = pieces.groupBy("chunk_digest").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    return sizes.agg(
        F.sum(F.col("n") * F.col("low")).alias("total_bytes"), (F.min("low") > 0).alias("all_in_files"), F.every(F.col("low") == F.col("high")).alias("no_digest_twice"),
        (F.sum("low") < F.sum(F.col("n") * F.col("low"))).alias("dedup_saves"),
    )


@query()
def cdc_chunk_dedup(spark, d):
    return chunking.dedup_report(chunking.chunks(src.snapshot_a(spark, d), CDC).select("chunk_digest", "size"))


@query(oracle.sql("SELECT DISTINCT chunk_digest, 'chunk/' || chunk_digest[1:2] || '/' || chunk_digest[3:4] || '/' || chunk_digest AS object_path FROM a_pieces", oracle.objects("a")))
def chunk_object_path(spark, d):
    return backed_up(spark, d, "a").store.chunks.select("chunk_digest", object_path("chunk", F.col("chunk_digest")).alias("object_path"))


@query(oracle.sql("SELECT chunk_digest[1:2] AS prefix, count(DISTINCT chunk_digest) AS n FROM a_pieces GROUP BY 1", oracle.objects("a")))
def shard_histogram(spark, d):
    return backed_up(spark, d, "a").store.chunks.groupBy("prefix").agg(F.count("*").alias("n"))


@query(oracle.a("SELECT DISTINCT file_digest, ordinal, chunk_digest FROM a_objects JOIN a_pieces USING (path)"))
def file_chunk_list(spark, d):
    return backed_up(spark, d, "a").store.file_chunks.select("file_digest", "ordinal", "chunk_digest")


@query(oracle.a("SELECT DISTINCT file_digest, size, size + 16 * n_chunks AS stored_size FROM a_objects WHERE n_chunks > 0"))
def file_size_from_chunks(spark, d):
    s = backed_up(spark, d, "a").store
    joined = s.file_chunks.select("file_digest", "chunk_digest").join(s.chunks.select("chunk_digest", "size"), "chunk_digest")
    return joined.groupBy("file_digest").agg(F.sum("size").alias("size"), F.sum(chunking.stored_size(F.col("size"))).alias("stored_size"))


@query(oracle.a("SELECT file_digest, ordinal, \"begin\" FROM (SELECT file_digest, min(path) AS path FROM a_objects GROUP BY 1) JOIN a_pieces USING (path)"))
def chunk_offsets(spark, d):
    return chunking.offsets(backed_up(spark, d, "a").store.file_chunks.drop("begin")).select("file_digest", "ordinal", "begin")


# --- trees and versions


@query(oracle.a("SELECT dir, ordinal, kind || ' ' || name || ' ' || child_digest || chr(10) AS line FROM a_entries"))
def tree_entry_lines(spark, d):
    return backed_up(spark, d, "a").entries.select("dir", "ordinal", entry_line(F.col("kind"), F.col("name"), F.col("child_digest")).alias("line"))


@query(oracle.a("SELECT * FROM a_dirs"))
def tree_digests(spark, d):
    return backed_up(spark, d, "a").dirs


@query(oracle.a("SELECT tree_digest FROM a_dirs WHERE path = ''"))
def root_tree_digest(spark, d):
    return root(backed_up(spark, d, "a"))


@query(oracle.a("SELECT version_digest, (SELECT count(*) FROM a_files) AS n_files, (SELECT count(DISTINCT chunk_digest) FROM a_pieces) AS n_chunks, (SELECT sum(size)::BIGINT FROM (SELECT DISTINCT chunk_digest, size FROM a_pieces)) AS n_bytes FROM a_version"))
def full_backup(spark, d):
    """The first snapshot backed up anew, contents and all, whatever was kept of earlier queries."""
    run = store.backup(src.snapshot_a(spark, d), TIMES["a"], STEP)
    kept = durable(run.store.chunks)
    told = kept.agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("content").cast("long")).alias("n_bytes"))
    return run.store.versions.select("version_digest").crossJoin(run.files.agg(F.count("*").alias("n_files"))).crossJoin(told)  # of one row each


@query(oracle.a("SELECT * FROM a_version"))
def version_commit(spark, d):
    return backed_up(spark, d, "a").store.versions


LIST = """SELECT '/' || path || CASE WHEN path = '' THEN '' ELSE '/' END AS path, (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END)::INT AS level, 'dir' AS kind, tree_digest AS digest FROM a_dirs
UNION ALL SELECT '/' || path, len(string_split(path, '/'))::INT, 'file', file_digest FROM a_objects"""


@query(oracle.a(f"SELECT * FROM ({LIST}) WHERE level <= 1"))
def tree_list_depth1(spark, d):
    run = backed_up(spark, d, "a")
    return trees.listing(run.store.tree_entries, root(run), 1)


@query(oracle.a(LIST))
def tree_list_all(spark, d):
    run = backed_up(spark, d, "a")
    return trees.listing(run.store.tree_entries, root(run))


@query(oracle.a("SELECT 'dir' AS kind, tree_digest AS digest FROM a_dirs WHERE path = 'docs/src1/en'"))
def path_search(spark, d):
    run = backed_up(spark, d, "a")
    return trees.search(run.store.tree_entries, root(run), "/docs/src1/en/")


@query("SELECT 'docs/src1' AS path, 'is a dir, not a file' AS problem UNION ALL SELECT 'docs/nowhere', 'not found'")
def path_search_errors(spark, d):
    run, rows = backed_up(spark, d, "a"), []
    for p in ("docs/src1", "docs/nowhere"):
        try:
            trees.search_kind(run.store.tree_entries, root(run), p, "file")
        except trees.WrongKind as e:
            rows.append((p, str(e).split(": ", 1)[1]))
    return spark.createDataFrame(rows, "path string, problem string")


@query(oracle.both("SELECT * FROM a_version UNION ALL SELECT * FROM b_version ORDER BY ver_timestamp"))
def versions_sorted(spark, d):
    return versions.in_order(both(spark, d).versions)


@query(oracle.both("""SELECT ver_timestamp, version_digest, strftime(ver_timestamp, '%a %b ') || lpad(strftime(ver_timestamp, '%-d'), 2, ' ') || strftime(ver_timestamp, ' %H:%M:%S UTC %Y') || ' - version digest [' || version_digest || '] - tree root digest [' || ver_root || ']' AS line
FROM (SELECT * FROM a_version UNION ALL SELECT * FROM b_version)"""))
def versions_text(spark, d):
    return versions.as_text(both(spark, d).versions)


@query(oracle.both("""SELECT ver_timestamp, version_digest, '{"digest":"' || version_digest || '","timestamp":"' || strftime(ver_timestamp, '%a %b ') || lpad(strftime(ver_timestamp, '%-d'), 2, ' ') || strftime(ver_timestamp, ' %H:%M:%S UTC %Y') || '","tree_root":"' || ver_root || '"}' AS line
FROM (SELECT * FROM a_version UNION ALL SELECT * FROM b_version)"""))
def versions_json(spark, d):
    return versions.as_json(both(spark, d).versions)


@query("SELECT coalesce(max(try_cast(n AS BIGINT)), 0) + 1 AS next_id FROM (SELECT doc_id::VARCHAR AS n FROM documents UNION ALL SELECT source FROM documents)")
def next_version_id(spark, d):
    docs = src.table(spark, d, "documents")
    return versions.next_number(docs.select(F.col("doc_id").cast("string").alias("name")).unionByName(docs.select(F.col("source").alias("name"))))


@query("SELECT doc_id, CASE WHEN regexp_full_match(lower(h), '[0-9a-f]{64}') THEN lower(h) END AS digest FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN upper(sha256(text)) ELSE text END AS h FROM documents)")
def digest_parse(spark, d):
    h = F.when(F.col("lang") == "en", F.upper(digest(F.col("text")))).otherwise(F.col("text"))
    return src.table(spark, d, "documents").select("doc_id", parsed_digest(h).alias("digest"))


@query(oracle.a("SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM a_files"))
def base_names(spark, d):
    return src.snapshot_a(spark, d).select("path", base_name(F.col("path")).alias("name"))


ALL = "SELECT DISTINCT 'chunk' AS kind, chunk_digest AS digest FROM {0}_pieces UNION SELECT 'file', file_digest FROM {0}_objects UNION SELECT 'tree', tree_digest FROM {0}_dirs"


@query(oracle.both(f"{ALL.format('a')} UNION {ALL.format('b')} UNION SELECT 'version', version_digest FROM a_version UNION SELECT 'version', version_digest FROM b_version"))
def all_digests(spark, d):
    return both(spark, d).digests()


@query(oracle.both(f"SELECT kind, count(*) AS n FROM (({ALL.format('b')}) INTERSECT ({ALL.format('a')})) GROUP BY kind"))
def objects_exist(spark, d):
    """Objects of the second snapshot that the first one has."""
    a, b = (backed_up(spark, d, x).store.digests() for x in "ab")
    return b.where("kind <> 'version'").join(a, ["kind", "digest"], "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


# --- stat cache

def stats_of(files: DataFrame) -> DataFrame:
    """Stat columns for files of tables, which have none: the digest's place stands in for the inode."""
    return files.select("path", F.lit(1).cast("long").alias("device"), F.lit(0).cast("long").alias("mtime"), F.octet_length("content").cast("long").alias("size"), F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 12), 16, 10).cast("long").alias("inode"))


@query(oracle.both("SELECT b.path, f.file_digest FROM b_files b LEFT JOIN a_files a ON a.path = b.path AND octet_length(a.content) = octet_length(b.content) LEFT JOIN a_objects f ON f.path = a.path"))
def cache_hit_miss(spark, d):
    run = backed_up(spark, d, "a")
    before = stats_of(src.snapshot_a(spark, d)).join(run.files.select("path", "file_digest"), "path")
    generation = cache.next_generation(before, "a")
    return cache.looked_up(stats_of(src.snapshot_b(spark, d)), generation).select("path", "file_digest")


@query(oracle.both("SELECT version_digest, count(*) AS n FROM a_version, a_files GROUP BY 1"))
def cache_generation_valid(spark, d):
    """Entries of a stored version stay, those of one that is not stored go."""
    run = backed_up(spark, d, "a")
    rows = stats_of(src.snapshot_a(spark, d)).join(run.files.select("path", "file_digest"), "path")
    known = run.store.versions.first()["version_digest"]
    entries = cache.next_generation(rows, known).unionByName(cache.next_generation(rows, "0" * 64))
    return cache.valid(entries, run.store.versions, run.store.files_obj).groupBy("version_digest").agg(F.count("*").alias("n"))


# --- change lists


@query(oracle.sql("SELECT path, kind, CASE WHEN kind <> 'remove' THEN '/b/' || path END AS local_path FROM changes"))
def change_parse(spark, d):
    return changes.parsed(src.change_lines(spark, d)).drop("seq")


@query(oracle.sql("SELECT * FROM normal"))
def change_normalised(spark, d):
    return changes.normalised(src.changes(spark, d))


@query(oracle.sql("SELECT DISTINCT unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS path FROM normal"))
def change_descendants(spark, d):
    return changes.touched(changes.normalised(src.changes(spark, d)))


@query(oracle.a("""SELECT d.path, CASE WHEN n.kind = 'remove' THEN 'removed' WHEN n.kind IS NOT NULL THEN 'again' WHEN b.path IS NOT NULL THEN 'traverse' ELSE 'intact' END AS decision, n.local_path,
  CASE WHEN n.kind IS NULL AND b.path IS NOT NULL THEN (SELECT count(*) FROM normal x WHERE x.kind = 'new' AND regexp_replace(x.path, '/?[^/]*$', '') = d.path) ELSE 0 END AS new_entries
FROM a_dirs d LEFT JOIN normal n USING (path) LEFT JOIN (SELECT DISTINCT unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS path FROM normal) b USING (path)"""))
def tree_decisions(spark, d):
    return changes.tree_decisions(backed_up(spark, d, "a").dirs, changes.normalised(src.changes(spark, d)))


@query(oracle.sql("SELECT path, CASE WHEN kind = 'remove' THEN 'removed' WHEN kind IS NOT NULL THEN 'again' ELSE 'intact' END AS decision, local_path FROM a_files LEFT JOIN normal USING (path)"))
def file_decisions(spark, d):
    return changes.file_decisions(src.snapshot_a(spark, d), changes.normalised(src.changes(spark, d)))


def patch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    run = backed_up(spark, d, "a")
    local = backed_up(spark, d, "b").files.select(F.concat(F.lit("/b/"), "path").alias("local_path"), "file_digest")
    return changes.patched(run.dirs, run.files, changes.normalised(src.changes(spark, d)), local)


@query(oracle.b("SELECT tree_digest FROM b_dirs WHERE path = ''"))
def patched_root_digest(spark, d):
    """The patched tree's root, against a full build of the second snapshot."""
    return patch(spark, d)[0].where("path = ''").select("tree_digest")


@query(oracle.both("SELECT dir, ordinal, kind, name, child_digest FROM b_entries WHERE dir IN (SELECT path FROM b_dirs EXCEPT SELECT a.path FROM a_dirs a JOIN b_dirs b USING (path, tree_digest))"))
def patched_tree_entries(spark, d):
    """Entries of the directories that the change list changes; all others are not even looked into."""
    return patch(spark, d)[1]


@query(oracle.sql("SELECT path, kind, local_path FROM normal WHERE kind = 'new' AND contains(path, '/')"))
def change_unmatched(spark, d):
    run = backed_up(spark, d, "a")
    return changes.unmatched(run.dirs, run.files, changes.normalised(src.changes(spark, d)))


# --- garbage, integrity, restore


def second_only(spark: SparkSession, d: str) -> Store:
    """Both snapshots' objects, of which only the second's version is left."""
    return replace(both(spark, d), versions=backed_up(spark, d, "b").store.versions)


@query(oracle.b(ALL.format("b")))
def gc_live(spark, d):
    return store.live(second_only(spark, d))


@query(oracle.both(f"({ALL.format('a')}) EXCEPT ({ALL.format('b')})"))
def gc_garbage(spark, d):
    s = second_only(spark, d)
    return store.garbage(s, store.live(s))


@query(oracle.b(f"{ALL.format('b')} UNION SELECT 'version', version_digest FROM b_version"))
def gc_survivors(spark, d):
    return store.collected(second_only(spark, d)).digests()


@query(oracle.a("SELECT DISTINCT 'chunk' AS kind, chunk_digest AS digest FROM a_pieces WHERE size < 100 "))
def gc_missing(spark, d):
    """Live chunks that are not stored any more, after small ones were lost."""
    s = backed_up(spark, d, "a").store
    return store.missing(replace(s, chunks=s.chunks.where("size >= 100")), store.live(s))


@query("SELECT 'a' AS kind, 'b' AS digest, 'c' AS actual WHERE false")
def integrity_all_ok(spark, d):
    return store.corrupt(both(spark, d))


@query(oracle.a("""SELECT 'chunk' AS kind, chunk_digest AS digest, sha256(''::BLOB) AS actual FROM (SELECT DISTINCT chunk_digest, size FROM a_pieces) WHERE size < 100
UNION ALL SELECT DISTINCT 'file', file_digest, sha256(''::BLOB) FROM a_objects WHERE n_chunks = 1"""))
def integrity_corrupted(spark, d):
    """Small chunks emptied, and the lists of files of one chunk lost."""
    s = backed_up(spark, d, "a").store
    bad = s.chunks.withColumn("content", F.when(F.col("size") < 100, F.lit(b"")).otherwise(F.col("content")))
    single = s.files_obj.where("n_chunks = 1").select("file_digest")
    return store.corrupt(replace(s, chunks=bad, file_chunks=s.file_chunks.join(single, "file_digest", "left_anti")))


@query(oracle.sql("SELECT path, octet_length(content)::BIGINT AS size, sha256(content) AS content_digest FROM b_files"))
def restore_files(spark, d):
    run = backed_up(spark, d, "b")
    return store.restored(run.store, root(run)).select("path", F.octet_length("content").cast("long").alias("size"), digest(F.col("content")).alias("content_digest"))


# --- backups of machines, statistics, encryption

SHARES = oracle.b("SELECT name, child_digest AS tree_digest FROM b_entries WHERE dir = '' AND kind = 'dir' AND name <> 'conv'")


def familiar_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(all tree entries, the root's digest): conversations as the configuration, the other directories as shares."""
    run = backed_up(spark, d, "b")
    top = {r["name"]: r["child_digest"] for r in run.entries.where("dir = '' AND kind = 'dir'").collect()}
    tree = familiar.root(spark, top.pop("conv"), sorted(top.items()))
    is_root = tree.where(F.col("name") == familiar.CONFIG).select("tree_digest")
    return run.store.tree_entries.unionByName(tree.drop("encoded_size")), is_root


FAMILIAR = """
shares AS (SELECT sha256(string_agg('dir ' || name || ' ' || child_digest || chr(10), '' ORDER BY name)) AS t FROM b_entries WHERE dir = '' AND kind = 'dir' AND name <> 'conv')
SELECT sha256('dir @OS_CONFIG ' || (SELECT child_digest FROM b_entries WHERE dir = '' AND name = 'conv') || chr(10) || 'dir @SHARES ' || t || chr(10)) AS tree_digest FROM shares"""


@query("WITH " + ",".join([oracle.FILES, oracle.objects("b"), oracle.trees("b"), FAMILIAR]))
def familiar_root(spark, d):
    return familiar_tree(spark, d)[1]


@query(SHARES)
def familiar_shares(spark, d):
    return familiar.share_names(*familiar_tree(spark, d))


@query(oracle.b("SELECT name, '/restore/' || name AS destination, child_digest AS tree_digest FROM b_entries WHERE dir = '' AND name IN ('docs', 'bench')"))
def familiar_restore_selection(spark, d):
    wanted = [("docs", "/elsewhere"), ("docs", "/restore/docs"), ("bench", "/restore/bench"), ("nothing", "/restore/nothing")]
    return familiar.selected(*familiar_tree(spark, d), wanted)


COUNTERS = """SELECT (SELECT count(*) FROM b_files) AS processed_file_count, (SELECT count(*) FROM (SELECT DISTINCT file_digest FROM b_objects WHERE file_digest NOT IN (SELECT file_digest FROM a_objects))) AS new_file_count, (SELECT count(*) FROM b_files) AS total_file_count,
  (SELECT count(*) FROM b_dirs) AS processed_dir_count, (SELECT count(*) FROM (SELECT DISTINCT tree_digest FROM b_dirs WHERE tree_digest NOT IN (SELECT tree_digest FROM a_dirs))) AS new_dir_count, (SELECT count(*) FROM b_dirs) AS total_dir_count,
  (SELECT count(*) FROM b_pieces) AS processed_chunk_count, (SELECT count(*) FROM (SELECT DISTINCT chunk_digest FROM b_pieces WHERE chunk_digest NOT IN (SELECT chunk_digest FROM a_pieces))) AS new_chunk_count,
  (SELECT coalesce(sum(size + 16), 0) FROM (SELECT DISTINCT chunk_digest, size FROM b_pieces WHERE chunk_digest NOT IN (SELECT chunk_digest FROM a_pieces)))::BIGINT AS uploaded_bytes"""


@query(oracle.both(COUNTERS))
def backup_statistics(spark, d):
    return store.statistics(backed_up(spark, d, "b"), backed_up(spark, d, "a").store)


@query(oracle.both(f"""SELECT 'files: ' || processed_file_count || ' of ' || total_file_count || ', ' || new_file_count || ' new; folders: ' || processed_dir_count || ' of ' || total_dir_count || ', ' || new_dir_count
  || ' new; chunks: ' || processed_chunk_count || ', ' || new_chunk_count || ' new; stored: ' || uploaded_bytes || ' bytes' AS line FROM ({COUNTERS})"""))
def progress_line(spark, d):
    return store.progress_line(store.statistics(backed_up(spark, d, "b"), backed_up(spark, d, "a").store))


@query(oracle.b("SELECT split_part(path, '/', 1) AS share, count(*) AS n_files, sum(size)::BIGINT AS size FROM b_objects GROUP BY 1"))
def statistics_by_share(spark, d):
    return familiar.per_share(backed_up(spark, d, "b").files.select(F.element_at(F.split("path", "/"), 1).alias("share"), "size"))


RATE = """SELECT h, n, total, (n / 3600.0) AS per_second, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) ELSE printf('%.2f KiB', n / 1024.0) END AS shown
FROM (SELECT h, n, sum(n) OVER (ORDER BY h)::BIGINT AS total FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1))"""


@query(RATE)
def throughput_by_interval(spark, d):
    """Events as progress: a running total by hour, what came since the last one, a second's share, and the number in units."""
    hours = src.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return progress.throughput(hours, "h", "n", 3600.0).withColumn("shown", units(F.col("n").cast("double")))


@query(oracle.a("SELECT count(*) AS n, sum((size + 15) // 16)::BIGINT AS counters, 0::BIGINT AS overlaps FROM (SELECT DISTINCT chunk_digest, size FROM a_pieces)"))
def iv_ranges(spark, d):
    """Ranges of counters allotted to chunks: as many as they need, one after the other, none shared."""
    objects = backed_up(spark, d, "a").store.chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_digest").alias("digest"), "size")
    given = cipher.allotted(objects).withColumn("need", cipher.blocks(F.col("size")))
    starts = given.select("counter").distinct().count()
    inside = given.agg(F.count("*").alias("n"), F.sum("need").alias("counters"), F.max(F.col("counter") + F.col("need")).alias("end"))
    return inside.select("n", "counters", (F.col("end") - F.col("counters") + F.col("n") - F.lit(starts)).cast("long").alias("overlaps"))


@query(oracle.a("SELECT DISTINCT chunk_digest, true AS restored, true AS differs FROM a_pieces"))
def ctr_roundtrip(spark, d):
    """Chunks encrypted at their counters, and decrypted again."""
    objects = backed_up(spark, d, "a").store.chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_digest").alias("digest"), "size", "content")
    key = bytes(range(16))
    given = cipher.allotted(objects).withColumn("secret", cipher.ctr(F.col("content"), F.col("counter"), key))
    back = cipher.ctr(F.col("secret"), F.col("counter"), key)
    return given.select(F.col("digest").alias("chunk_digest"), (digest(back) == F.col("digest")).alias("restored"), (F.col("secret") != F.col("content")).alias("differs"))


@query(oracle.a("SELECT '/' || path AS path, CASE WHEN kind = 'dir' THEN 16877 ELSE 33188 END AS mode, kind, size FROM (SELECT path, 'dir' AS kind, encoded_size AS size FROM a_dirs UNION ALL SELECT path, 'file', size FROM a_objects)"))
def file_attributes(spark, d):
    """What a read-only mount tells of each path."""
    run = backed_up(spark, d, "a")
    return mount.attributes(run.dirs, run.files)


@query(oracle.a("SELECT '/' || dir AS dir, name FROM a_entries UNION ALL SELECT '/' || path, unnest(['.', '..']) FROM a_dirs"))
def directory_views(spark, d):
    run = backed_up(spark, d, "a")
    return mount.directories(run.dirs, run.entries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark, sf_dir)
