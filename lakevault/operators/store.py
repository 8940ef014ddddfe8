"""The object store as tables, kept in one folder, and what is built from them: a backup, garbage, integrity, restores."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.functions.digests import EMPTY, digest, entry_line, version_digest
from lakevault.functions.gear import GearConfig
from lakevault.operators import trees as T
from lakevault.operators.chunking import chunks, file_objects, reassembled, stored_size
from lakevault.session import durable

SCHEMAS = {
    "chunks": "chunk_digest string, size long, content binary, prefix string",
    "file_chunks": "file_digest string, ordinal int, chunk_digest string, begin long, end long, size long",
    "files_obj": "file_digest string, n_chunks long, size long",
    "trees": "tree_digest string, encoded_size long",
    "tree_entries": "tree_digest string, ordinal int, kind string, name string, child_digest string",
    "versions": "version_digest string, ver_timestamp timestamp, ver_root string",
}
#: The column that names an object, by table.
KEYS = {"chunks": "chunk_digest", "files_obj": "file_digest", "trees": "tree_digest", "versions": "version_digest"}
#: The tables that hold objects of a kind.
HELD = {"chunk": ("chunks",), "file": ("files_obj", "file_chunks"), "tree": ("trees", "tree_entries")}
KINDS = {"version": "versions", "tree": "trees", "file": "files_obj", "chunk": "chunks"}


@dataclass(frozen=True)
class Store:
    chunks: DataFrame
    file_chunks: DataFrame
    files_obj: DataFrame
    trees: DataFrame
    tree_entries: DataFrame
    versions: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    def plus(self, other: Store) -> Store:
        """Objects of both, each once: what other brings is checked against what is stored by digest alone."""
        def both(name: str, key: str) -> DataFrame:
            mine, theirs = getattr(self, name), getattr(other, name)
            return mine.unionByName(theirs.join(mine.select(key).distinct(), key, "left_anti").select(*mine.columns))
        return Store(
            both("chunks", "chunk_digest"), both("file_chunks", "file_digest"), both("files_obj", "file_digest"),
            both("trees", "tree_digest"), both("tree_entries", "tree_digest"), both("versions", "version_digest"),
        )

    def digests(self) -> DataFrame:
        """kind, digest of all objects."""
        return reduce(DataFrame.unionByName, [getattr(self, t).select(F.lit(k).alias("kind"), F.col(KEYS[t]).alias("digest")) for k, t in KINDS.items()])


@dataclass(frozen=True)
class Backup:
    """What one run has read and built: store holds its objects, each once."""

    store: Store
    files: DataFrame  # path, file_digest, n_chunks, size
    pieces: DataFrame  # path, ordinal, begin, end, size, chunk_digest
    dirs: DataFrame  # path, tree_digest, encoded_size
    entries: DataFrame  # dir, ordinal, kind, name, child_digest


def version(spark: SparkSession, root: DataFrame, timestamp: str) -> DataFrame:
    """The version row of a root (tree_digest) at an ISO 8601 time."""
    ts = F.to_timestamp(F.lit(timestamp))
    return root.select(version_digest(ts, F.col("tree_digest")).alias("version_digest"), ts.alias("ver_timestamp"), F.col("tree_digest").alias("ver_root"))


def backup(files: DataFrame, timestamp: str, cut: GearConfig | int = GearConfig(), known: DataFrame | None = None) -> Backup:
    """Files (path, content) as objects, and a version. Contents are cut once; only chunks that are not known carry them on."""
    pieces = durable(chunks(files, cut).select("path", "ordinal", "begin", "end", "size", "chunk_digest"))
    found = durable(file_objects(files, pieces))
    dirs, entries = T.build(found)
    dirs, entries = durable(dirs), durable(entries)
    return Backup(stored(files, pieces, found, dirs, entries, timestamp, known), found, pieces, dirs, entries)


def contents(files: DataFrame, pieces: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """chunk_digest, size, content: each chunk of pieces once that is not known (chunk_digest).

    Digests meet first, without contents; then only files that hold the chosen place of a new chunk are read, and cut there.
    """
    place = pieces.groupBy("chunk_digest").agg(F.min(F.struct("path", "ordinal", "begin", "size")).alias("at"))
    if known is not None:
        place = place.join(known.select("chunk_digest"), "chunk_digest", "left_anti")
    parts = place.groupBy("at.path").agg(F.collect_list(F.struct("chunk_digest", "at.begin", "at.size")).alias("parts"))
    each = files.select("path", "content").join(parts, "path").select("content", F.explode("parts").alias("p"))
    return each.select("p.chunk_digest", "p.size", F.substring("content", (F.col("p.begin") + 1).cast("int"), F.col("p.size").cast("int")).alias("content"))


def stored(files: DataFrame, pieces: DataFrame, found: DataFrame, dirs: DataFrame, entries: DataFrame, timestamp: str, known: DataFrame | None = None) -> Store:
    spark, one = files.sparkSession, contents(files, pieces, known)
    sample = found.groupBy("file_digest").agg(F.min("path").alias("path"))
    file_chunks = pieces.join(sample, "path").select("file_digest", "ordinal", "chunk_digest", "begin", "end", "size")
    trees, tree_entries = T.tables(dirs, entries)
    root = dirs.where("path = ''").select("tree_digest")
    return Store(
        one.withColumn("prefix", F.substring("chunk_digest", 1, 2)), file_chunks, found.select("file_digest", "n_chunks", "size").dropDuplicates(["file_digest"]),
        trees, tree_entries, version(spark, root, timestamp),
    )


class NoVersions(ValueError):
    """Garbage collection without any version would delete everything."""


def live(store: Store, versions: DataFrame | None = None) -> DataFrame:
    """kind, digest of the trees, files and chunks that versions lead to, each once.

    A level of trees at a time; trees seen before are left out, so that shared ones are walked once.
    """
    versions = store.versions if versions is None else versions
    level = seen = durable(versions.select(F.col("ver_root").alias("digest")).distinct())
    while True:
        below = level.join(store.tree_entries.where("kind = 'dir'"), level.digest == store.tree_entries.tree_digest).select(F.col("child_digest").alias("digest")).distinct()
        level = durable(below.join(seen, "digest", "left_anti"))
        if level.isEmpty():
            break
        seen = durable(seen.unionByName(level))
    files = store.tree_entries.where("kind = 'file'").join(seen.select(F.col("digest").alias("tree_digest")), "tree_digest", "left_semi").select(F.col("child_digest").alias("digest")).distinct()
    of = store.file_chunks.join(files.select(F.col("digest").alias("file_digest")), "file_digest", "left_semi").select(F.col("chunk_digest").alias("digest")).distinct()
    kinds = (("tree", seen), ("file", files), ("chunk", of))
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "digest") for k, df in kinds])


def garbage(store: Store, reached: DataFrame) -> DataFrame:
    """kind, digest of stored objects that are not live; versions always are."""
    return store.digests().where("kind <> 'version'").join(reached, ["kind", "digest"], "left_anti")


def missing(store: Store, reached: DataFrame) -> DataFrame:
    """kind, digest of live objects that are not stored."""
    return reached.join(store.digests(), ["kind", "digest"], "left_anti")


def collected(store: Store, force: bool = False, reached: DataFrame | None = None) -> Store:
    """The store without garbage; reached: what is live, if known."""
    if not force and store.versions.isEmpty():
        raise NoVersions("no version is stored; force deletes all objects")
    reached = durable(live(store)) if reached is None else reached
    keep = lambda df, kind, key: df.join(reached.where(F.col("kind") == kind).select(F.col("digest").alias(key)), key, "left_semi")
    return replace(
        store, chunks=keep(store.chunks, "chunk", "chunk_digest"), file_chunks=keep(store.file_chunks, "file", "file_digest"), files_obj=keep(store.files_obj, "file", "file_digest"),
        trees=keep(store.trees, "tree", "tree_digest"), tree_entries=keep(store.tree_entries, "tree", "tree_digest"),
    )


def recomputed(store: Store) -> DataFrame:
    """kind, digest, actual of all objects: their digests made again from what is stored."""
    versions = store.versions.select(F.lit("version").alias("kind"), F.col("version_digest").alias("digest"), version_digest(F.col("ver_timestamp"), F.col("ver_root")).alias("actual"))
    made = _trees_again(store)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_digest"))), lambda x: x["chunk_digest"])
    files = store.file_chunks.groupBy("file_digest").agg(digest(F.unhex(F.array_join(listed, ""))).alias("actual"))
    files = store.files_obj.select("file_digest").join(files, "file_digest", "left").select(F.lit("file").alias("kind"), F.col("file_digest").alias("digest"), F.coalesce("actual", F.lit(EMPTY)).alias("actual"))
    parts = store.chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_digest").alias("digest"), digest(F.col("content")).alias("actual"))
    return reduce(DataFrame.unionByName, [versions, made, files, parts])


def _trees_again(store: Store) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("ordinal", entry_line(F.col("kind"), F.col("name"), F.col("child_digest")).alias("line"))))
    made = store.tree_entries.groupBy("tree_digest").agg(digest(F.array_join(F.transform(lines, lambda x: x["line"]), "")).alias("actual"))
    return store.trees.select("tree_digest").join(made, "tree_digest", "left").select(F.lit("tree").alias("kind"), F.col("tree_digest").alias("digest"), F.coalesce("actual", F.lit(EMPTY)).alias("actual"))


def corrupt(store: Store) -> DataFrame:
    """kind, digest, actual of the objects whose content is not what their name says; a null content counts."""
    return recomputed(store).where("actual IS NULL OR actual <> digest")


def restored(store: Store, root: DataFrame, levels: int | None = None) -> DataFrame:
    """path, content of all files below root (tree_digest). Digests are joined first; contents once, by distinct file."""
    files = T.listing(store.tree_entries, root, levels).where("kind = 'file'").select(F.regexp_replace("path", "^/", "").alias("path"), F.col("digest").alias("file_digest"))
    files = durable(files)
    wanted = store.file_chunks.join(files.select("file_digest").distinct(), "file_digest", "left_semi")
    whole = reassembled(wanted, store.chunks)
    return files.join(whole, "file_digest", "left").select("path", "file_digest", F.coalesce("content", F.lit(b"")).alias("content"))


def pieces_below(store: Store, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, file_digest of all files below root; and path, ordinal, content of their chunks, one row without for an empty file."""
    listed = T.listing(store.tree_entries, root).where("kind = 'file'")
    files = durable(listed.select(F.regexp_replace("path", "^/", "").alias("path"), F.col("digest").alias("file_digest")))
    parts = files.join(store.file_chunks.select("file_digest", "ordinal", "chunk_digest"), "file_digest", "left").join(store.chunks.select("chunk_digest", "content"), "chunk_digest", "left")
    return files, parts.select("path", "ordinal", "content")


def statistics(run: Backup, before: Store | None = None, version_bytes: int = 0) -> DataFrame:
    """One row: processed, new and total counts of files, directories and chunks, and the bytes written.

    Chunks count as often as they occur, new ones once; bytes are those of new chunks with what encryption adds, and the version's.
    """
    old = lambda t: before and getattr(before, t).select(KEYS[t])
    new = lambda df, t: df.join(old(t), KEYS[t], "left_anti") if before else df
    chunk = new(run.pieces.select("chunk_digest", "size").dropDuplicates(["chunk_digest"]), "chunks").agg(F.count("*").alias("new_chunk_count"), (F.coalesce(F.sum(stored_size(F.col("size"))), F.lit(0)) + version_bytes).alias("uploaded_bytes"))
    file = new(run.files.select("file_digest").distinct(), "files_obj").agg(F.count("*").alias("new_file_count"))
    tree = new(run.dirs.select("tree_digest").distinct(), "trees").agg(F.count("*").alias("new_dir_count"))
    counts = [run.files.agg(F.count("*").alias("processed_file_count")), run.dirs.agg(F.count("*").alias("processed_dir_count")), run.pieces.agg(F.count("*").alias("processed_chunk_count")), chunk, file, tree]
    row = reduce(DataFrame.crossJoin, counts)  # one row each
    return row.select(
        "processed_file_count", "new_file_count", F.col("processed_file_count").alias("total_file_count"), "processed_dir_count", "new_dir_count", F.col("processed_dir_count").alias("total_dir_count"),
        "processed_chunk_count", "new_chunk_count", "uploaded_bytes",
    )


def progress_line(stats: DataFrame) -> DataFrame:
    c = F.col
    return stats.select(
        F.format_string(
            "files: %d of %d, %d new; folders: %d of %d, %d new; chunks: %d, %d new; stored: %d bytes",
            c("processed_file_count"), c("total_file_count"), c("new_file_count"), c("processed_dir_count"), c("total_dir_count"), c("new_dir_count"), c("processed_chunk_count"), c("new_chunk_count"), c("uploaded_bytes"),
        ).alias("line")
    )
