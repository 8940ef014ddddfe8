"""The command surface: one method for each thing a user of the store does.

A repository is one folder on any file system that Spark writes to: a table for each kind of object, a folder of Parquet
files for each run, and the versions last. A run's objects count once its version row is there; what a run that failed
has left is used by the next one. One run writes at a time. Garbage collection writes anew the tables that lose rows, then
the pointer to them, and deletes what it no longer leads to. Pointers, the configuration among them, are small JSON
tables in the same folder, of which only the last state is kept.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.functions import cipher
from lakevault.functions.digests import EMPTY
from lakevault.functions.gear import GearConfig
from lakevault.operators import cache, changes, familiar, mount, store, trees, versions
from lakevault.operators.store import SCHEMAS, Backup, Store
from lakevault.session import durable, ship
from lakevault.sources.tables import of_bytes

TABLES = list(SCHEMAS)


def checked_digest(text: str) -> str:
    if not re.fullmatch("[0-9a-fA-F]{64}", text):
        raise ValueError(f"{text!r} is no digest: 64 hexadecimal digits are")
    return text


def checked_path(text: str) -> str:
    if ".." in text.split("/") or "\0" in text:
        raise ValueError(f"{text!r} is no path in a tree")
    return text


@dataclass(frozen=True)
class Config:
    cut: GearConfig
    wrapped: cipher.WrappedKey | None
    iv: bytes

    def to_json(self) -> str:
        b = lambda x: base64.b64encode(x).decode()
        key = self.wrapped and {"salt": b(self.wrapped.salt), "verify": b(self.wrapped.verify), "secret": b(self.wrapped.secret)}
        return json.dumps({"level": self.cut.level, "avg": self.cut.avg, "cipher": key, "iv": b(self.iv)})

    @staticmethod
    def from_json(text: str) -> Config:
        x, b = json.loads(text), base64.b64decode
        return Config(GearConfig(x["level"], x["avg"]), cipher.WrappedKey(*(b(x["cipher"][n]) for n in ("salt", "verify", "secret"))) if x["cipher"] else None, b(x["iv"]))


class Engine:
    def __init__(self, spark: SparkSession, path: str, password: bytes | None = None):
        self.spark, self.path = ship(spark), path.rstrip("/")
        rows = self._pointer("config")
        if rows is None:
            raise FileNotFoundError(f"no repository in {path}")
        self.config = Config.from_json(rows)
        self.key = None
        if self.config.wrapped:
            if password is None:
                raise PermissionError("this repository needs a password")
            self.key = cipher.unwrap(spark, password, self.config.wrapped)

    # --- repository

    @staticmethod
    def init(spark: SparkSession, path: str, password: bytes | None = None, cut: GearConfig = GearConfig()) -> Engine:
        """A new, empty repository; with a password, chunks are encrypted under a random key that it unlocks."""
        self = Engine.__new__(Engine)
        self.spark, self.path = ship(spark), path.rstrip("/")
        if self._pointer("config") is not None:
            raise FileExistsError(f"{path} holds a repository")
        wrapped = cipher.wrap(spark, password, cipher.new_key()) if password is not None else None
        self.config = Config(cut, wrapped, cipher.new_iv())
        self._write_tables(Store.empty(spark), TABLES)
        self._point("config", self.config.to_json())
        return Engine(spark, path, password)

    def change_password(self, old: bytes, new: bytes) -> None:
        """The same key under another password; the key under the old one is deleted."""
        if not self.config.wrapped:
            raise PermissionError("this repository has no password")
        self.config = replace(self.config, wrapped=cipher.rewrap(self.spark, old, new, self.config.wrapped))
        self._point("config", self.config.to_json())

    def _point(self, name: str, value: str) -> None:
        """Writes a pointer's next state, and deletes the ones before; the whole one with the highest number counts."""
        states = self._states(name)
        n = max(states, default=0) + 1
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}/{n}")
        for k in states:
            self._delete(f"{self.path}/{name}/{k}")

    def _states(self, name: str) -> list[int]:
        """Numbers of a pointer's states that were written to the end."""
        return [int(x) for x in self._names(f"{self.path}/{name}") if x.isdigit() and self._exists(f"{self.path}/{name}/{x}/_SUCCESS")]

    def _pointer(self, name: str) -> str | None:
        states = self._states(name)
        return self.spark.read.schema("value string").json(f"{self.path}/{name}/{max(states)}").first()["value"] if states else None

    def _on(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._on(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._on(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._on(path)
        fs.delete(p, True)

    def _folders(self) -> dict[str, str]:
        """The folder of each table."""
        return json.loads(self._pointer("tables") or "{}")

    def _write_tables(self, s: Store, names: list[str]) -> None:
        """Writes these tables anew; their folders until then go once the pointer leads to the new ones."""
        before, run = self._folders(), uuid.uuid4().hex
        for t in names:
            getattr(s, t).write.parquet(f"{self.path}/objects/{t}-{run}/run=0")
        now = before | {t: f"{t}-{run}" for t in names}
        self._point("tables", json.dumps(now))
        for x in self._names(f"{self.path}/objects"):
            if x not in now.values():
                self._delete(f"{self.path}/objects/{x}")

    def _append(self, s: Store) -> None:
        """A run's new objects; the version row last, which makes them count."""
        run, at = uuid.uuid4().hex, self._folders()
        for t in [t for t in TABLES if t != "versions"] + ["versions"]:
            getattr(s, t).write.parquet(f"{self.path}/objects/{at[t]}/run={run}")

    def store(self) -> Store:
        """All objects, as stored: a run writes only what is not there yet, and one runs at a time."""
        at = self._folders()
        return Store(**{t: self.spark.read.schema(SCHEMAS[t]).option("recursiveFileLookup", True).parquet(f"{self.path}/objects/{at[t]}") for t in TABLES})

    def plain(self) -> Store:
        """The store with chunk contents decrypted."""
        s = self.store()
        if self.key is None:
            return s
        # an encrypted content is its 16-byte iv, then the text
        first = F.conv(F.hex(F.substring("content", 9, 8)), 16, 10).cast("long")
        high = self.config.iv[:8] + bytes(8)
        text = cipher.ctr(F.substring("content", 17, 2**31 - 1), first, self.key, high)
        return replace(s, chunks=s.chunks.withColumn("content", text))

    def _sealed(self, new: DataFrame) -> DataFrame:
        if self.key is None:
            return new
        # counters go on after those of all chunks stored so far
        used = self.store().chunks.agg(F.coalesce(F.sum(cipher.blocks(F.col("size"))), F.lit(0))).first()[0]
        runs = self._pointer("counter")
        start = max(int(runs or 0), used)
        new = durable(new)
        need = new.agg(F.coalesce(F.sum(cipher.blocks(F.col("size"))), F.lit(0))).first()[0]
        self._point("counter", str(start + need))  # reserved before anything is written under it
        rows = cipher.allotted(new.withColumn("kind", F.lit("chunk")), start, "size", ("kind", "chunk_digest"))
        high = self.config.iv[:8] + bytes(8)
        iv = F.unhex(F.concat(F.lit(self.config.iv[:8].hex()), F.lpad(F.hex("counter"), 16, "0")))
        return rows.withColumn("content", F.concat(iv, cipher.ctr(F.col("content"), F.col("counter"), self.key, high))).select(*new.columns)

    def _commit(self, s: Store) -> str:
        have = self.store()
        fresh = lambda t, key: getattr(s, t).join(getattr(have, t).select(key).distinct(), key, "left_anti").select(*getattr(s, t).columns)
        new = Store(
            self._sealed(fresh("chunks", "chunk_digest")), fresh("file_chunks", "file_digest"), fresh("files_obj", "file_digest"),
            fresh("trees", "tree_digest"), fresh("tree_entries", "tree_digest"), fresh("versions", "version_digest"),
        )
        self._append(new)
        return s.versions.first()["version_digest"]

    @staticmethod
    def _now(timestamp: str | None) -> str:
        return timestamp or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    # --- writing

    def backup(self, files: DataFrame, timestamp: str | None = None) -> str:
        """A version of files (path, content); with stat columns, files that the last run knows are not cut again."""
        run = self._run(files, timestamp)
        digest = self._commit(run.store)
        if set(cache.KEY) <= set(files.columns):
            rows = files.select("path", *cache.KEY).join(run.files.select("path", "file_digest"), "path")
            cache.next_generation(rows, digest).write.mode("overwrite").parquet(f"{self.path}/stat_cache/version={digest}")
            self._point("cache", digest)
            for x in self._names(f"{self.path}/stat_cache"):
                if x != f"version={digest}":
                    self._delete(f"{self.path}/stat_cache/{x}")
        return digest

    def _run(self, files: DataFrame, timestamp: str | None) -> Backup:
        when, last = self._now(timestamp), self._pointer("cache")
        if last is None or not set(cache.KEY) <= set(files.columns):
            return store.backup(files.select("path", "content"), when, self.config.cut, self.store().chunks)
        have = self.store()
        known = cache.valid(self.spark.read.parquet(f"{self.path}/stat_cache/version={last}"), have.versions, have.files_obj)
        looked = cache.looked_up(files, known)
        hits = durable(looked.where(F.col("file_digest").isNotNull()).select("path", "file_digest"))
        misses = looked.where(F.col("file_digest").isNull()).select("path", "content")
        pieces = durable(store.chunks(misses, self.config.cut).select("path", "ordinal", "begin", "end", "size", "chunk_digest"))
        found = store.file_objects(misses, pieces).unionByName(hits.join(have.files_obj, "file_digest").select("path", "file_digest", "n_chunks", "size"))
        found = durable(found)
        dirs, entries = (durable(x) for x in trees.build(found))
        # the objects of hits are stored already
        return Backup(store.stored(misses, pieces, found, dirs, entries, when, have.chunks), found, pieces, dirs, entries)

    def patch(self, tree: str, lines: DataFrame, local: DataFrame, timestamp: str | None = None) -> str:
        """A version of a tree after a change list (seq, value); local: local_path, content of the files it names.

        Without a change everything stays; if the root is removed the version's tree is empty.
        """
        have = self.plain()
        normal = durable(changes.normalised(changes.parsed(lines)))
        whole = normal.where("path = ''").first()
        files = local.withColumnRenamed("local_path", "path")
        pieces = durable(store.chunks(files, self.config.cut).select("path", "ordinal", "begin", "end", "size", "chunk_digest"))
        found = durable(store.file_objects(files, pieces))
        listed = trees.listing(have.tree_entries, self.spark.createDataFrame([(tree,)], "tree_digest string"))
        below = F.regexp_replace("path", "^/|/$", "").alias("path")
        dirs = durable(listed.where("kind = 'dir'").select(below, F.col("digest").alias("tree_digest")))
        old = durable(listed.where("kind = 'file'").select(below, F.col("digest").alias("file_digest")))
        if whole is not None:
            at = (whole["local_path"] or "").rstrip("/")
            inside = found.where(F.col("path").startswith(at + "/")).select(F.substr("path", F.lit(len(at) + 2)).alias("path"), "file_digest")
            new_dirs, entries = trees.build(inside if whole["kind"] != "remove" else inside.limit(0))
        elif normal.isEmpty():
            new_dirs, entries = dirs.where("path = ''").withColumn("encoded_size", F.lit(0).cast("long")), None
        else:
            new_dirs, entries = changes.patched(dirs, old, normal, found.select(F.col("path").alias("local_path"), "file_digest"))
        new_dirs = durable(new_dirs)
        if entries is None:
            entries = self.spark.createDataFrame([], "dir string, ordinal int, kind string, name string, child_digest string")
        if new_dirs.where("path = ''").isEmpty():  # all below the root is gone
            new_dirs = self.spark.createDataFrame([("", EMPTY, 0)], "path string, tree_digest string, encoded_size long")
        return self._commit(store.stored(files, pieces, found, new_dirs, durable(entries), self._now(timestamp), have.chunks))

    def familiar_backup(self, config: DataFrame | dict[str, bytes], shares: list[tuple[str, DataFrame]], timestamp: str | None = None) -> str:
        """A version whose root holds a machine's configuration and its shares, each given as files (path, content).

        The configuration may also be given as bytes by path. All inputs are checked before anything is read or written.
        """
        config = of_bytes(self.spark, config) if isinstance(config, dict) else config
        for name, f in [("configuration", config), *shares]:
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no name of a share")
            if lacking := {"path", "content"} - set(f.columns):
                raise ValueError(f"{name}: no column {', '.join(sorted(lacking))}")
        when, known = self._now(timestamp), self.store().chunks
        runs = [store.backup(f, when, self.config.cut, known) for f in [config, *(f for _, f in shares)]]
        roots = [r.dirs.where("path = ''").first()["tree_digest"] for r in runs]
        top = durable(familiar.root(self.spark, roots[0], [(n, d) for (n, _), d in zip(shares, roots[1:], strict=True)]))
        all_ = runs[0].store
        for r in runs[1:]:
            all_ = all_.plus(r.store)
        root = top.where(F.col("name") == familiar.CONFIG).select("tree_digest")
        s = replace(all_, trees=all_.trees.unionByName(top.select("tree_digest", "encoded_size").distinct()), tree_entries=all_.tree_entries.unionByName(top.drop("encoded_size")), versions=store.version(self.spark, root, when))
        return self._commit(s)

    # --- reading

    def versions(self, as_json: bool = False, zone: str = "UTC") -> DataFrame:
        """The versions in order, their times shown in a time zone."""
        rows = self.store().versions
        return (versions.as_json(rows, zone) if as_json else versions.as_text(rows, zone)).orderBy("ver_timestamp", "version_digest")

    def _root(self, version: str) -> DataFrame:
        checked_digest(version)
        return versions.one(self.store().versions, version).select(F.col("ver_root").alias("tree_digest"))

    def find(self, version: str, start: str = "", depth: int | None = None) -> DataFrame:
        """path, level, kind, digest below a path of a version."""
        checked_path(start)
        return self.ls(self._root(version).first()[0], start, depth)

    def ls(self, tree: str, start: str = "", depth: int | None = 1) -> DataFrame:
        checked_digest(tree), checked_path(start)
        entries = self.store().tree_entries
        root = self.spark.createDataFrame([(tree,)], "tree_digest string")
        if start.strip("/."):
            root = self.spark.createDataFrame([(trees.search_kind(entries, root, start, "dir"),)], "tree_digest string")
        return trees.listing(entries, root, depth)

    def lookup(self, version: str, path: str) -> DataFrame:
        """path, mode, kind, size of what a mount shows under a version at a path: one row, or none."""
        checked_path(path)
        s = self.store()
        hit = trees.search(s.tree_entries, self._root(version), path)
        sizes = s.trees.select(F.lit("dir").alias("kind"), F.col("tree_digest").alias("digest"), F.col("encoded_size").alias("size"))
        sizes = sizes.unionByName(s.files_obj.select(F.lit("file").alias("kind"), F.col("file_digest").alias("digest"), "size"))
        mode = F.when(F.col("kind") == "dir", mount.DIRECTORY).otherwise(mount.FILE)
        return hit.join(sizes, ["kind", "digest"], "left").select(F.lit("/" + path.strip("/")).alias("path"), mode.alias("mode"), "kind", F.coalesce("size", F.lit(0)).alias("size"))

    def cat_tree(self, tree: str) -> DataFrame:
        checked_digest(tree)
        return self.store().tree_entries.where(F.col("tree_digest") == tree).orderBy("ordinal").select("kind", "name", "child_digest")

    def cat_file(self, file: str) -> bytes:
        """A file's content, which has to fit the driver."""
        checked_digest(file)
        s = self.plain()
        known = s.files_obj.where(F.col("file_digest") == file).first()
        if known is None:
            raise LookupError(f"no file {file}")
        parts = s.file_chunks.where(F.col("file_digest") == file).join(s.chunks.select("chunk_digest", "content"), "chunk_digest").orderBy("ordinal").select("content")
        return b"".join(bytes(r["content"]) for r in parts.toLocalIterator())

    def cat_file_chunks(self, file: str) -> DataFrame:
        checked_digest(file)
        return self.store().file_chunks.where(F.col("file_digest") == file).orderBy("ordinal").select("chunk_digest")

    def cat_chunk(self, chunk: str) -> bytes:
        checked_digest(chunk)
        row = self.plain().chunks.where((F.col("prefix") == chunk[:2]) & (F.col("chunk_digest") == chunk)).first()
        if row is None:
            raise LookupError(f"no chunk {chunk}")
        return bytes(row["content"])

    def ref_cat(self, path: str) -> DataFrame:
        """A file's content as it is read without the store, to compare speeds."""
        return self.spark.read.format("binaryFile").load(path).select("content")

    def restore(self, tree: str) -> DataFrame:
        """path, content of all files below a tree, a file a row."""
        checked_digest(tree)
        return store.restored(self.plain(), self.spark.createDataFrame([(tree,)], "tree_digest string")).select("path", "content")

    def restore_to(self, tree: str, target: str) -> int:
        """Writes a tree's files into an empty local folder that driver and executors share; how many.

        Files are written chunk by chunk, in order, so that they may be of any size. Names that lead out of the folder are
        refused before anything is written.
        """
        from pathlib import Path

        checked_digest(tree)
        at = Path(target)
        if not at.is_dir() or any(at.iterdir()):
            raise ValueError(f"{target} is not an empty folder")
        files, parts = store.pieces_below(self.plain(), self.spark.createDataFrame([(tree,)], "tree_digest string"))
        if (bad := files.where(F.col("path").rlike(r"(^|/)\.{0,2}(/|$)") | F.col("path").contains("\0")).first()) is not None:
            raise ValueError(f"{bad['path']!r} does not stay below the target")

        def write(rows):
            path, out = None, None
            for r in rows:
                if r["path"] != path:
                    if out:
                        out.close()
                    path = r["path"]
                    (p := Path(target) / path).parent.mkdir(parents=True, exist_ok=True)
                    out = p.open("wb")  # a task that runs again starts the file anew
                if r["content"] is not None:
                    out.write(bytes(r["content"]))
            if out:
                out.close()

        parts.repartition("path").sortWithinPartitions("path", "ordinal").foreachPartition(write)
        return files.count()

    def familiar_shares(self, version: str) -> DataFrame:
        return familiar.share_names(self.store().tree_entries, self._root(version))

    def familiar_restore(self, version: str, wanted: list[tuple[str, str]]) -> DataFrame:
        """path (below each share's destination), content; shares that are not there are left out."""
        s = self.plain()
        rows = familiar.selected(s.tree_entries, self._root(version), wanted).collect()  # no more than are asked for
        out = [store.restored(s, self.spark.createDataFrame([(r["tree_digest"],)], "tree_digest string")).select(F.concat(F.lit(r["destination"].rstrip("/") + "/"), "path").alias("path"), "content") for r in rows]
        return familiar.together(out) if out else self.spark.createDataFrame([], "path string, content binary")

    # --- maintenance

    def gc(self, dry_run: bool = False, force: bool = False) -> DataFrame:
        """kind, digest of the garbage; unless it is a dry run, the tables that hold some are written without it and deleted."""
        s = self.store()
        if not force and s.versions.isEmpty():
            raise store.NoVersions("no version is stored; force deletes all objects")
        reached = durable(store.live(s))
        found = durable(store.garbage(s, reached))
        if not dry_run:
            kinds = {r["kind"] for r in found.select("kind").distinct().collect()}  # of three
            names = [t for kind, ts in store.HELD.items() if kind in kinds for t in ts]
            if names:
                self._write_tables(store.collected(s, force, reached), names)
        return found

    def integrity_check(self) -> DataFrame:
        """kind, digest, actual of what is not as its name says."""
        return store.corrupt(self.plain())
