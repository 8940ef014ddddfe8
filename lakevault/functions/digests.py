"""Digests as lower-case hex, the texts that are hashed, and where objects lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digest of no bytes: the empty file's and the empty directory's.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
VALID = "^[0-9a-f]{64}$"
#: Bytes that encryption puts before each stored object.
IV_BYTES = 16


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def parsed_digest(text: Column) -> Column:
    """A digest in lower case; null if the text is none."""
    low = F.lower(text)
    return F.when(low.rlike(VALID), low)


def object_path(kind: str, of: Column) -> Column:
    """Chunks lie two folders deep by their first bytes, other objects flat."""
    if kind == "chunk":
        return F.concat(F.lit("chunk/"), F.substring(of, 1, 2), F.lit("/"), F.substring(of, 3, 2), F.lit("/"), of)
    return F.concat(F.lit(f"{kind}/"), of)


def entry_line(kind: Column, name: Column, child: Column) -> Column:
    return F.concat(kind, F.lit(" "), name, F.lit(" "), child, F.lit("\n"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def parent(path: Column) -> Column:
    """The directory a path is in; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column, itself: bool = False) -> Column:
    """All directories above a path, the root (empty) first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.array_append(above, path) if itself else above


def normal_path(path: Column) -> Column:
    """Without a slash at the end; the root, ".", is empty."""
    bare = F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"^\./", "")
    return F.when(bare.isin(".", ""), F.lit("")).otherwise(bare)


def iso_time(ts: Column) -> Column:
    """UTC, as yyyy-MM-ddTHH:mm:ss[.fraction]Z without zeros at the end of the fraction."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(full, "0+$", ""), r"\.$", ""), F.lit("Z"))


def version_digest(ts: Column, root: Column) -> Column:
    """Of the time's length (8 bytes, big end first), the time, and the root's digest."""
    iso = iso_time(ts)
    size = F.lpad(F.hex(F.length(iso)), 16, "0")
    return digest(F.concat(F.unhex(size), F.encode(iso, "utf-8"), F.unhex(root)))


def display_time(ts: Column, zone: str = "UTC") -> Column:
    """Like C's %c, in a time zone, for sessions in UTC."""
    ts = ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)
    day = F.lpad(F.date_format(ts, "d"), 2, " ")
    return F.concat(F.date_format(ts, "EEE MMM "), day, F.date_format(ts, " HH:mm:ss"), F.lit(f" {zone} "), F.date_format(ts, "yyyy"))


def units(number: Column) -> Column:
    """A number of bytes in the largest unit that leaves 1 or more, with two digits."""
    names = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB"]
    out = F.lit(None).cast("string")
    for k, name in enumerate(names):
        fits = (number >= 1024.0**k) if k else (number < 1024.0)
        out = F.when(fits, F.format_string(f"%.2f {name}", number / 1024.0**k)).otherwise(out)
    return out
