"""The same snapshots, chunks, digests and trees in SQL, as common table expressions for the queries' SQL."""

from __future__ import annotations

STEP = 1024

FILES = r"""
docs AS (SELECT doc_id, 'docs/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, encode(coalesce(text, '')) AS content FROM documents),
conv AS (SELECT 'conv/' || conv_id || '/' || turn || '-' || coalesce(role, 'none') || '.txt' AS path, 'conv/' || conv_id AS dir, encode(coalesce(text, '')) AS content FROM conversations),
html AS (SELECT 'pages/' || page_id || '.html' AS path, encode(coalesce(html, '')) AS content FROM pages),
bench AS (SELECT 'bench/' || item_id || '.txt' AS path, encode(coalesce(text, '')) AS content FROM benchmark),
last_conv AS (SELECT 'conv/' || max(conv_id) AS dir FROM conversations),
firsts AS (SELECT doc_id, path, content, min(doc_id) OVER (PARTITION BY sha256(content)) AS first FROM docs),
edits AS (SELECT path, CASE WHEN doc_id > first THEN 'remove' ELSE 'fresh' END AS kind FROM firsts WHERE doc_id > first OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
changes AS (
  SELECT path, kind FROM edits UNION ALL SELECT dir, 'remove' FROM last_conv UNION ALL SELECT path, 'fresh' FROM conv WHERE dir IN (SELECT dir FROM last_conv)
  UNION ALL VALUES ('bench', 'new'), ('pages', 'new')),
normal AS (SELECT c.path, c.kind, CASE WHEN c.kind <> 'remove' THEN '/b/' || c.path END AS local_path FROM changes c WHERE NOT EXISTS (SELECT 1 FROM changes o WHERE starts_with(c.path, o.path || '/'))),
a_files AS (SELECT path, content FROM docs UNION ALL SELECT path, content FROM conv),
b_files AS (
  SELECT path, CASE WHEN kind = 'fresh' THEN content || encode(chr(10) || '[reviewed]' || chr(10)) ELSE content END AS content FROM docs LEFT JOIN edits USING (path) WHERE kind IS NULL OR kind <> 'remove'
  UNION ALL SELECT path, content FROM conv WHERE dir NOT IN (SELECT dir FROM last_conv) UNION ALL SELECT * FROM html UNION ALL SELECT * FROM bench)"""


def objects(x: str) -> str:
    """x_pieces and x_objects of x_files."""
    return f"""
{x}_pieces AS (SELECT path, ordinal::INT AS ordinal, (ordinal * {STEP})::BIGINT AS "begin", least((ordinal + 1) * {STEP}, n)::BIGINT AS "end", least((ordinal + 1) * {STEP}, n)::BIGINT - ordinal * {STEP} AS size,
    sha256(array_slice(content, ordinal * {STEP} + 1, (ordinal + 1) * {STEP})) AS chunk_digest
  FROM (SELECT path, content, octet_length(content) AS n, unnest(range(0, (octet_length(content) + {STEP - 1}) // {STEP})) AS ordinal FROM {x}_files)),
{x}_objects AS (SELECT f.path, sha256(unhex(coalesce(string_agg(chunk_digest, '' ORDER BY ordinal), ''))) AS file_digest, count(chunk_digest) AS n_chunks, coalesce(sum(size), 0)::BIGINT AS size
  FROM {x}_files f LEFT JOIN {x}_pieces p USING (path) GROUP BY f.path)"""


def trees(x: str) -> str:
    """x_dirs and x_entries of x_objects, for paths of up to four names."""
    out = [f"""
{x}_leaf AS (SELECT path, 'file' AS kind, file_digest AS digest, len(string_split(path, '/')) AS depth FROM {x}_objects)"""]
    for d in (4, 3, 2, 1):
        above = f" UNION ALL SELECT path, 'dir', tree_digest FROM {x}_dirs{d}" if d < 4 else ""
        out.append(f"""
{x}_entries{d} AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, kind, regexp_extract(path, '([^/]*)$', 1) AS name, digest AS child_digest FROM (SELECT path, kind, digest FROM {x}_leaf WHERE depth = {d}{above})),
{x}_dirs{d - 1} AS (SELECT dir AS path, sha256(string_agg(kind || ' ' || name || ' ' || child_digest || chr(10), '' ORDER BY name)) AS tree_digest,
  sum(octet_length(encode(kind || ' ' || name || ' ' || child_digest || chr(10))))::BIGINT AS encoded_size FROM {x}_entries{d} GROUP BY dir)""")
    union = lambda t: " UNION ALL ".join(f"SELECT * FROM {x}_{t[0]}{d}" for d in t[1])
    out.append(f"""
{x}_dirs AS ({union(('dirs', (3, 2, 1, 0)))}),
{x}_entries AS (SELECT dir, (row_number() OVER (PARTITION BY dir ORDER BY name) - 1)::INT AS ordinal, kind, name, child_digest FROM ({union(('entries', (4, 3, 2, 1)))}))""")
    return ",".join(out)


def version(x: str, time: str) -> str:
    return f"""
{x}_version AS (SELECT sha256(unhex(lpad(to_hex(length('{time}')), 16, '0')) || encode('{time}') || unhex(tree_digest)) AS version_digest, TIMESTAMP '{time.replace('T', ' ').rstrip('Z')}' AS ver_timestamp, tree_digest AS ver_root FROM {x}_dirs WHERE path = '')"""


def sql(select: str, *parts: str) -> str:
    return "WITH " + ",".join([FILES, *parts]) + "\n" + select


def a(select: str) -> str:
    return sql(select, objects("a"), trees("a"), version("a", TIMES["a"]))


def b(select: str) -> str:
    return sql(select, objects("b"), trees("b"), version("b", TIMES["b"]))


def both(select: str) -> str:
    return sql(select, objects("a"), trees("a"), version("a", TIMES["a"]), objects("b"), trees("b"), version("b", TIMES["b"]))


TIMES = {"a": "2024-01-02T03:04:05Z", "b": "2024-02-03T04:05:06.25Z"}
