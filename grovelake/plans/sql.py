"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from ..functions.canon import MAX_DIRECTORY
from ..operators.chunks import CHUNK_SIZES

PATH = "lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt'"
_FILES = f"""files AS (SELECT doc_id, lang, source, {PATH} AS path, encode(coalesce(text, '')) AS content,
    octet_length(encode(coalesce(text, '')))::BIGINT AS size, doc_id % 7 = 0 AS executable FROM documents)"""


def sizes() -> str:
    """The sizes of the chunks of `size` bytes."""
    rest, parts = "size", []
    for s in CHUNK_SIZES:
        parts.append(f"list_transform(range({rest} // {s}), lambda x: {s}::BIGINT)")
        rest = f"({rest} % {s})"
    return f"flatten([{', '.join(parts)}, CASE WHEN {rest} > 0 THEN [{rest}] ELSE [] END])"


#: files, chunks (doc_id, path, ix, offset, size, chunk_id) and file_ids (files with target_id, n_chunks).
CHUNKS = f"""WITH {_FILES}, sized AS (SELECT *, {sizes()} AS sizes FROM files),
placed AS (SELECT doc_id, path, content, ix, sizes[ix + 1] AS size, coalesce(list_sum(sizes[1:ix]), 0)::BIGINT AS "offset" FROM (SELECT *, unnest(range(len(sizes))) AS ix FROM sized)),
chunks AS (SELECT doc_id, path, ix, "offset", size, sha256(array_slice(content, "offset" + 1, "offset" + size)) AS chunk_id FROM placed),
file_ids AS (SELECT f.doc_id, f.lang, f.source, f.path, f.size, f.executable, count(c.ix) AS n_chunks,
    sha256('{{"parts":[' || coalesce(string_agg('{{"content":"' || chunk_id || '","size":' || c.size || ',"type":"Chunk"}}', ',' ORDER BY ix), '') || '],"type":"File"}}') AS target_id
    FROM files f LEFT JOIN chunks c USING (doc_id) GROUP BY f.doc_id, f.lang, f.source, f.path, f.size, f.executable)"""

_KINDS = {
    "file": ("parts", "File", """'{"file":"' || id || '","size":' || size || ',"type":"File"}'"""),
    "directory": ("entries", "Directory", """'{"directory":"' || id || '","firstName":"' || first || '","lastName":"' || last || '","type":"Partial"}'"""),
    "branches": ("branches", "Branches", """'{"branches":"' || id || '","firstName":"' || first || '","lastName":"' || last || '","type":"BranchesEntry"}'"""),
}


def fold(kind: str, items: str, most: int, name: str | None = None) -> str:
    """CTEs for lists (list, ix, item, first, last, size) of up to most ** 3 items; the last is {name}_roots (list, size, object_id)."""
    field, tag, nested = _KINDS[kind]
    name = name or kind

    def level(source: str) -> str:
        return f"""SELECT list, ix // {most} AS ix, sha256('{{"{field}":[' || string_agg(item, ',' ORDER BY ix) || '],"type":"{tag}"}}') AS id, min_by(first, ix) AS first, max_by(last, ix) AS last, sum(size)::BIGINT AS size FROM {source} GROUP BY list, ix // {most}"""

    out = [f"{name}_0 AS ({level(items)})"]
    for k in (1, 2):
        out.append(f"{name}_i{k} AS (SELECT list, ix, {nested} AS item, first, last, size FROM {name}_{k - 1} QUALIFY count(*) OVER (PARTITION BY list) > 1)")
        out.append(f"{name}_{k} AS ({level(f'{name}_i{k}')})")
    single = [f"SELECT list, size, id AS object_id FROM {name}_{k} QUALIFY count(*) OVER (PARTITION BY list) = 1" for k in (0, 1, 2)]
    return ", ".join([*out, f"{name}_roots AS ({' UNION ALL '.join(f'SELECT * FROM ({s})' for s in single)})"])


ORDER_PARTS = """SELECT l_orderkey AS list, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ix, l_quantity::BIGINT AS size, sha256(l_partkey || ':' || l_suppkey) AS chunk_id FROM lineitem"""

CUSTOMER_ENTRIES = """SELECT '' AS list, row_number() OVER (ORDER BY c_name) - 1 AS ix,
    '{"executable":' || (c_custkey % 7 = 0) || ',"file":"' || sha256(c_name) || '","name":"' || c_name || '","size":' || c_custkey || ',"type":"File"}' AS item, c_name AS first, c_name AS last, 0 AS size FROM customer"""

_FILE_ITEM = """'{"executable":' || executable || ',"file":"' || target_id || '","name":"' || name || '","size":' || size || ',"type":"File"}'"""
_DIR_ITEM = """'{"directory":"' || object_id || '","name":"' || name || '","type":"Directory"}'"""


def _dirs(rows: str, item: str, name: str) -> str:
    """CTEs that fold rows (list, name, ...) to directories."""
    items = f"{name}_items AS (SELECT list, row_number() OVER (PARTITION BY list ORDER BY name) - 1 AS ix, {item} AS item, name AS first, name AS last, 0 AS size FROM {rows})"
    return items + ", " + fold("directory", f"{name}_items", MAX_DIRECTORY, name)


#: source_dirs, lang_dirs, root_dir with object_id.
TREE = f"""{CHUNKS}, leaf AS (SELECT lang || '/' || source AS list, regexp_extract(path, '[^/]*$') AS name, size, executable, target_id FROM file_ids),
{_dirs('leaf', _FILE_ITEM, 's')}, source_dirs AS (SELECT split_part(list, '/', 1) AS lang, split_part(list, '/', 2) AS source, object_id FROM s_roots),
{_dirs('(SELECT lang AS list, source AS name, object_id FROM source_dirs)', _DIR_ITEM, 'l')}, lang_dirs AS (SELECT list AS lang, object_id FROM l_roots),
{_dirs("(SELECT '' AS list, lang AS name, object_id FROM lang_dirs)", _DIR_ITEM, 'r')}, root_dir AS (SELECT object_id FROM r_roots)"""

#: entries (path, kind) of the virtual tree, with the root ''.
PATHS = f"""WITH entries AS (SELECT {PATH} AS path, 'File' AS kind FROM documents UNION ALL SELECT DISTINCT lang, 'Directory' FROM documents
UNION ALL SELECT DISTINCT lang || '/' || source, 'Directory' FROM documents UNION ALL SELECT '', 'Directory')"""

SYNC = """SELECT n_name AS store, r_name AS repo_url, (n_nationkey % 2)::VARCHAR AS branch, (n_nationkey % 3)::VARCHAR AS base_commit,
    ['/a', '/a/b/c', '/a/b', '/z', '/a/b/c/d'][n_nationkey % 5 + 1] AS repo_dir FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _version(side: str) -> str:
    """CASE expressions by doc_id % 20 for one side: whether there is a file, the edit, whether the mode flips, whether it is a directory."""
    r, other = "doc_id % 20", {"base": "true", "theirs": "false", "ours": "false"}[side]
    if side == "base":
        return f"{r} < 17 AS there, '' AS edit, false AS flip, false AS dir"
    if side == "theirs":
        return f"""{r} NOT IN (5, 7, 11) AS there, CASE WHEN {r} IN (1, 4, 10, 12, 13, 15, 17, 18, 19) THEN 'A' WHEN {r} = 3 THEN 'E' ELSE '' END AS edit, {r} IN (8, 14) AS flip, {r} IN (12, 13, 15) AS dir"""
    assert other
    return f"""{r} NOT IN (6, 7, 17) AS there, CASE WHEN {r} IN (2, 4, 11, 13, 15, 19) THEN 'B' WHEN {r} = 3 THEN 'E' WHEN {r} = 18 THEN 'A' ELSE '' END AS edit, {r} IN (9, 10, 14) OR doc_id % 40 = 39 AS flip, {r} = 15 AS dir"""


_VERSIONS = " UNION ALL ".join(f"SELECT '{s}' AS side, doc_id, lang, source, coalesce(text, '') AS text, {_version(s)} FROM documents" for s in ("base", "theirs", "ours"))

#: sides (side, path, kind, target_id, size, executable), zipped (a row per path), decided (the rows that count).
ZIPPER = f"""WITH versions AS ({_VERSIONS}),
leaf AS (SELECT side, lang, source, doc_id, dir, CASE WHEN dir THEN 'inner.txt' ELSE lpad(doc_id::VARCHAR, 8, '0') || '.txt' END AS name, {PATH} AS place,
    sha256(text || CASE WHEN edit <> '' THEN chr(10) || edit ELSE '' END) AS target_id, octet_length(encode(text || CASE WHEN edit <> '' THEN chr(10) || edit ELSE '' END))::BIGINT AS size, (doc_id % 7 = 0) <> flip AS executable
    FROM versions WHERE there),
inner_dirs AS (SELECT side, lang, source, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS name, sha256('{{"entries":[' || {_FILE_ITEM} || '],"type":"Directory"}}') AS object_id FROM leaf WHERE dir),
source_rows AS (SELECT side || '/' || lang || '/' || source AS list, name, {_FILE_ITEM} AS item FROM leaf WHERE NOT dir UNION ALL SELECT side || '/' || lang || '/' || source, name, {_DIR_ITEM} FROM inner_dirs),
{_dirs('source_rows', 'item', 's')},
empty_dirs AS (SELECT side || '/' || lang || '/' || source AS list FROM (SELECT DISTINCT lang, source FROM documents), (VALUES ('base'), ('theirs'), ('ours')) t(side)),
source_dirs AS (SELECT e.list, coalesce(object_id, sha256('{{"entries":[],"type":"Directory"}}')) AS object_id FROM empty_dirs e LEFT JOIN s_roots USING (list)),
{_dirs("(SELECT split_part(list, '/', 1) || '/' || split_part(list, '/', 2) AS list, split_part(list, '/', 3) AS name, object_id FROM source_dirs)", _DIR_ITEM, 'l')},
sides AS (
    SELECT side, place || CASE WHEN dir THEN '/inner.txt' ELSE '' END AS path, 'File' AS kind, target_id, size, executable FROM leaf
    UNION ALL SELECT side, lang || '/' || source || '/' || name, 'Directory', object_id, NULL, NULL FROM inner_dirs
    UNION ALL SELECT split_part(list, '/', 1), substr(list, strpos(list, '/') + 1), 'Directory', object_id, NULL, NULL FROM source_dirs
    UNION ALL SELECT split_part(list, '/', 1), split_part(list, '/', 2), 'Directory', object_id, NULL, NULL FROM l_roots),
wide AS (SELECT path, max(kind) FILTER (side = 'base') AS b_kind, max(target_id) FILTER (side = 'base') AS b_id, max(size) FILTER (side = 'base') AS b_size, bool_or(executable) FILTER (side = 'base') AS b_x,
    max(kind) FILTER (side = 'theirs') AS kind_1, max(target_id) FILTER (side = 'theirs') AS id_1, max(size) FILTER (side = 'theirs') AS size_1, bool_or(executable) FILTER (side = 'theirs') AS x_1,
    max(kind) FILTER (side = 'ours') AS kind_2, max(target_id) FILTER (side = 'ours') AS id_2, max(size) FILTER (side = 'ours') AS size_2, bool_or(executable) FILTER (side = 'ours') AS x_2 FROM sides GROUP BY path),
zipped AS (SELECT *, {{c1}} AS change_1, {{c2}} AS change_2 FROM wide),
acted AS (SELECT *, CASE
    WHEN change_1 = change_2 AND id_1 IS NOT DISTINCT FROM id_2 AND x_1 IS NOT DISTINCT FROM x_2 THEN 'TakeEither' WHEN change_1 = 'Unchanged' THEN 'Take2' WHEN change_2 = 'Unchanged' THEN 'Take1'
    WHEN change_1 LIKE '%Removed' AND change_2 LIKE '%Removed' THEN 'Remove' WHEN change_1 = 'DirectoryChanged' AND change_2 = 'DirectoryChanged' THEN 'MergeDirectories'
    WHEN change_1 IN ('DirectoryCreated', 'FileChangedToDirectory') AND change_2 IN ('DirectoryCreated', 'FileChangedToDirectory') THEN 'MergeDirectories'
    WHEN change_1 = 'FileChanged' AND change_2 = 'FileChanged' THEN CASE WHEN b_id <> id_1 AND b_id <> id_2 THEN 'MergeFiles' ELSE 'TakeFile' END
    WHEN change_1 IN ('FileCreated', 'DirectoryChangedToFile') AND change_2 IN ('FileCreated', 'DirectoryChangedToFile') AND x_1 = x_2 THEN 'MergeFiles' ELSE 'Conflict' END AS action FROM zipped),
moded AS (SELECT *, CASE WHEN action IN ('MergeFiles', 'TakeFile') THEN CASE WHEN change_1 = 'FileChanged' THEN CASE WHEN x_1 <> b_x THEN x_1 WHEN x_2 <> b_x THEN x_2 ELSE b_x END ELSE x_1 END END AS mode FROM acted),
decided AS (SELECT * FROM moded m WHERE NOT EXISTS (SELECT 1 FROM moded u WHERE u.action <> 'MergeDirectories' AND starts_with(m.path, u.path || '/')))""".replace(
    "{c1}", "CHANGE1"
).replace("{c2}", "CHANGE2")


def _change(n: int) -> str:
    k, i, x = f"kind_{n}", f"id_{n}", f"x_{n}"
    return f"""CASE WHEN b_kind IS NULL AND {k} IS NULL THEN 'Unchanged' WHEN b_kind IS NULL THEN {k} || 'Created' WHEN {k} IS NULL THEN b_kind || 'Removed'
    WHEN b_kind <> {k} THEN b_kind || 'ChangedTo' || {k} WHEN b_id = {i} AND b_x IS NOT DISTINCT FROM {x} THEN 'Unchanged' ELSE b_kind || 'Changed' END"""


ZIPPER = ZIPPER.replace("CHANGE1", _change(1)).replace("CHANGE2", _change(2))

#: steps (path, step, action, r_id, r_x) to bring a store like `ours` to `theirs`.
RECONCILE = f"""{ZIPPER}, pair AS (SELECT path, kind_1 AS r_kind, id_1 AS r_id, x_1 AS r_x, kind_2 AS s_kind, x_2 AS s_x, id_2 AS s_id,
    ('0x' || substr(sha256(path), 1, 4))::BIGINT % 4 < 3 AS known FROM wide WHERE kind_1 IS NOT NULL OR kind_2 IS NOT NULL),
acts AS (SELECT *, CASE WHEN r_kind IS NULL THEN ['rm'] WHEN s_kind IS NULL THEN CASE WHEN r_kind = 'Directory' THEN ['', 'mkdir'] ELSE ['', 'download'] END
    WHEN r_kind = 'Directory' AND s_kind = 'Directory' THEN [] WHEN r_kind = 'Directory' THEN ['rm', 'mkdir'] WHEN s_kind = 'Directory' THEN ['rm', 'download']
    WHEN known AND s_id = r_id THEN CASE WHEN r_x <> s_x THEN ['', 'chmod'] ELSE [] END ELSE ['rm', 'download'] END AS a FROM pair),
steps AS (SELECT path, unnest(range(len(a))) AS step, unnest(a) AS action, r_id, r_x FROM acts m WHERE NOT (r_kind IS NULL AND EXISTS (
    SELECT 1 FROM acts u WHERE u.s_kind = 'Directory' AND (u.r_kind IS NULL OR u.r_kind = 'File') AND starts_with(m.path, u.path || '/'))) ),
kept_steps AS (SELECT * FROM steps WHERE action <> '')"""
RECONCILE = RECONCILE.replace("steps AS (SELECT path, unnest", "all_steps AS (SELECT path, unnest").replace("kept_steps AS (SELECT * FROM steps WHERE", "steps AS (SELECT * FROM all_steps WHERE")
