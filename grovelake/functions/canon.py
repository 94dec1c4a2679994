"""Canonical JSON (RFC 8785) of the five kinds of objects as column expressions, and object ids: SHA-256 in lower-case hex.

Keys are written in sorted order without white space. Every object is rendered by concatenation, so a variant holds
its own fields alone, and control characters get lower-case escapes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most entries of a directory, file and branches node.
MAX_DIRECTORY, MAX_FILE, MAX_BRANCHES = 256, 64, 64
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def json_string(value: Column) -> Column:
    """A JSON string; the 32 control characters are looked for only where one stands."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(_SHORT.get(k, f"\\u{k:04x}"))), range(32), plain)
    return F.concat(F.lit('"'), F.when(value.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"'))


def object_id(data: Column) -> Column:
    return F.sha2(data, 256)


def text_id(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def chunk_part(size: Column, content: Column) -> Column:
    return _text('{"content":"', content, '","size":', size.cast("string"), ',"type":"Chunk"}')


def nested_file_part(size: Column, file: Column) -> Column:
    return _text('{"file":"', file, '","size":', size.cast("string"), ',"type":"File"}')


def file_entry(name: Column, size: Column, executable: Column, file: Column) -> Column:
    return _text('{"executable":', executable.cast("string"), ',"file":"', file, '","name":', json_string(name), ',"size":', size.cast("string"), ',"type":"File"}')


def directory_entry(name: Column, directory: Column) -> Column:
    return _text('{"directory":"', directory, '","name":', json_string(name), ',"type":"Directory"}')


def partial_directory(first: Column, last: Column, directory: Column) -> Column:
    return _text('{"directory":"', directory, '","firstName":', json_string(first), ',"lastName":', json_string(last), ',"type":"Partial"}')


def branch(name: Column, commit: Column) -> Column:
    return _text('{"commit":"', commit, '","name":', json_string(name), ',"type":"Branch"}')


def branches_entry(first: Column, last: Column, branches: Column) -> Column:
    return _text('{"branches":"', branches, '","firstName":', json_string(first), ',"lastName":', json_string(last), ',"type":"BranchesEntry"}')


def directory_object(items: Column) -> Column:
    """items: the entries' JSON, in order."""
    return _text('{"entries":[', F.array_join(items, ","), '],"type":"Directory"}')


def file_object(items: Column) -> Column:
    return _text('{"parts":[', F.array_join(items, ","), '],"type":"File"}')


def branches_object(items: Column) -> Column:
    return _text('{"branches":[', F.array_join(items, ","), '],"type":"Branches"}')


def commit_object(directory: Column, parents: Column, timestamp: Column, author: Column, committer: Column, message: Column) -> Column:
    """parents: an array of ids. Metadata and its members are left out where null."""
    members = [("author", author), ("committer", committer), ("message", message), ("timestamp", timestamp)]
    given = F.array_compact(F.array(*(F.when(v.isNotNull(), _text(f'"{k}":', json_string(v))) for k, v in members)))
    metadata = F.when(F.size(given) > 0, _text('"metadata":{', F.array_join(given, ","), "},")).otherwise("")
    ids = F.array_join(F.transform(parents, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ",")
    return _text('{"directory":"', directory, '",', metadata, '"parents":[', ids, '],"type":"Commit"}')


def root_object(timestamp: Column, default_branch: Column, branches: Column, previous: Column) -> Column:
    """previousRoot is written as null where there is none."""
    before = F.when(previous.isNull(), "null").otherwise(_text('"', previous, '"'))
    return _text('{"branches":"', branches, '","defaultBranchName":', json_string(default_branch), ',"previousRoot":', before, ',"timestamp":', json_string(timestamp), ',"type":"Root"}')
