"""Paths as text: folding, ancestors, and names of folders. Nothing looks at a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(parts: str, absolute: str) -> str:
    """SQL: the segments of a path without ``.`` and empty ones, ``..`` taking the segment before it along.

    At an absolute path's root ``..`` stays there; a relative path keeps those that lead out of it.
    """
    step = f"""case when s in ('', '.') then a when s <> '..' then array_append(a, s)
      when size(a) > 0 and element_at(a, -1) <> '..' then slice(a, 1, size(a) - 1) when {absolute} then a else array_append(a, s) end"""
    return f"array_join(aggregate({parts}, cast(array() as array<string>), (a, s) -> {step}), '/')"


def fold(path: str) -> Column:
    """A working folder in one spelling: forward slashes, folded segments, a drive's letter in lower case as a root of its own,
    two leading slashes of a network share kept. Null for null."""
    plain = rf"replace({path}, '\\', '/')"
    drive = f"{plain} rlike '^[A-Za-z]:(/|$)'"
    rest = f"if({drive}, substring({plain}, 3), {plain})"
    absolute = f"({drive} or startswith({rest}, '/'))"
    body = _folded(f"split({rest}, '/')", absolute)
    return F.expr(f"""case when {drive} then concat(lower(substring({plain}, 1, 2)), if({body} = '', '', '/'), {body})
      when startswith({rest}, '//') then if({body} = '', '/', concat('//', {body})) when {absolute} then concat('/', {body}) else {body} end""")


def fold_file(path: str) -> Column:
    """A file's path in one spelling: folded segments, one slash between them, none at the end."""
    return F.expr(f"concat(if(startswith({path}, '/'), '/', ''), {_folded(f"split({path}, '/')", f"startswith({path}, '/')")})")


def ancestors(folded: Column) -> Column:
    """A folded path and all folders above it, the root included if the path is absolute; empty for the empty path."""
    parts = F.split(folded, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    root = F.when(F.startswith(folded, F.lit("/")), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(root, F.filter(above, lambda p: p != "")))


def folder_name(folded: Column) -> Column:
    """The name under which a producer keeps a working folder's logs: all but ASCII letters and digits become dashes."""
    return F.regexp_replace(folded, "[^A-Za-z0-9]", "-")


def child_of(file: str) -> Column:
    """(agent_id, parent_id, parent_file) of a log ``.../<parent>/subagents/.../agent-<id>.jsonl``, else null; the first such folder counts."""
    at = f"array_position(split({file}, '/'), 'subagents')"
    parts, name = f"split({file}, '/')", f"regexp_extract({file}, '(^|/)agent-([^/]+)[.]jsonl$', 2)"
    parent = f"element_at({parts}, cast({at} - 1 as int))"
    return F.expr(f"""case when {at} > 1 and {name} <> '' then case when {parent} <> '' then
      named_struct('agent_id', {name}, 'parent_id', {parent}, 'parent_file', concat(array_join(slice({parts}, 1, cast({at} - 1 as int)), '/'), '.jsonl')) end end""")
