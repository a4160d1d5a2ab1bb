"""Shell commands to argument lists, as an Arrow function; everything after that is column expressions.

A command is cut by one pattern of tokens: an operator (``&&``, ``||``, ``;``, ``|`` or a line end) or a word, in which quoted
parts count whole. So an operator or a program's name inside quotes never begins a command. Only a shell's own ``-c`` script
is opened, as far as ``DEPTH`` shells deep; a text given to any other program stays one argument of it.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Programs whose script argument is a command, and the options that announce it.
SHELLS = {"sh", "bash", "zsh", "dash"}
SCRIPT_OPTIONS = {"-c", "-lc", "-ic", "-lic"}
DEPTH = 4

_QUOTED = r"""'[^']*(?:'|\Z)|"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|\\.|\\\Z"""
_TOKEN = re.compile(rf"""(?P<end>&&|\|\||[;|\n])|(?P<word>(?:{_QUOTED}|&(?!&)|[^ \t\r\n;|&'"\\])+)""", re.S)
_PART = re.compile(_QUOTED, re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def _plain(part: re.Match) -> str:
    """A quoted part as the program sees it; in double quotes and bare text a backslash stands for the next character."""
    text = part[0]
    if text[0] == "'":
        return text[1:-1] if len(text) > 1 and text[-1] == "'" else text[1:]
    if text[0] == '"':
        closed = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', text, re.S)
        return _ESCAPE.sub(r"\1", closed[1] if closed else text[1:])
    return text[1:] or text


def commands(text: str) -> list[list[str]]:
    """The argument lists of a command line; empty commands are left out."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.finditer(text):
        if token["end"]:
            out.append([])
        else:
            out[-1].append(_PART.sub(_plain, token["word"]))
    return [c for c in out if c]


def opened(argv: list[str], depth: int = DEPTH) -> list[list[str]]:
    """The commands that an argument list runs: those of its script if it is a shell with one, else itself."""
    flag = next((i for i, a in enumerate(argv) if a in SCRIPT_OPTIONS), len(argv))
    if depth == 0 or not argv or re.sub(r"/+\Z", "", argv[0]).rpartition("/")[2] not in SHELLS or flag + 1 >= len(argv):
        return [argv] if argv else []
    return [c for inner in commands(argv[flag + 1]) for c in opened(inner, depth - 1)]


def invoked(raw: str | None) -> list[list[str]]:
    """All commands of a tool call's input: a command line, or JSON with one, or with an argument list, in ``command`` or ``cmd``."""
    try:
        given = json.loads(raw) if raw else raw
    except ValueError:
        given = raw
    if isinstance(given, dict):
        given = given.get("cmd") if given.get("command") is None else given["command"]
    if isinstance(given, list):
        found = [given] if all(isinstance(a, str) for a in given) else []
    else:
        found = commands(given) if isinstance(given, str) else []
    return [c for argv in found for c in opened(argv)]


def invocations(command: Column) -> Column:
    """array<array<string>>: the argument lists that a call's input runs, in order; empty for null or other inputs.

    Equal inputs of a batch are cut once.
    """

    @F.arrow_udf("array<array<string>>")
    def cut(inputs: pa.Array) -> pa.Array:
        coded = inputs.dictionary_encode()
        found = pa.array([invoked(x) for x in coded.dictionary.to_pylist()], pa.list_(pa.list_(pa.string())))
        return found.take(coded.indices).fill_null([]) if inputs.null_count else found.take(coded.indices)

    return cut(command)
