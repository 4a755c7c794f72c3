"""SQL text of strptime formats, back-references and raw backslashes, as Spark reads it.

Only three functions are looked at; whatever else a query holds stays as it is.
"""

from __future__ import annotations

import re

from lumenframe.functions.dates import java_format
from lumenframe.functions.text import java_replacement

TOKEN = re.compile(r"""(?P<skip>--[^\n]*|/\*.*?\*/|\s+)|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<word>[A-Za-z_]\w*)|(?P<other>.)""", re.S)
#: Functions and the Spark function for each: texts that don't fit the format give null.
FORMATS = {"TO_DATE": "try_to_date", "TO_TIMESTAMP": "try_to_timestamp"}


def _arguments(tokens: list[tuple[str, str]], at: int) -> tuple[list[list[int]], int]:
    """Numbers of the tokens of each argument of the call whose bracket opens at ``at``, and where it closes."""
    depth, args = 0, [[]]
    for i in range(at, len(tokens)):
        kind, text = tokens[i]
        if kind == "other" and text in "()[]":
            depth += 1 if text in "([" else -1
            if not depth:
                return args, i
            if i == at:
                continue
        if kind == "other" and text == "," and depth == 1:
            args.append([])
        elif kind != "skip":
            args[-1].append(i)
    return args, len(tokens)


def _literal(tokens: list[tuple[str, str]], arg: list[int]) -> str | None:
    """The value of an argument that is one text literal; a backslash in it is a backslash."""
    return tokens[arg[0]][1][1:-1].replace("''", "'") if len(arg) == 1 and tokens[arg[0]][0] == "text" else None


def _spelled(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spark_sql(query: str) -> str:
    """``TO_DATE`` and ``TO_TIMESTAMP`` take ``%Y-%m-%d`` formats; ``REGEXP_REPLACE`` takes ``\\1`` and single backslashes.

    Formats without a percent sign are Spark's own and stay.
    """
    tokens = [(m.lastgroup, m.group()) for m in TOKEN.finditer(query)]
    for i, (kind, text) in enumerate(list(tokens)):
        name = text.upper()
        if kind != "word" or name not in {*FORMATS, "REGEXP_REPLACE"}:
            continue
        opens = next((j for j in range(i + 1, len(tokens)) if tokens[j][0] != "skip"), None)
        if opens is None or tokens[opens] != ("other", "("):
            continue
        args, _ = _arguments(tokens, opens)
        if name in FORMATS:
            value = _literal(tokens, args[1]) if len(args) == 2 else None
            if value is not None and "%" in value:
                tokens[i] = ("word", FORMATS[name])
                tokens[args[1][0]] = ("text", _spelled(java_format(value)))
        elif len(args) in (3, 4):
            pattern, new = (_literal(tokens, a) for a in args[1:3])
            if pattern is not None:
                tokens[args[1][0]] = ("text", _spelled(pattern))
            if new is not None:
                tokens[args[2][0]] = ("text", _spelled(java_replacement(new)))
    return "".join(t for _, t in tokens)
