"""References in expression text: {{TABLE}}, {{view.member}}, {{entity.field}}, {{dimension}}, {{variables.x}}."""

from __future__ import annotations

import re
from collections.abc import Callable

REF = re.compile(r"\{\{\s*([A-Za-z_][\w]*)(?:\.([A-Za-z_]\w*))?\s*\}\}")
_LITERAL = re.compile(r"'(?:[^']|'')*'|`[^`]*`|\"((?:[^\"]|\"\")*)\"")


def backticked(text: str) -> str:
    """Double-quoted identifiers as Spark writes them; string literals stay."""
    return _LITERAL.sub(lambda m: f"`{m[1].replace('\"\"', '\"')}`" if m[1] is not None else m[0], text)


def names(text: str) -> list[tuple[str, str | None]]:
    """(first, second or None) of every reference."""
    return [(m[1], m[2]) for m in REF.finditer(text)]


def substitute(text: str, value: Callable[[str, str | None], str]) -> str:
    return REF.sub(lambda m: value(m[1], m[2]), text)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_name(name: str) -> str:
    """A dotted table name with the parts quoted that need it."""
    if "`" in name or '"' in name:
        return backticked(name)
    return ".".join(p if re.fullmatch(r"\w+", p) else quoted(p) for p in name.split("."))
