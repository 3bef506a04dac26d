"""Column names in SQL expression texts: which are used, and the text after renaming."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

#: Strings are passed over; names after a dot are fields, names before a parenthesis functions.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`(?P<quoted>(?:[^`]|``)*)`|(?<![\w.])(?P<bare>[A-Za-z_]\w*)(?!\w|\s*\()""")


def _named(m: re.Match) -> str | None:
    return m["quoted"].replace("``", "`") if m["quoted"] is not None else m["bare"]


def references(text: str, columns: Iterable[str]) -> set[str]:
    """Those of ``columns`` that the expression uses; names are compared without case, as Spark does."""
    known = {c.lower(): c for c in columns}
    used = (_named(m) for m in _TOKEN.finditer(text))
    return {known[n.lower()] for n in used if n and n.lower() in known}


def renamed(text: str, names: Mapping[str, str]) -> str:
    """The expression with columns called by their new names."""
    new = {k.lower(): v for k, v in names.items() if k != v}

    def swap(m: re.Match) -> str:
        name = _named(m)
        return "`" + new[name.lower()].replace("`", "``") + "`" if name and name.lower() in new else m[0]

    return _TOKEN.sub(swap, text)
