"""Matching under a column's collation: case and accent rules.

Accents are folded as in the databases whose collations ignore them: a character that Unicode
decomposes into a base and combining marks counts as its base, and marks of their own count as
nothing.  The folding is one ``translate`` with a table made from the decomposition rule, and one
``regexp_replace``; both run in codegen, and the folded text is matched like any other, so ordered
parts keep their order and their places.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = r"\p{M}+"


@lru_cache(1)
def accent_table() -> tuple[str, str]:
    """Characters of the basic plane that are a base with marks, and their bases."""
    accented, bases = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char) if not 0xD800 <= code <= 0xDFFF else char
        if len(parts) > 1 and all(unicodedata.category(m).startswith("M") for m in parts[1:]):
            accented.append(char)
            bases.append(parts[0])
    return "".join(accented), "".join(bases)


def fold_accents(text: Column) -> Column:
    """``text`` without accents: ``\u00c9t\u00e9`` and ``E\u0301te\u0301`` give ``Ete``."""
    accented, bases = accent_table()
    return F.regexp_replace(F.translate(text, accented, bases), _MARKS, "")


def fold_accents_text(text: str) -> str:
    """The same for one Python string."""
    accented, bases = accent_table()
    plain = text.translate(str.maketrans(accented, bases))
    return "".join(c for c in plain if not unicodedata.category(c).startswith("M"))


def collation_rules(name: str) -> dict[str, bool]:
    """The match rules of a database collation, read off its name: ``Latin1_General_CI_AI`` ignores
    case and accents, ``_CS_AS`` and ``_BIN`` neither; a part that is missing means sensitive."""
    parts = re.split(r"_", name.upper())
    binary = any(p in ("BIN", "BIN2") for p in parts)
    return {
        "case_sensitive": binary or "CI" not in parts,
        "accent_sensitive": binary or "AI" not in parts,
    }
