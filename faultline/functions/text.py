"""Text expressions: templates, first-hit word lists, truncation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **values: Column) -> Column:
    """The template as a column, each {name} replaced by values[name]."""
    parts = re.split(r"\{(\w+)\}", template)
    columns = [values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*columns) if len(columns) > 1 else columns[0]


def first_hit(text: Column, words: Iterable[tuple[Iterable[str], str]], default: str) -> Column:
    """The label of the first word list with a word inside lower(text)."""
    lowered = F.lower(text)
    result: Column | None = None
    for group, label in words:
        hit = F.lit(False)
        for word in group:
            hit = hit | lowered.contains(word)
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise(default)


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """table[key], or the default; the key is evaluated once, unlike in a chain of WHENs."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


# all white space of Unicode, which Python's str.strip takes off
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def py_strip(text: Column) -> Column:
    """Strip all white space, as Python's str.strip (a plain SQL trim takes blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def non_blank(text: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    stripped = py_strip(text)
    return F.when(stripped != "", stripped)


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """The text as a quoted JSON string; `ascii_only` writes others as \\u escapes, in pairs beyond the first plane."""
    listed = F.to_json(F.array(text))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    if not ascii_only:
        return quoted

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(character: Column) -> Column:
        code = F.ascii(character)
        pair = F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit((code - 0x10000) % 1024 + 0xDC00))
        return F.when(code < 128, character).when(code < 0x10000, unit(code.cast("bigint"))).otherwise(pair)

    spelled = F.array_join(F.transform(F.split(quoted, ""), escaped), "")
    return F.when(quoted.rlike(r"[^\x00-\x7f]"), spelled).otherwise(quoted)
