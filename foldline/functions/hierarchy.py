"""Dotted classes (fold.superfamily.family) and ids as columns; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def level(dotted: str | Column, n: int) -> Column:
    """The first n components, or null if there are fewer."""
    parts = F.split(_col(dotted), r"\.")
    return F.when(F.size(parts) >= n, F.array_join(F.slice(parts, 1, n), "."))


def fold(dotted: str | Column) -> Column:
    return level(dotted, 2)


def superfamily(dotted: str | Column) -> Column:
    return level(dotted, 3)


def family(dotted: str | Column) -> Column:
    """The whole class, if it has four components or more."""
    return F.when(F.size(F.split(_col(dotted), r"\.")) >= 4, _col(dotted))


def first_two(dotted: str | Column) -> Column:
    """Like fold, without asking that there are two."""
    return F.substring_index(_col(dotted), ".", 2)


def parent(dotted: str | Column) -> Column:
    """Without the last numeric component."""
    return F.regexp_replace(_col(dotted), r"\.[0-9]+$", "")


def group_id(sid: str | Column) -> Column:
    """The four characters after the d of a domain id, else the id."""
    s = _col(sid)
    return F.when(s.startswith("d") & (F.char_length(s) >= 5), F.substring(s, 2, 4)).otherwise(s)


def alignment_id(stem: str, source_row: Column, sid1: Column, sid2: Column) -> Column:
    return F.concat_ws(":", F.lit(stem), source_row, sid1, sid2)


def sid_of_path(path: str | Column) -> Column:
    """File name without .pdb or .ent."""
    return F.regexp_replace(F.regexp_extract(_col(path), r"([^/]+)$", 1), r"\.(pdb|ent)$", "")


def mebibytes(n: str | Column) -> Column:
    return F.format_string("%.1f MiB", _col(n) / F.lit(1048576.0))
