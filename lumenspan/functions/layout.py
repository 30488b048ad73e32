"""Rows as text, as column expressions: the code-first layout, templates, comma-separated values, short hashes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATOR_COLUMN = 140


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def located(code: Column, file: Column, line: Column) -> Column:
    """Code, then file:line in a column of its own; widths are bytes, and code that is too wide gets two spaces."""
    code = F.regexp_replace(code, r"[ \t]+\z", "")
    gap = F.greatest(F.lit(LOCATOR_COLUMN) - F.octet_length(code), F.lit(0))
    space = F.when(gap > 0, F.repeat(F.lit(" "), gap)).otherwise("  ")
    return F.concat(code, space, base_name(file), F.lit(":"), line.cast("string"))


def csv_field(value: Column) -> Column:
    """A field, quoted where it holds a comma, a quote or a line end, or starts with a space; null is empty."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[,"\n\r]|^ '), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_row(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, values))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def file_name(name: Column) -> Column:
    """A name that can be a file's: other characters become underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def scrubbed(line: Column) -> Column:
    """A line without the contents of quotes, and without a comment at its end."""
    return F.regexp_replace(F.regexp_replace(line, r"""'[^'\n]*'|"[^"\n]*"|`[^`\n]*`""", " "), r"//.*", "")


def simple_name(type_: Column) -> Column:
    """A type's name without package and parameters."""
    return F.trim(F.element_at(F.split(F.split_part(type_, F.lit("<"), F.lit(1)), r"\."), -1))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))
