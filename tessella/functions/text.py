"""Slide property texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.arrays import let

_EDGE = r"^[\x00-\x20]+|[\x00-\x20]+$"


def strip(s: Column) -> Column:
    """Without characters up to the space at both ends."""
    return F.regexp_replace(s, _EDGE, "")


def trim_nul(s: Column) -> Column:
    return F.regexp_replace(s, r"\x00+$", "")


def _last_of_each(entries: Column) -> Column:
    """Map of (key, value) entries; of repeated keys the last value stands."""
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(let(entries, last))


def description_header(text: Column) -> Column:
    """First line of a slide description."""
    return strip(F.element_at(F.split(F.element_at(F.split(trim_nul(text), r"\|"), 1), r"\r\n|\n|\r"), 1))


def description_properties(text: Column) -> Column:
    """The fields after the first bar: ``key = value`` at the first equals sign; fields without one map to an empty text."""
    fields = F.filter(F.slice(F.split(trim_nul(text), r"\|"), 2, 1 << 20), lambda f: strip(f) != "")
    entry = lambda f: F.struct(strip(F.substring_index(f, "=", 1)).alias("k"), F.when(F.instr(f, "=") > 0, strip(F.substring(f, F.instr(f, "=") + 1, F.length(f)))).otherwise("").alias("v"))
    return _last_of_each(F.transform(fields, entry))


def line_properties(text: Column) -> Column:
    """``key=value`` lines, both sides not empty."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda s: (strip(F.substring_index(s, "=", 1)) != "") & (F.instr(s, "=") > 0) & (strip(F.substring(s, F.instr(s, "=") + 1, F.length(s))) != ""))
    entry = lambda s: F.struct(strip(F.substring_index(s, "=", 1)).alias("k"), strip(F.substring(s, F.instr(s, "=") + 1, F.length(s))).alias("v"))
    return _last_of_each(F.transform(lines, entry))


def associated_name(line: Column) -> Column:
    """The leading word in lower case; empty unless the text begins with a letter."""
    return F.lower(F.regexp_extract(line, r"^(\p{L}[\p{L}\p{Nd}]*)", 1))


def number(s: Column) -> Column:
    """A double, or null for text that is none."""
    return s.try_cast("double")


def has_vendor(text: Column, vendor: str) -> Column:
    return F.lower(F.substring(text, 1, len(vendor))) == vendor.lower()
