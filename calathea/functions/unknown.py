"""JSON of unknown shape as VARIANT columns: read what is there, as what it should be, and never fail.

A text that is no JSON, a key that isn't there and a value of another kind are null alike (``read``), or what the caller
wants for them. Nothing is parsed by hand and no schema is given; ``shape`` tells what a table's texts look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The text as a variant; null if it is no JSON."""
    return F.try_parse_json(text)


def island(text: Column, opened: str = '<script type="application/json"', closed: str = "</script>") -> Column:
    """The JSON between an element's tags in a page, as a variant; null without."""
    start = F.instr(text, opened)
    body = F.substring_index(F.when(start > 0, F.substr(text, start)), closed, 1)
    return parsed(F.when(body.contains(">"), F.substr(body, F.instr(body, ">") + 1)))


def read(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]), if it is of the kind or can be read as such; else null."""
    return F.try_variant_get(value, path, kind)


def text(value: Column, path: str, most: int) -> Column:
    """At most so many characters of what is at a path, whatever it is: "" where nothing is."""
    return F.left(F.coalesce(F.try_variant_get(value, path, "string"), F.lit("")), F.lit(most))


def elements(value: Column, path: str) -> Column:
    """The texts of an array, joined ones taken apart at commas, trimmed, without empty and null ones; none if what is at
    the path is no array. Elements that are no texts are kept as they are written."""
    items = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    flat = F.flatten(F.transform(items, lambda v: F.coalesce(F.split(F.try_variant_get(v, "$", "string"), ","), F.array().cast("array<string>"))))
    return F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: x != "")


def flags(value: Column, path: str) -> Column:
    """The object at a path as a map of its keys to texts; empty if it is none."""
    return F.coalesce(F.try_variant_get(value, path, "map<string,string>"), F.create_map().cast("map<string,string>"))


def box_area(value: Column, path: str = "$") -> Column:
    """(x2 - x1) * (y2 - y1) of an array of four numbers; 0 for anything else."""
    x = F.try_variant_get(value, path, "array<double>")
    area = (F.get(x, 2) - F.get(x, 0)) * (F.get(x, 3) - F.get(x, 1))
    return F.coalesce(F.when(F.size(x) == 4, area), F.lit(0.0))


def shape(rows: DataFrame, column: str) -> str:
    """What a table's texts look like, as a type: that of all their keys, and of what stands at each."""
    return rows.select(F.schema_of_variant_agg(parsed(F.col(column)))).first()[0]
