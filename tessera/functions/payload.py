"""Model payloads: JSON out of loose text, and the shapes that count as the expected one."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Per kind: the canonical key, other keys that count as it, and the fields that each item must have.
SHAPES = {
    "entities": ("entities", ("items", "results"), ("name",)),
    "edges": ("edges", ("missing_edges", "new_edges", "additional_edges"), ("source", "target", "fact")),
    "assignments": ("assignments", (), ("category", "indexes")),
    "selections": ("selections", (), ("name",)),
}


def salvage(text: str | None):
    """The first JSON object or array in a text, or None."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for start in (k for k, c in enumerate(text) if c in "{["):
        try:
            return decoder.raw_decode(text, start)[0]
        except ValueError:
            continue
    return None


def coerce(value, kind: str) -> list[dict] | None:
    """The list of items in a payload: bare, under the key or another name for it, or the first list that fits."""
    key, other, fields = SHAPES[kind]
    if isinstance(value, list):
        return value
    if not isinstance(value, dict):
        return None
    for name in (key, *other):
        if isinstance(value.get(name), list):
            return value[name]
    for items in value.values():
        if isinstance(items, list) and items and all(isinstance(x, dict) and set(fields) <= set(x) for x in items):
            return items
    return None


def payload_items(c: Column, kind: str) -> Column:
    """The items of a payload column as a JSON array; null if no shape fits.

    Clean JSON under the canonical key is read in the JVM; only text that is not goes to Python.
    """
    slow = F.udf(lambda t: None if (x := coerce(salvage(t), kind)) is None else json.dumps(x, sort_keys=True), StringType())
    quick = F.try_parse_json(c)
    direct = F.to_json(F.try_variant_get(quick, f"$.{SHAPES[kind][0]}", "variant"))
    return F.coalesce(direct, slow(c))


def judged_correct(c: Column) -> Column:
    """A judge's payload as true or false: ``is_correct``, or ``result`` of ``correct``."""
    value = F.try_parse_json(c)
    return F.coalesce(F.try_variant_get(value, "$.is_correct", "boolean"), F.lower(F.try_variant_get(value, "$.result", "string")) == "correct")
