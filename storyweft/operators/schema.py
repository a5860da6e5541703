"""JSON documents against a JSON Schema: every rule that is broken, not just the first.

Understood are ``type``, ``required``, ``properties``, ``additionalProperties: false``,
``enum``, ``pattern``, the length, item and value limits, ``items`` and ``$ref`` within
the document. Documents go through Arrow in batches; each is looked at on its own.
"""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: (isinstance(v, int) or (isinstance(v, float) and v.is_integer())) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
}


def load_schema(path: str) -> dict[str, Any]:
    """The JSON Schema of a file; anything but an object is an error."""
    schema = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(schema, dict):
        raise ValueError(f"{path} holds no JSON object")
    return schema


def broken_rules(value: Any, schema: dict[str, Any], root: dict[str, Any] | None = None, at: str = "") -> set[str]:
    """``place: rule`` of each rule that ``value`` breaks; places leave out the numbers of list elements."""
    root = schema if root is None else root
    while "$ref" in schema:
        node: Any = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            node = node[part]
        schema = node
    place = at or "document"
    kind = schema.get("type")
    if kind and not _TYPES[kind](value):
        return {f"{place}: type"}
    out: set[str] = set()
    say = lambda rule, bad: out.add(f"{place}: {rule}") if bad else None
    say("enum", "enum" in schema and value not in schema["enum"])
    if isinstance(value, str):
        say("pattern", "pattern" in schema and not re.search(schema["pattern"], value))
        say("minLength", len(value) < schema.get("minLength", 0))
        say("maxLength", len(value) > schema.get("maxLength", len(value)))
    elif isinstance(value, list):
        say("minItems", len(value) < schema.get("minItems", 0))
        say("maxItems", len(value) > schema.get("maxItems", len(value)))
        for x in value if "items" in schema else ():
            out |= broken_rules(x, schema["items"], root, at)
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            say(f"{name} is missing", name not in value)
        if schema.get("additionalProperties") is False:
            for name in value:
                say("unknown field", name not in known)
        for name, part in known.items():
            if name in value:
                out |= broken_rules(value[name], part, root, f"{at}/{name}" if at else name)
    elif isinstance(value, int | float) and not isinstance(value, bool):
        say("minimum", "minimum" in schema and value < schema["minimum"])
        say("maximum", "maximum" in schema and value > schema["maximum"])
    return out


def schema_errors(text: Column, schema: dict[str, Any]) -> Column:
    """Sorted list of the broken rules of a JSON text; a text that can't be read gives one, NULL among them."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                return ["document: unreadable"]
            return sorted(broken_rules(value, schema))

        return texts.map(one)

    return check(text)
