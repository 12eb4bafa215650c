"""JSON schemas compiled to columns: what is wrong with a JSON value, told by place.

``violations`` turns a schema into one expression over a variant, so checking answers is a projection without Python. Understood are type (one or a list),
enum, const, required, properties, additionalProperties, items, minItems, maxItems, minLength, maxLength, pattern (Java's dialect), minimum, maximum,
anyOf, allOf and local ``$ref``. Other keywords are ignored, and a schema that refers to itself is refused.

Each value and its type are read once: bound to a lambda's variable, as Spark evaluates an expression anew in every branch that uses it, which
nesting would multiply.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXTS = "array<string>"
#: how Spark names the types of a variant
_KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "integer": "BIGINT", "number": "DOUBLE|DECIMAL|BIGINT|FLOAT"}


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _when(bad: Column, at: Column, what: str | Column) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(at, F.lit(" "), what))).otherwise(_none())


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), an array<string>, where value is computed once however often it is used."""
    # not element 0 of a transform: that works out its type anew for each row, through all that is nested in it
    return F.aggregate(F.array(value), _none(), lambda _, x: use(x))


def _is(value: Column, told: Column, kind: str) -> Column:
    """Whether a variant, whose type is told, is of a kind."""
    whole = F.lit(False)
    for name in _KINDS[kind].split("|"):
        whole = whole | F.startswith(told, F.lit(name))
    if kind == "integer":  # 3.0 is one as well
        number = F.try_variant_get(value, "$", "double")
        return F.coalesce(whole | (_is(value, told, "number") & (number == F.floor(number))), F.lit(False))
    return F.coalesce(whole, F.lit(False))


def _child(name: str) -> str:
    if '"' in name:
        raise ValueError(f"a property cannot be called {name}")
    return f'$["{name}"]'


def _resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    while "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen:
            raise ValueError(f"{ref} refers to itself")
        if not ref.startswith("#/"):
            raise ValueError(f"{ref} is not in this schema")
        found = root
        for part in ref[2:].split("/"):
            found = found[part.replace("~1", "/").replace("~0", "~")]
        seen, schema = (*seen, ref), {k: v for k, v in schema.items() if k != "$ref"} | found
    return schema, seen


def violations(value: Column, schema: dict, at: Column | str = "$", root: dict | None = None, seen: tuple[str, ...] = ()) -> Column:
    """array<string> of what ``schema`` has against a variant that is not null; empty if nothing."""
    at = F.lit(at) if isinstance(at, str) else at
    root = root or schema
    schema, seen = _resolved(schema, root, seen)
    return _once(value, lambda v: _once(F.schema_of_variant(v), lambda told: _violations(v, told, schema, at, root, seen)))


def _violations(value: Column, told: Column, schema: dict, at: Column, root: dict, seen: tuple[str, ...]) -> Column:
    """The same for a value, its type and a schema without a reference."""
    found: list[Column] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        right = F.lit(False)
        for kind in kinds:
            right = right | _is(value, told, kind)
        found.append(_when(~right, at, f"is not of type {' or '.join(kinds)}"))
    allowed = [schema["const"]] if "const" in schema else schema.get("enum")
    if allowed is not None:
        texts = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in allowed]
        found.append(_when(~F.coalesce(F.to_json(value), F.lit("null")).isin(*texts), at, f"is not one of {', '.join(texts)}"))
    text = F.when(_is(value, told, "string"), F.try_variant_get(value, "$", "string"))
    if "minLength" in schema:
        found.append(_when(F.length(text) < schema["minLength"], at, f"is shorter than {schema['minLength']}"))
    if "maxLength" in schema:
        found.append(_when(F.length(text) > schema["maxLength"], at, f"is longer than {schema['maxLength']}"))
    if "pattern" in schema:
        found.append(_when(~text.rlike(schema["pattern"]), at, f"does not match {schema['pattern']}"))
    number = F.when(_is(value, told, "number"), F.try_variant_get(value, "$", "double"))
    if "minimum" in schema:
        found.append(_when(number < schema["minimum"], at, f"is less than {schema['minimum']}"))
    if "maximum" in schema:
        found.append(_when(number > schema["maximum"], at, f"is more than {schema['maximum']}"))
    for name in schema.get("required", ()):
        found.append(_when(_is(value, told, "object") & F.try_variant_get(value, _child(name), "variant").isNull(), at, f"has no {name}"))
    for name, own in schema.get("properties", {}).items():
        found.append(_once(F.try_variant_get(value, _child(name), "variant"), lambda child, name=name, own=own: F.when(child.isNotNull(), violations(child, own, F.concat(at, F.lit(f".{name}")), root, seen)).otherwise(_none())))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        more = F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast(_TEXTS)))
        found.append(_when(F.size(more) > 0, at, F.concat(F.lit("has also "), F.array_join(more, ", "))))
    if schema.keys() & {"minItems", "maxItems", "items"}:
        entries = F.when(_is(value, told, "array"), F.try_variant_get(value, "$", "array<variant>"))
        found.append(_once(entries, lambda own: _of_entries(own, schema, at, root, seen)))
    for own in schema.get("allOf", ()):
        found.append(violations(value, own, at, root, seen))
    if "anyOf" in schema:
        fits = F.lit(False)
        for own in schema["anyOf"]:
            fits = fits | (F.size(violations(value, own, at, root, seen)) == 0)
        found.append(_when(~fits, at, "fits none of the schemas allowed"))
    return F.concat(*found) if found else _none()


def _of_entries(entries: Column, schema: dict, at: Column, root: dict, seen: tuple[str, ...]) -> Column:
    """What a schema has against the entries of an array, null if there is none, and against each of them."""
    found = [_none()]
    if "minItems" in schema:
        found.append(_when(F.size(entries) < schema["minItems"], at, f"has fewer than {schema['minItems']} entries"))
    if "maxItems" in schema:
        found.append(_when(F.size(entries) > schema["maxItems"], at, f"has more than {schema['maxItems']} entries"))
    if schema.get("items"):
        each = F.transform(entries, lambda x, i: violations(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), root, seen))
        found.append(F.coalesce(F.flatten(each), _none()))
    return F.concat(*found)


def problems(text: Column, schema: dict) -> Column:
    """What a schema has against a text that should be JSON; no JSON at all is a problem too."""
    return _once(F.try_parse_json(text), lambda value: F.when(value.isNull(), F.array(F.lit("$ is not JSON"))).otherwise(violations(value, schema)))
