"""JSON documents against a JSON Schema, compiled to column expressions over variants: what is wrong, and where.

Keywords: type, enum, const, properties, required, additionalProperties, propertyNames, items, minItems, maxItems,
uniqueItems, minLength, maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, allOf, anyOf, oneOf, not
and ``$ref`` within the schema. ``format`` is an annotation. Others are an error when the schema is compiled, not passed
over. References are put in place of each other, one that refers to itself ``depth`` times: documents nested deeper say so.
A pattern is a constant of the plan and is searched, not anchored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM = "array<struct<path: string, message: string>>"
_KNOWN = {"type", "enum", "const", "properties", "required", "additionalProperties", "propertyNames", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "allOf", "anyOf", "oneOf", "not", "$ref", "$defs", "definitions", "$schema", "$id", "title", "description", "format", "default", "examples", "$comment", "deprecated"}
_KINDS = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "integer": ["BIGINT"]}


class _Compiler:
    def __init__(self, root: dict, depth: int):
        self.root, self.depth = root, depth

    def named(self, ref: str):
        if not ref.startswith("#"):
            raise ValueError(f"{ref}: only references within the schema")
        node = self.root
        for part in ref.lstrip("#").split("/"):
            node = node[part.replace("~1", "/").replace("~0", "~")] if part else node
        return node

    def problems(self, schema, value: Column, path: Column, open_: tuple = ()) -> Column:
        """PROBLEM of a value that is there."""
        if isinstance(schema, bool):
            return _empty() if schema else _say(path, F.concat(F.lit("False schema does not allow "), F.to_json(value)))
        if extra := set(schema) - _KNOWN:
            raise ValueError(f"keywords {sorted(extra)} are not known")
        kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        # Each value and its kind are evaluated once, as variables of a lambda.
        bound = F.transform(F.array(F.struct(value.alias("v"), kind.alias("k"))), lambda x: self._all(schema, x["v"], x["k"], path, open_))
        return F.flatten(bound)

    def _all(self, schema: dict, v: Column, k: Column, path: Column, open_: tuple) -> Column:
        out: list[Column] = []
        shown = F.to_json(v)
        when = lambda bad, message: out.append(F.when(bad, _say(path, message)).otherwise(_empty()))
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "decimal(38,10)")
        is_text, is_number = k == "STRING", k.isin(_KINDS["number"])
        if ref := schema.get("$ref"):
            if open_.count(ref) > self.depth:
                out.append(_say(path, F.lit(f"is nested deeper than {self.depth} times {ref}")))
            else:
                out.append(self.problems(self.named(ref), v, path, (*open_, ref)))
        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            fits = k.isin(sorted({x for n in names for x in _KINDS[n]}))
            if "integer" in names and "number" not in names:
                fits = fits | (is_number & (number == F.floor(number)))
            what = f'"{names[0]}"' if len(names) == 1 else ", ".join(f'"{n}"' for n in names)
            when(~fits, F.concat(shown, F.lit(f" is not of type{'s' if len(names) > 1 else ''} {what}")))
        if "const" in schema:
            when(~_same(v, k, [schema["const"]]), F.lit(f"{_text(schema['const'])} was expected"))
        if "enum" in schema:
            when(~_same(v, k, schema["enum"]), F.concat(shown, F.lit(f" is not one of {_text(schema['enum'])}")))
        for key, bad, word in (("minLength", lambda n: F.length(text) < n, "shorter than {} characters"), ("maxLength", lambda n: F.length(text) > n, "longer than {} characters")):
            if key in schema:
                when(is_text & bad(schema[key]), F.concat(shown, F.lit(f" is {word.format(schema[key])}")))
        if "pattern" in schema:
            when(is_text & ~text.rlike(schema["pattern"]), F.concat(shown, F.lit(f" does not match {_text(schema['pattern'])}")))
        for key, bad, word in (("minimum", lambda n: number < n, "less than the minimum of"), ("maximum", lambda n: number > n, "greater than the maximum of"), ("exclusiveMinimum", lambda n: number <= n, "less than or equal to the minimum of"), ("exclusiveMaximum", lambda n: number >= n, "greater than or equal to the maximum of")):
            if key in schema:
                when(is_number & bad(F.lit(schema[key])), F.concat(shown, F.lit(f" is {word} {schema[key]}")))
        out += self._object(schema, v, k, path, open_)
        out += self._array(schema, v, k, path, open_)
        for sub in schema.get("allOf", []):
            out.append(self.problems(sub, v, path, open_))
        for key in ("anyOf", "oneOf"):
            if key in schema:
                fits = sum((F.size(self.problems(s, v, path, open_)) == 0).cast("int") for s in schema[key])
                when(fits == 0, F.concat(shown, F.lit(f" is not valid under any of the schemas listed in '{key}'")))
                if key == "oneOf":
                    when(fits > 1, F.concat(shown, F.lit(" is valid under more than one of the schemas listed in 'oneOf'")))
        if "not" in schema:
            when(F.size(self.problems(schema["not"], v, path, open_)) == 0, F.concat(shown, F.lit(" is not allowed")))
        return F.concat(*out) if out else _empty()

    def _within(self, schema, path: Column, open_: tuple):
        return lambda x: self.problems(schema, x, path, open_)

    def _object(self, schema: dict, v: Column, k: Column, path: Column, open_: tuple) -> list[Column]:
        out, known = [], schema.get("properties", {})

        def child(name: str) -> Column:
            for quote in "'", '"':
                if quote not in name and "\\" not in name:
                    return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")
            return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))

        for name in schema.get("required", []):
            out.append(F.when((k == "OBJECT") & child(name).isNull(), _say(path, F.lit(f"{_text(name)} is a required property"))).otherwise(_empty()))
        for name, sub in known.items():
            there = F.filter(F.array(child(name)), lambda x: x.isNotNull())
            inner = F.concat(path, F.lit("/" + name.replace("~", "~0").replace("/", "~1")))
            out.append(F.when(k == "OBJECT", F.flatten(F.transform(there, self._within(sub, inner, open_)))).otherwise(_empty()))
        rest, names = schema.get("additionalProperties", True), schema.get("propertyNames", True)
        if rest is not True or names is not True:
            entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
            others = F.filter(entries, lambda e: ~e["key"].isin(list(known))) if known else entries
            if rest is False:
                quoted = F.array_join(F.array_sort(F.transform(others, lambda e: F.concat(F.lit("'"), e["key"], F.lit("'")))), ", ")
                were = F.when(F.size(others) == 1, F.lit(" was unexpected)")).otherwise(F.lit(" were unexpected)"))
                out.append(F.when((k == "OBJECT") & (F.size(others) > 0), _say(path, F.concat(F.lit("Additional properties are not allowed ("), quoted, were))).otherwise(_empty()))
            elif rest is not True:
                out.append(F.when(k == "OBJECT", F.flatten(F.transform(others, lambda e: self.problems(rest, e["value"], F.concat(path, F.lit("/"), e["key"]), open_)))).otherwise(_empty()))
            if names is not True:
                as_value = lambda e: F.parse_json(F.to_json(F.struct(e["key"].alias("k"))))
                key = lambda e: F.variant_get(as_value(e), "$.k", "variant")
                out.append(F.when(k == "OBJECT", F.flatten(F.transform(entries, lambda e: self.problems(names, key(e), path, open_)))).otherwise(_empty()))
        return out

    def _array(self, schema: dict, v: Column, k: Column, path: Column, open_: tuple) -> list[Column]:
        out, items = [], F.try_variant_get(v, "$", "array<variant>")
        if "items" in schema:
            out.append(F.when(k == "ARRAY", F.flatten(F.transform(items, lambda x, i: self.problems(schema["items"], x, F.concat(path, F.lit("/"), i.cast("string")), open_)))).otherwise(_empty()))
        for key, bad, word in (("minItems", lambda n: F.size(items) < n, "less than"), ("maxItems", lambda n: F.size(items) > n, "more than")):
            if key in schema:
                out.append(F.when((k == "ARRAY") & bad(schema[key]), _say(path, F.concat(F.to_json(v), F.lit(f" has {word} {schema[key]} items")))).otherwise(_empty()))
        if schema.get("uniqueItems"):
            texts = F.transform(items, lambda x: F.to_json(x))
            out.append(F.when((k == "ARRAY") & (F.size(F.array_distinct(texts)) < F.size(texts)), _say(path, F.concat(F.to_json(v), F.lit(" has non-unique elements")))).otherwise(_empty()))
        return out


def _empty() -> Column:
    return F.array().cast(PROBLEM)


def _say(path: Column, message: Column) -> Column:
    return F.array(F.struct(path.alias("path"), message.alias("message"))).cast(PROBLEM)


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _same(v: Column, k: Column, values: list) -> Column:
    """Whether a value is one of these: by kind, then by its text, numbers by value."""
    number = F.try_variant_get(v, "$", "decimal(38,10)")
    held = F.lit(False)
    for x in values:
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            held = held | (k.isin(_KINDS["number"]) & (number == F.lit(x)))
        else:
            kind = "VOID" if x is None else "BOOLEAN" if isinstance(x, bool) else "STRING" if isinstance(x, str) else "OBJECT" if isinstance(x, dict) else "ARRAY"
            held = held | ((k == kind) & (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(x))))))
    return F.coalesce(held, F.lit(False))


def validated(documents: DataFrame, schema: dict, column: str = "value", depth: int = 4) -> DataFrame:
    """Adds ``valid``, ``n_problems`` and ``samples`` (the first three, as ``path: message``, joined by `` | ``) to JSON texts.
    A text that is no JSON has that one problem; a null text is null."""
    value = F.try_parse_json(F.col(column))
    found = F.when(value.isNull(), _say(F.lit(""), F.lit("not JSON"))).otherwise(_Compiler(schema, depth).problems(schema, value, F.lit("")))
    with_problems = documents.withColumn("_problems", F.when(F.col(column).isNotNull(), found))
    shown = F.array_join(F.transform(F.slice("_problems", 1, 3), lambda p: F.concat(p["path"], F.lit(": "), p["message"])), " | ")
    n = F.size("_problems").cast("long")
    held = F.col(column).isNotNull()
    return with_problems.withColumns({"valid": F.when(held, n == 0), "n_problems": F.when(held, n), "samples": F.when(held, shown)}).drop("_problems")


def checked_patterns(schema) -> list[str]:
    """The patterns of a schema, to see before a run that they compile."""
    found = [schema["pattern"]] if isinstance(schema, dict) and isinstance(schema.get("pattern"), str) else []
    for sub in schema.values() if isinstance(schema, dict) else schema if isinstance(schema, list) else []:
        found += checked_patterns(sub)
    for p in found:
        re.compile(p)
    return found
