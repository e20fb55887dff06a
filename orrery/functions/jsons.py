"""JSON as text: paths, members, and jsonb's normal form and containment."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F


def path(text: Column, *steps: str | int) -> Column:
    """#>>: the value as text."""
    return F.get_json_object(text, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps))


def array_elements(text: Column) -> Column:
    """Elements as JSON texts; explode for rows."""
    return F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))


def array_elements_text(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def each_text(text: Column) -> Column:
    """map of members as text; explode for rows."""
    return F.from_json(text, "map<string,string>")


def object_keys(text: Column) -> Column:
    return F.json_object_keys(text)


def typeof(text: Column) -> Column:
    """object, array, string, number, boolean or null."""
    first = F.substring(F.ltrim(text), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first.isNotNull(), "number")


def build_object(**members: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in members.items())), {"ignoreNullFields": "false"})


def build_array(*items: Column) -> Column:
    return F.to_json(F.array(*items))


def has_key(text: Column, key: str) -> Column:
    """jsonb ? key."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def has_any(text: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(text), F.array(*map(F.lit, keys))), F.lit(False))


def has_all(text: Column, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & has_key(text, k)
    return out


def _contains(a: Any, b: Any, top: bool = True) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v, False) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_contains(x, y, False) for x in a) for y in b)
    if top and isinstance(a, list) and not isinstance(b, (list, dict)):
        return any(type(x) is type(b) and x == b for x in a)
    return (isinstance(a, bool) == isinstance(b, bool)) and a == b


def contains(text: Column, other: Column) -> Column:
    """jsonb @>; containment nests, which no built-in expresses."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _contains(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(text, other)


def normal(text: Column) -> Column:
    """jsonb's form: last of equal keys, keys by length and then bytes, spaces after , and :."""

    def order(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: order(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
        return [order(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else json.dumps(order(json.loads(x)), ensure_ascii=False))

    return run(text)


def strip_nulls(text: Column) -> Column:
    def clean(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        return [clean(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else json.dumps(clean(json.loads(x)), separators=(",", ":"), ensure_ascii=False))

    return run(text)


def set_path(text: Column, steps: list[str | int], value: Any, create: bool = True) -> Column:
    """jsonb_set()."""

    def put(v: Any, rest: list[str | int]) -> Any:
        s, more = rest[0], rest[1:]
        if isinstance(v, dict) and isinstance(s, str):
            if s in v or (create and not more):
                return v | {s: put(v[s], more) if more else value}
        if isinstance(v, list) and isinstance(s, int):
            at = s if s >= 0 else len(v) + s
            if 0 <= at < len(v):
                return [*v[:at], put(v[at], more) if more else value, *v[at + 1 :]]
            if create and not more:
                return [*v, value] if at >= len(v) else [value, *v]
        return v

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else json.dumps(put(json.loads(x), steps), separators=(",", ":"), ensure_ascii=False))

    return run(text)


def json_agg(value: Column, *order: Column) -> Column:
    """json_agg(): an array of a group's values, nulls too, in the order given."""
    row = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.to_json(F.array(value)).alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.substr(x["v"], F.lit(2), F.length(x["v"]) - 2))
    return F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]"))


def json_object_agg(key: Column, value: Column) -> Column:
    """json_object_agg(): members in the order of their keys."""
    member = F.struct(key.cast("string").alias("k"), F.concat(F.to_json(F.array(key.cast("string"))), F.to_json(F.array(value))).alias("kv"))
    shown = F.transform(F.array_sort(F.collect_list(member)), lambda x: F.regexp_replace(x["kv"], r'^\[(".*")\]\[(.*)\]$', "$1 : $2"))
    return F.concat(F.lit("{ "), F.array_join(shown, ", "), F.lit(" }"))


def populate_record(text: Column, ddl: str) -> Column:
    """jsonb_populate_record(): a struct of the columns of ddl; members that it doesn't name are dropped, absent ones are null."""
    return F.from_json(text, ddl)


def populate_recordset(text: Column, ddl: str) -> Column:
    """jsonb_populate_recordset(): an array of such structs."""
    return F.from_json(text, f"array<struct<{','.join(':'.join(x.split()) for x in ddl.split(','))}>>")


def insert_path(text: Column, steps: list[str | int], value: Any, after: bool = False) -> Column:
    """jsonb_insert(): a new element before (or after) that of the path, or a new member; an existing member stays and is an error in SQL, here a null."""

    def put(v: Any, rest: list[str | int]) -> Any:
        s, more = rest[0], rest[1:]
        if isinstance(v, dict) and isinstance(s, str):
            if more:
                return v | {s: put(v[s], more)} if s in v else v
            return None if s in v else v | {s: value}
        if isinstance(v, list) and isinstance(s, int):
            at = s if s >= 0 else len(v) + s
            if more:
                return [*v[:at], put(v[at], more), *v[at + 1 :]] if 0 <= at < len(v) else v
            at = min(max(at + after, 0), len(v))
            return [*v[:at], value, *v[at:]]
        return v

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        done = a.map(lambda x: None if x is None else put(json.loads(x), steps))
        return done.map(lambda x: None if x is None else json.dumps(x, separators=(",", ":"), ensure_ascii=False))

    return run(text)


def pretty(text: Column) -> Column:
    """jsonb_pretty(): indented by four blanks, members in jsonb's order."""

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=4, ensure_ascii=False))

    return run(normal(text))
