"""Walks over nested schemas: every leaf with its path, from one scan of a table.

A path names fields by dots, elements of arrays as [i] and entries of maps as {key}. Leaves are found once, on the schema; the
expression that comes out holds one nested transform for each of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Under this key a field's metadata names the kind of row that its values (of arrays and maps: their elements) refer to, under
#: the other one the kind that the keys of a map refer to.
REFERS, KEYS_REFER = "refers", "keys_refer"


@dataclass(frozen=True)
class Leaf:
    """A way down from a column: field names, "[]" into an array, "{}" into the values of a map, "{key}" to its keys."""

    steps: tuple[str, ...]
    kind: str = ""

    @property
    def pattern(self) -> str:
        return "".join(s if s.startswith(("[", "{")) else f".{s}" for s in self.steps).removeprefix(".")


def leaves(schema: T.StructType, wanted: Callable[[T.DataType, dict], str | None], key_wanted: Callable[[dict], str | None] = lambda m: None) -> list[Leaf]:
    """The leaves for which ``wanted`` names a kind, given their type and the metadata of the nearest field above; and maps for
    whose keys ``key_wanted`` does."""

    def below(kind: T.DataType, steps: tuple[str, ...], meta: dict) -> list[Leaf]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in below(f.dataType, (*steps, f.name), f.metadata or {})]
        if isinstance(kind, T.ArrayType):
            return below(kind.elementType, (*steps, "[]"), meta)
        if isinstance(kind, T.MapType):
            keys = key_wanted(meta)
            return ([Leaf((*steps, "{key}"), keys)] if keys else []) + below(kind.valueType, (*steps, "{}"), meta)
        found = wanted(kind, meta)
        return [Leaf(steps, found)] if found is not None else []

    return below(schema, (), {})


def located(leaf: Leaf) -> Column:
    """array<struct<path, value>> of all values of a leaf in a row, as strings, nulls left out."""
    kind = "array<struct<path:string,value:string>>"

    def down(value: Column, path: Column, steps: tuple[str, ...]) -> Column:
        if not steps:
            one = F.array(F.struct(path.alias("path"), value.cast("string").alias("value"))).cast(kind)
            return F.when(value.isNotNull(), one).otherwise(F.array().cast(kind))
        step, rest = steps[0], steps[1:]
        if step == "[]":
            inner = F.flatten(F.transform(value, lambda x, i: down(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), rest)))
        elif step in ("{}", "{key}"):
            of = lambda e: down(e["key"] if step == "{key}" else e["value"], F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}")), rest)
            inner = F.flatten(F.transform(F.map_entries(value), of))
        else:
            inner = down(value[step], F.concat(path, F.lit(f".{step}")), rest)
        return F.coalesce(inner, F.array().cast(kind))

    first, *rest = leaf.steps
    return down(F.col(f"`{first}`"), F.lit(first), tuple(rest))


def rewritten(df: DataFrame, change: Callable[[Column], Column], skip: tuple[str, ...] = ()) -> DataFrame:
    """df with every text in it changed, in structs, arrays and map values alike; columns in ``skip`` and map keys stay."""

    def walk(kind: T.DataType, value: Column) -> Column:
        if isinstance(kind, T.StringType):
            return change(value)
        if isinstance(kind, T.StructType):
            made = F.struct(*(walk(f.dataType, value[f.name]).alias(f.name) for f in kind.fields))
            return F.when(value.isNotNull(), made)
        if isinstance(kind, T.ArrayType) and holds_text(kind):
            return F.transform(value, lambda x: walk(kind.elementType, x))
        if isinstance(kind, T.MapType) and holds_text(kind.valueType):
            return F.transform_values(value, lambda k, x: walk(kind.valueType, x))
        return value

    return df.select(*(walk(f.dataType, F.col(f"`{f.name}`")).alias(f.name) if f.name not in skip else F.col(f"`{f.name}`") for f in df.schema.fields))


def holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_text(kind.valueType)
    return isinstance(kind, T.StringType)


def changed_cells(before: DataFrame, change: Callable[[Column], Column], key: str) -> DataFrame:
    """(id, path, before, after) for every text of before that ``change`` changes, of all text columns but the key, in one scan."""
    found = leaves(before.schema, lambda kind, _: "text" if isinstance(kind, T.StringType) else None)
    cells = F.concat(F.array().cast("array<struct<path:string,value:string>>"), *(located(x) for x in found if x.steps[0] != key))
    pairs = F.transform(cells, lambda x: F.struct(x["path"].alias("path"), x["value"].alias("before"), change(x["value"]).alias("after")))
    rows = before.select(F.col(key).cast("string").alias("id"), F.explode(F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x"))
    return rows.select("id", "x.*")


def references(df: DataFrame, key: str, schema: T.StructType | None = None) -> DataFrame:
    """(id, path, kind, ref) of every value in df that refers to a row of another kind: of whatever field the schema's metadata
    names a kind for, at any depth. One scan of df; nulls refer to nothing."""
    found = leaves(schema or df.schema, lambda _, meta: meta.get(REFERS), lambda meta: meta.get(KEYS_REFER))
    named = lambda kind: lambda v: F.struct(v["path"].alias("path"), F.lit(kind).alias("kind"), v["value"].alias("ref"))
    each = [F.transform(located(x), named(x.kind)) for x in found]
    none = F.array().cast("array<struct<path:string,kind:string,ref:string>>")
    return df.select(F.col(key).cast("string").alias("id"), F.explode(F.concat(none, *each)).alias("x")).select("id", "x.*")


def refers(name: str, kind: T.DataType, to: str | None = None, keys_to: str | None = None) -> T.StructField:
    """A field of a schema whose values, or keys, refer to rows of another kind."""
    return T.StructField(name, kind, True, {k: v for k, v in ((REFERS, to), (KEYS_REFER, keys_to)) if v})
