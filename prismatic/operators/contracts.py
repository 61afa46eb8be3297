"""Nested JSON held against a contract: what is missing, unknown or of another type, by path."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """kind: object, array, string, number, integer or boolean. Fields of an object are all required and no others allowed; each of an array's items is like `item`. Bounds are those of a number, of a text's length, or of an array's."""

    kind: str
    fields: dict[str, Node] = field(default_factory=dict)
    item: Node | None = None
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    among: tuple[object, ...] = ()


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool}


def is_kind(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, KINDS[kind])


def violations(value: object, node: Node, path: str = "$") -> Iterator[tuple[str, str]]:
    """path and fault (missing, unknown, type, range) of all that differs; what is of another type isn't looked into."""
    todo = [(value, node, path)]
    while todo:
        value, node, path = todo.pop()
        if value is None and node.nullable:
            continue
        if not is_kind(value, node.kind):
            yield path, "type"
            continue
        size = len(value) if node.kind in ("string", "array") else value if node.kind in ("number", "integer") else None
        if size is not None and (node.least is not None and size < node.least or node.most is not None and size > node.most) or node.among and value not in node.among:
            yield path, "range"
        if node.kind == "object":
            for name in node.fields.keys() - value.keys():
                yield f"{path}.{name}", "missing"
            for name in value.keys() - node.fields.keys():
                yield f"{path}.{name}", "unknown"
            todo += [(value[n], below, f"{path}.{n}") for n, below in node.fields.items() if n in value]
        elif node.kind == "array" and node.item:
            todo += [(v, node.item, f"{path}[{k}]") for k, v in enumerate(value)]


def json_schema(node: Node) -> dict:
    """The contract as a strict JSON schema, as a caller of a model sends it."""
    out: dict = {"type": [node.kind, "null"] if node.nullable else node.kind}
    bounds = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}.get(node.kind, ("minimum", "maximum"))
    out |= {name: bound for name, bound in zip(bounds, (node.least, node.most), strict=True) if bound is not None}
    if node.among:
        out["enum"] = list(node.among)
    if node.kind == "object":
        out |= {"properties": {n: json_schema(f) for n, f in node.fields.items()}, "required": list(node.fields), "additionalProperties": False}
    if node.item:
        out["items"] = json_schema(node.item)
    return out


def checked(rows: DataFrame, column: str, contract: Node) -> DataFrame:
    """The rows, with faults: an array of path and fault, in the order of their paths; empty where the text fulfils the contract. A text that is no JSON, or null, has the one fault "json" at $."""

    @F.pandas_udf("array<struct<path:string,fault:string>>")
    def faults(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            try:
                value = json.loads(text, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
            except (TypeError, ValueError, RecursionError):
                found.append([{"path": "$", "fault": "json"}])
                continue
            found.append([{"path": p, "fault": f} for p, f in sorted(violations(value, contract))])
        return pd.Series(found)

    return rows.withColumn("faults", faults(F.col(column)))


def fault_counts(faults: Column) -> dict[str, Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(faults, lambda f: f["fault"] == kind)).cast("long")

    return {kind: count(kind) for kind in ("json", "missing", "unknown", "type", "range")}
