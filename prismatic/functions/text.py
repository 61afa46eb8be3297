"""Text and JSON expressions: Column to Column, built-in functions but for the longest common text, which is worked out in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: What diagnostics hide; other patterns would hide other text.
SECRET = r"(?i)(authorization|api[-_ ]?key|token|secret|password)\s*[:=]\s*[^\s,;]+"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
DATA_URL = r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+"


def normalized(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def has_value(text: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def first_spellings(values: Column) -> Column:
    """Distinct trimmed strings regardless of case, each as first spelt, in order; blank ones go."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0)
    seen = F.aggregate(
        trimmed,
        F.array().cast("array<string>"),
        lambda kept, v: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(v)), kept).otherwise(F.concat(kept, F.array(v))),
    )
    return seen


def string_list(values: Column, most: int) -> Column:
    """Trimmed, distinct, non-blank strings, the first `most` of them."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0)), 1, most)


def redacted(text: Column, most: int = 1000) -> Column:
    """Diagnostics with white space collapsed and secrets, bearer tokens blotted out."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    hidden = F.regexp_replace(F.regexp_replace(flat, SECRET, "$1=[REDACTED]"), BEARER, "Bearer [REDACTED]")
    return F.left(hidden, F.lit(most))


def without_payloads(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, DATA_URL, "[data]"), BEARER, "Bearer [REDACTED]")


def http_status(text: Column) -> Column:
    """The three digits after HTTP, or null."""
    found = F.regexp_extract(text, r"\bHTTP\s+(\d{3})\b", 1)
    return F.when(found != "", found.cast("int"))


def bigrams(text: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def dice(a: Column, b: Column) -> Column:
    """Of character pairs; 0 where a side has none."""

    def of(sides: Column) -> Column:
        x, y = sides["x"], sides["y"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)

    return let(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), of)


def tag_key(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.lower(t)), "\u001f")


def fenced_json(text: Column) -> Column:
    """What stands in a ``` fence, or the whole text, trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def archive_name(index: Column, key: Column, fallback: Column) -> Column:
    """NNN_name.jpg from the last part of a key without its extension and unprintable characters; a larger index has as many digits as it needs."""
    base = F.element_at(F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), -1)
    stem = F.trim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"[\x00-\x1f\x7f]", ""))
    return F.concat(F.format_string("%03d", index), F.lit("_"), F.when(F.length(stem) > 0, stem).otherwise(fallback), F.lit(".jpg"))


def label(text: Column, most: int = 200) -> Column:
    return F.left(F.regexp_replace(text, r"[\s=]+", "_"), F.lit(most))


def json_strings(value: Column) -> Column:
    """All strings of a JSON text, however deep, in their order; names of fields are none. Null gives null."""
    tokens = F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+'), F.lit(0))
    return F.from_json(F.concat(F.lit("["), F.array_join(F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":"))), ","), F.lit("]")), "array<string>")


def longest_common(a: str, b: str) -> int:
    """The length of the longest text that stands in both, a row of the table of matches at a time."""
    other = np.array(list(b))
    before, most = np.zeros(len(b) + 1, np.int64), 0
    for letter in a:
        now = np.zeros_like(before)
        now[1:] = np.where(other == letter, before[:-1] + 1, 0)
        before, most = now, max(most, int(now.max()))
    return most


@F.pandas_udf(LongType())
def common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else longest_common(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")
