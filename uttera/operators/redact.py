"""Replacing secrets in text, JSON text and columns of any type."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

# Names that mark a field as secret, and shapes that mark a value as one.
NAMES = r"(?:token|secret|password|passwd|api_?key|access_?key|authorization|credential)"
SECRET_KEY = rf"(?i){NAMES}"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=\-]{8,}"
TOKEN = r"\b(hf_[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9\-]{16,}|AKIA[0-9A-Z]{16})\b"
ASSIGNED = rf"""(?i)\b([A-Za-z0-9_]*{NAMES}[A-Za-z0-9_]*\s*[=:]\s*)(?:"[^"]*"|'[^']*')"""
BARE = rf"""(?i)\b([A-Za-z0-9_]*{NAMES}[A-Za-z0-9_]*\s*[=:]\s*)[^\s"',;&(){{}}\[\]]+"""
# The key of a secret JSON field up to its value, and the values that hold no others.
JSON_KEY = rf'(?i)("(?:[^"\\]|\\.)*{NAMES}(?:[^"\\]|\\.)*"\s*:\s*)'
JSON_FIELD = JSON_KEY + r'(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+\-]*|true|false)'
JSON_NESTED = JSON_KEY + r"[\[{]"


def redact_text(c: Column) -> Column:
    """Quoted and bare assignments to secret names, bearer values and token-shaped words."""
    out = F.regexp_replace(c, ASSIGNED, f'$1"{REDACTED}"')
    out = F.regexp_replace(out, BEARER, f"Bearer {REDACTED}")
    out = F.regexp_replace(out, TOKEN, REDACTED)
    return F.regexp_replace(out, BARE, f"$1{REDACTED}")


def _cut_nested(text: str) -> str:
    """Lists and objects under secret names, found by the JSON decoder, become one redacted text. What does not
    decode is cut to its end: nothing behind an unreadable secret is shown."""
    decode, parts, at = json.JSONDecoder().raw_decode, [], 0
    nested = re.compile(JSON_NESTED)
    while found := nested.search(text, at):
        value = found.end() - 1
        try:
            end = decode(text, value)[1]
        except ValueError:
            end = len(text)
        parts += [text[at:value], f'"{REDACTED}"']
        at = end
    return "".join([*parts, text[at:]])


@F.pandas_udf(T.StringType())
def _without_nested(texts: pd.Series) -> pd.Series:
    return texts.map(_cut_nested, na_action="ignore")


def redact_json(c: Column) -> Column:
    """Values of secret-named fields of any type first, then token-shaped values anywhere.

    Only rows with a list or object under a secret name leave the JVM.
    """
    nested = F.coalesce(c.rlike(JSON_NESTED), F.lit(False))
    flat = F.coalesce(_without_nested(F.when(nested, c)), c)
    return redact_text(F.regexp_replace(flat, JSON_FIELD, f'$1"{REDACTED}"'))


def erase(c: Column, kind: T.DataType) -> Column:
    """Everything below a secret name: texts become the mark, other values null, the type stays."""
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.lit(REDACTED))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: erase(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: erase(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[erase(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return F.lit(None).cast(kind)


def redact_column(c: Column, kind: T.DataType) -> Column:
    """Follows the column's own type down through structs, arrays and maps."""
    if isinstance(kind, T.StringType):
        return redact_text(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_column(x, kind.elementType))
    if isinstance(kind, T.MapType):
        inner = lambda x: redact_column(x, kind.valueType)
        if not isinstance(kind.keyType, T.StringType):
            return F.transform_values(c, lambda _, x: inner(x))
        return F.transform_values(c, lambda k, x: F.when(k.rlike(SECRET_KEY), erase(x, kind.valueType)).otherwise(inner(x)))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_redact_field(c[f.name], f).alias(f.name) for f in kind.fields]))
    return c


def _redact_field(c: Column, field: T.StructField) -> Column:
    secret = re.search(SECRET_KEY, field.name)
    return erase(c, field.dataType) if secret else redact_column(c, field.dataType)


def redact(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table with secrets replaced in the chosen columns, all by default."""
    chosen = columns or df.columns
    return df.select(
        *[_redact_field(F.col(f.name), f).alias(f.name) if f.name in chosen else F.col(f.name) for f in df.schema.fields]
    )
