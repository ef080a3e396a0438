"""Star forms on DataFrames."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame


def columns(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names have ``pattern``, in order."""
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def star_filter(df: DataFrame, like: str | None = None, ilike: str | None = None, glob: str | None = None, similar: str | None = None, negate: bool = False) -> DataFrame:
    """The columns whose names match one of the four kinds of pattern."""
    sql = like if like is not None else ilike
    if sql is not None:
        rx = re.compile("".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in sql), re.S | (re.I if like is None else 0))
        ok = lambda c: rx.fullmatch(c) is not None
    elif glob is not None:
        ok = lambda c: fnmatch.fnmatchcase(c, glob)
    else:
        ok = lambda c: re.fullmatch(similar, c) is not None
    return df.select(*[c for c in df.columns if ok(c) != negate])


def replace(df: DataFrame, **new: Column) -> DataFrame:
    """Columns computed anew in their places."""
    return df.select(*[new[c].alias(c) if c in new else c for c in df.columns])


def rename(df: DataFrame, **new: str) -> DataFrame:
    """Columns under other names; names that aren't there are ignored."""
    return df.withColumnsRenamed(new)
