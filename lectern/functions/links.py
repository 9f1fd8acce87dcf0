"""Ids in links to documents, and sizes in style strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def document_id(c: Column) -> Column:
    """From a full link, or a bare long id."""
    bare = F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(_found(bare, "/document/d/([a-zA-Z0-9_-]{20,})"), _found(bare, "^([a-zA-Z0-9_-]{25,})$"))


def tab_id(c: Column) -> Column:
    return _found(c, r"[?&#]tab=([a-zA-Z0-9._-]+)")


def box_size(style: Column) -> Column:
    """width and height in points of a style such as `width:96pt;height:18pt`, 120 by 30 where unsaid; of repeated ones the last counts."""
    def last(name: str, default: float) -> Column:
        return F.coalesce(F.try_element_at(F.regexp_extract_all(style, F.lit(rf"{name}:([\d.]+)pt"), F.lit(1)), F.lit(-1)).cast("double"), F.lit(default))

    return F.struct(last("width", 120.0).alias("width"), last("height", 30.0).alias("height"))
