"""Which files can be read, and why others can't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READERS = ("docx", "pptx")
OLD = ("doc", "ppt")
#: Formats that are known, but for which there is no reader here.
UNREAD = ("pdf",)


def format_of(df: DataFrame, path: str) -> DataFrame:
    """df with format and error: rejects are rows, so one bad file doesn't stop a run."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    error = F.when(suffix.isin(*READERS), None).when(suffix.isin(*OLD), "old format").when(suffix.isin(*UNREAD), "no reader").otherwise("unknown format")
    return df.withColumns({"format": F.when(suffix.isin(*READERS), suffix), "error": error})
