"""Markup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_comments(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
