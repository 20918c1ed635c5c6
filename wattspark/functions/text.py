"""Text as columns: names as they are stored and looked up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def stored_name(text: Column, longest: int) -> Column:
    """In lower case, without blanks around, at most `longest` characters; empty becomes null."""
    return F.nullif(F.substring(F.lower(F.trim(text)), 1, longest), F.lit(""))


def catalog_name(code: Column, names: Mapping[int, str], unknown: str) -> Column:
    """The name of a code in a fixed catalog; codes that it lacks, and null, get `unknown`."""
    entries = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, code), F.lit(unknown))
