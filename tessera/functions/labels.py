"""Canonical spelling of source, language and subject labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-2 codes that stand for a two-letter language code.
LANG_CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh", "chi": "zh"}


def strip_unicode(col: Column) -> Column:
    """Strip white space of any script at both ends (plain trim only removes spaces)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def source_label(col: Column) -> Column:
    """Last path segment, lower case, spaces and underscores as hyphens; blank or null gives null.

    ``data/tokenized/Forum_QA//`` and `` forum-qa`` are both ``forum-qa``.
    """
    bare = F.regexp_replace(F.lower(strip_unicode(col)), r"[\s_]+", "-")
    last = F.regexp_extract(bare, r"([^/]+)/*$", 1)
    return F.nullif(last, F.lit(""))


def lang_label(col: Column) -> Column:
    """Two-letter code: region dropped, three-letter codes mapped; blank or null gives null."""
    bare = F.regexp_extract(F.lower(strip_unicode(col)), r"^([a-z]+)", 1)
    mapped = F.coalesce(*[F.when(bare == k, F.lit(v)) for k, v in LANG_CODES.items()], bare)
    return F.nullif(mapped, F.lit(""))


def subject_label(col: Column) -> Column:
    """Lower case with underscores; blank or null gives null."""
    return F.nullif(F.regexp_replace(F.lower(strip_unicode(col)), r"[\s\-]+", "_"), F.lit(""))
