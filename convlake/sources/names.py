"""Names of files, read and written (S)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def export_name(title: str, day: str, ext: str) -> Column:
    """S13. day_title.ext; of the title only letters, digits, _, - and spaces (as _), 60 characters, else `meeting`."""
    safe = F.left(F.translate(F.trim(F.regexp_replace(title, r"[^\p{L}\p{N}_\- ]+", "")), " ", "_"), F.lit(60))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("meeting")), F.lit("." + ext))


def title_from_filename(name: str) -> Column:
    """S14. The stem of the last part of a path without an upload's prefix of 8 hex digits, _ as space, 80 characters."""
    stem = F.regexp_replace(F.regexp_extract(name, "([^/]*)/*$", 1), r"^(.+)\.[^.]+$", "$1")
    title = F.left(F.trim(F.regexp_replace(F.regexp_replace(stem, "^[0-9a-f]{8}-", ""), "_+", " ")), F.lit(80))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled meeting"))
