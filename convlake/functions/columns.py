"""Column expressions: vectors, times, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns, in double."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * y), 0D, (s, x) -> s + x)")


def unit(a: str) -> Column:
    """The array scaled to length 1."""
    return F.expr(f"transform({a}, x -> x / greatest(1e-12D, sqrt(aggregate({a}, 0D, (s, y) -> s + cast(y AS double) * y))))")


def clock(seconds: str) -> Column:
    """hh:mm:ss of whole seconds."""
    return F.expr(f"concat_ws(':', lpad({seconds} div 3600, 2, '0'), lpad({seconds} div 60 % 60, 2, '0'), lpad({seconds} % 60, 2, '0'))")


def subtitle_time(ms: str, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    return F.concat(clock(f"({ms} div 1000)"), F.lit(mark), F.expr(f"lpad({ms} % 1000, 3, '0')"))


def parse_time(text: str) -> Column:
    """Seconds of the first [h:]m:ss in a text, else null."""
    found = f"regexp_extract({text}, '(?:([0-9]{{1,2}}):)?([0-9]{{1,2}}):([0-9]{{2}})', "
    h, m, s = (f"cast(nullif({found}{k}), '') AS bigint)" for k in (1, 2, 3))
    return F.expr(f"coalesce({h}, 0) * 3600 + {m} * 60 + {s}")


def strip(text: str) -> str:
    """SQL of a text without white space of any kind around it."""
    return rf"regexp_replace({text}, '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '')"


def list_item(text: str) -> str:
    """SQL of a line without white space and bullets around it."""
    return strip(f"trim(BOTH '-•* ' FROM {strip(text)})")


def note_key(text: str) -> Column:
    """What tells notes apart: lower case, everything but a-z and 0-9 as one space."""
    return F.expr(rf"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' '))")
