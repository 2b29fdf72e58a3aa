"""Text expressions that stay on the JVM: tokens, labels, slugs, time strings, JSON properties."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
#: Unicode white space, as split() without arguments sees it.
SPACES = r"(?U)\s+"
ELLIPSIS = "…"


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    whole = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.split(whole, TOKEN_BREAK), lambda t: t != "")


def one_line(text: Column, limit: int | None = None) -> Column:
    """White space as single spaces; longer texts end in an ellipsis within ``limit``."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    if limit is None:
        return flat
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit(ELLIPSIS)))


def cell(text: Column, limit: int | None = None) -> Column:
    """A Markdown table cell: one line, pipes escaped, a dash for nothing."""
    return F.coalesce(F.nullif(F.replace(one_line(text, limit), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("–"))


def clipped(text: Column, limit: int = 500) -> Column:
    """The text, or its first ``limit`` - 1 characters and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit(ELLIPSIS))).otherwise(text)


def size_label(n: Column) -> Column:
    """``n chars``, in thousands with one decimal from 1000 on."""
    tenths = F.round(n / 100.0).cast("long")
    thousands = F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k chars"))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" chars"))).otherwise(thousands)


def duration_label(seconds: Column) -> Column:
    """``45s``, ``12m``, ``3h 5m`` or ``2d 4h``; negative counts as zero."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    whole = lambda unit: F.floor(s / unit).cast("string")
    rest = lambda outer, unit: F.floor((s % outer) / unit).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(60), F.lit("m")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h "), rest(3600, 60), F.lit("m")))
        .otherwise(F.concat(whole(86400), F.lit("d "), rest(86400, 3600), F.lit("h")))
    )


SLUG_CHARS = 48


def slug(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single hyphens, none at the ends, ``SLUG_CHARS`` at most."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.rtrim(F.substring(whole, 1, SLUG_CHARS), F.lit("-"))


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Lower case with the accents of Latin-1 letters taken off."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def iso(ts: Column) -> Column:
    """Milliseconds and ``Z``; the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parsed(text: Column) -> Column:
    """A timestamp from ISO text, naive text being UTC; null if it isn't one."""
    return F.try_to_timestamp(text)


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, 0 for null."""
    return F.coalesce(F.unix_timestamp(ts), F.lit(0)).cast("long")


def span(start: Column, end: Column) -> Column:
    """``start → end`` to the minute, the end's date left out on the same day."""
    a, b = (F.date_format(x, "yyyy-MM-dd HH:mm") for x in (start, end))
    later = F.when(F.to_date(start) == F.to_date(end), F.date_format(end, "HH:mm")).otherwise(b)
    return (
        F.when(start.isNull() & end.isNull(), F.lit("?"))
        .when(end.isNull() | (a == b), a)
        .when(start.isNull(), b)
        .otherwise(F.concat(a, F.lit(" → "), later))
    )


def when(value: str, now: datetime, end: bool = False) -> datetime:
    """``7d``, ``36h`` or ``2w`` before ``now``, or an ISO date or time in UTC.

    A bare date as an upper bound is the end of that day.
    """
    text = value.strip()
    units = {"h": 1, "d": 24, "w": 168}
    if text[:-1].isdigit() and text[-1:].lower() in units:
        return now - timedelta(hours=int(text[:-1]) * units[text[-1].lower()])
    found = datetime.fromisoformat(text)
    found = found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    return found + timedelta(days=1, milliseconds=-1) if end and len(text) == 10 else found


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text.

    Characters are sorted within the row, so that a character's count is the length of its run.
    """

    def of(c: Column) -> Column:
        n = F.size(c).cast("double")
        begins = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))

        def summed(b: Column) -> Column:
            shares = F.transform(b, lambda at, k: (F.coalesce(F.get(b, k + 1), F.size(c)) - at) / n)
            return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))

        return F.when(F.size(c) > 0, F.get(F.transform(F.array(begins), summed), 0)).otherwise(F.lit(0.0))

    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.get(F.transform(F.array(chars), of), 0)


def prop(json: str, key: str, kind: str = "long") -> Column:
    """One property of a JSON text; null if the text isn't JSON."""
    return F.get_json_object(json, f"$.{key}").cast(kind)
