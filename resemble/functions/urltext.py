"""E3 and E11 as native columns: words of a URL, and the ``', '`` part join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_text(url: Column) -> Column:
    """host's first label (every ``www.`` removed) + ' ' + the path words.

    Path segments that are blank or contain a ``.`` are dropped; the rest are
    stripped, joined by a space, and every char outside ``[A-Za-z0-9]`` becomes a
    space.  The host part is the URL's authority (user and port included, as a
    network location is); an unparsable URL gives ''.
    """
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    label = F.coalesce(F.element_at(F.split(F.replace(host, F.lit("www."), F.lit("")), r"\."), 1), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    segs = F.filter(F.split(path, "/"), lambda s: (F.trim(s) != "") & ~s.contains("."))
    words = F.regexp_replace(F.array_join(F.transform(segs, lambda s: F.trim(s)), " "), "[^A-Za-z0-9]", " ")
    return F.concat(label, F.lit(" "), words)


def join_parts(*parts: Column) -> Column:
    """Drop blank parts, join the rest with ``', '``."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), ", ")
