"""URL, identity and date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: Column, detail_pattern: str = r"/(?:details|land/ad)/(\d+)") -> Column:
    """Without query; a detail page in its one form scheme://host/details/id."""
    base = F.trim(F.split(F.coalesce(url, F.lit("")), r"\?", 2)[0])
    number = F.regexp_extract(base, detail_pattern, 1)
    site = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    return F.when((number != "") & (site != ""), F.concat(site, F.lit("/details/"), number)).otherwise(base)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))


def absolute_url(href: Column, site: str) -> Column:
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(site), href)).otherwise(F.concat(F.lit(site + "/"), href))


def job_id(url: Column, title: Column, company: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (url, title, company)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 14)


def candidates(*urls: Column) -> Column:
    """Distinct non-empty URLs in order."""
    return F.array_distinct(F.filter(F.array(*[F.coalesce(u, F.lit("")) for u in urls]), lambda u: u != ""))


def is_recent(created: Column, as_of: str, days: int) -> Column:
    return F.coalesce(created > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def age_points(created: Column, as_of: str) -> Column:
    """8, 6, 4 or 2 points up to 3, 7, 14 or 30 days; a later date counts as new; none without a date."""
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(created)) / 86400)
    points = F.when(days <= 3, 8).when(days <= 7, 6).when(days <= 14, 4).when(days <= 30, 2).otherwise(0)
    return F.when(created.isNull(), 0).otherwise(points)
