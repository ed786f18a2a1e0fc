"""Listing and detail pages of several formats: a format is class names, attributes and labels, read by one extractor."""

from __future__ import annotations

import dataclasses
import datetime
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.functions import markup as M

#: Where a value stands: a kind, then its arguments. '' is the text and '@name' an attribute at a path of selectors, 'last'
#: the text of the last node of a selector, 'rest' that of a node without another in it, 'label' what follows a label in
#: a list item, 'after' the word behind a phrase, 'meta' a meta property, 'bracket' what it has in brackets, 'json' a path
#: in the page's JSON-LD posting.
Place = tuple[str, ...]


@dataclasses.dataclass(frozen=True)
class Format:
    """How one site marks up its pages. Values of places are tried in turn; dates is the pattern of its dates."""

    site: str = ""
    source: str = ""
    item: str = ""
    link: Place = ()
    link_part: str = ""
    fields: tuple[tuple[str, tuple[Place, ...]], ...] = ()
    details: tuple[tuple[str, tuple[Place, ...]], ...] = ()
    sections: tuple[str, ...] = ()
    skip_heading: str = ""
    lead_meta: str = ""
    dates: str = "%Y-%m-%d"
    country: str = ""


#: Class names, attributes and labels of three sites; the site itself is given by the caller. Fixed values.
FORMAT_A = Format(
    source="a", item="div.card-job", link=("h3", "a"), link_part="/offre-emploi-maroc/",
    fields=(
        ("title", (("@title", "h3", "a"),)), ("company", (("", "a.company-name"),)), ("location", (("label", "Région de"),)),
        ("description", (("", "div.card-job-description", "p"),)), ("created", (("@datetime", "time"),)),
        ("experience_hint", (("label", "Niveau d'expérience"),)), ("contract_type", (("label", "Contrat proposé"),)),
    ),
    details=(
        ("title", (("", "h1"),)), ("company", (("bracket", "og:title"),)), ("location", (("", "li.withicon.location-dot", "span"),)),
        ("created", (("after", "Publiée le"),)), ("url", (("@href", "link[rel*=canonical]"),)), ("experience_hint", (("", "li.withicon.chart", "span"),)),
        ("education_level", (("", "li.withicon.graduation-cap", "span"),)), ("contract_type", (("", "li.withicon.file-signature", "span"),)),
    ),
    sections=("div.job-description", "div.job-qualifications"), dates="%d.%m.%Y",
)
FORMAT_B = Format(
    source="b", item="li.post-id", link=("a.titreJob",),
    fields=(
        ("title", (("", "a.titreJob"),)), ("company", (("@title", "img.photo"), ("@alt", "img.photo"))), ("description", (("", "div.info", "span"),)),
        ("created", (("", "em.date", "span"),)), ("experience_hint", (("label", "Expérience requise"),)), ("contract_type", (("label", "Type de contrat"),)),
        ("location", (("last", "div.info"),)),
    ),
    details=(
        ("title", (("", "h1"),)), ("company", (("bracket", "og:title"),)), ("location", (("", "li[title*=Région]"),)), ("url", (("meta", "og:url"),)),
        ("experience_hint", (("", "li[title*=Expérience requise]"),)), ("contract_type", (("", "span.tagContrat[title*=Type de contrat]"),)),
    ),
    sections=("div.blc",), skip_heading="adresse", lead_meta="og:description", dates="%d/%m/%Y", country="Maroc",
)
FORMAT_C = Format(
    source="c", item="li", link=("a",), link_part="/annonce/",
    fields=(("title", (("", "h3"), ("@title", "a"))), ("location", (("", "span.location"),)), ("time_hint", (("", "div.time"),))),
    details=(
        ("title", (("json", "title"), ("", "h1"))), ("company", (("json", "hiringOrganization", "name"), ("label", "Entreprise"))),
        ("location", (("json", "jobLocation", "address", "addressLocality"), ("json", "jobLocation", "address", "addressRegion"), ("label", "Ville"))),
        ("created", (("json", "datePosted"),)), ("url", (("json", "url"),)), ("contract_type", (("json", "employmentType"), ("label", "Contrat"))),
        ("industry", (("json", "industry"), ("label", "Domaine"))), ("description", (("json", "description"), ("rest", "div.block", "div.box1"))),
    ),
)

_FIELDS = ("title", "company", "location", "created", "url", "description", "experience_hint", "education_level", "contract_type", "industry", "time_hint")
SCHEMA = "page_url string, pos int, " + ", ".join(f"{n} string" for n in _FIELDS) + ", source string"


def value(node: M.Node, place: Place, posting: dict) -> str:
    """The text at a place, empty without one."""
    kind, *path = place
    if kind == "label":
        for li in node.all("li"):
            name, colon, rest = li.text().partition(":")
            if colon and name.strip() == path[0]:
                return rest.strip()
        return ""
    if kind == "json":
        x = posting
        for key in path:
            x = x.get(key) if isinstance(x, dict) else None
        return M.tree(x).text() if isinstance(x, str) else ""
    if kind in ("meta", "bracket"):
        given = M.content(node, path[0])
        inner = re.search(r"\[([^\]]+)\]", given)
        return given if kind == "meta" else inner[1].strip() if inner else ""
    if kind == "after":
        found = re.search(re.escape(path[0]) + r"\s*(\S+)", node.text())
        return found[1] if found else ""
    if kind == "last":
        return next((n.text() for n in reversed(list(node.all(path[0])))), "")
    found = node.first(*path[:1]) if kind == "rest" else node.first(*path)
    if found is None:
        return ""
    if kind == "rest":
        return found.text(frozenset(found.all(path[1])))
    return " ".join(found.attrs.get(kind[1:], "").split()) if kind else found.text()


def _first_value(node: M.Node, places: tuple[Place, ...], posting: dict) -> str:
    return next((v for p in places if (v := value(node, p, posting))), "")


def iso_date(text: str, pattern: str) -> str:
    """A date by its pattern or in ISO form, as ISO; empty if it is none."""
    for p in (pattern, "%Y-%m-%d"):
        try:
            return datetime.datetime.strptime(text[:10], p).date().isoformat()
        except ValueError:
            continue
    return ""


def clean_place(text: str, country: str) -> str:
    """The place that stands before its country, without the number of openings before it; without a country, the text."""
    if not country:
        return text
    before, dash, _ = text.partition(f" - {country}")
    name = re.split(r"\bsur\s", before, flags=re.IGNORECASE)[-1].strip()
    return f"{name} - {country}" if dash and name else ""


def listing_rows(html: str | None, page_url: str, f: Format) -> Iterator[dict]:
    """The records of a listing page, without those that lack the link."""
    pos = 0
    for item in M.tree(html).all(f.item):
        link = item.first(*f.link)
        href = link.attrs.get("href", "") if link is not None else ""
        if not href or f.link_part not in href:
            continue
        row = {n: _first_value(item, places, {}) for n, places in f.fields}
        if "created" in row:
            row["created"] = iso_date(row["created"], f.dates)
        row["location"] = clean_place(row.get("location", ""), f.country)
        yield {**row, "page_url": page_url, "pos": pos, "url": urljoin(f.site + "/", href), "source": f.source}
        pos += 1


def detail_rows(html: str | None, page_url: str, f: Format) -> Iterator[dict]:
    """The one record of a detail page."""
    root = M.tree(html)
    posting = next((x for block in M.json_blocks(root) for x in (block if isinstance(block, list) else [block]) if isinstance(x, dict) and x.get("@type") == "JobPosting"), {})
    row = {n: _first_value(root, places, posting) for n, places in f.details}
    parts = [M.content(root, f.lead_meta)] if f.lead_meta else []
    for selector in f.sections:
        for n in root.all(selector):
            heading = n.first("h2")
            if not (f.skip_heading and heading is not None and f.skip_heading in heading.text().lower()):
                parts.append(n.text() if f.lead_meta else n.lines())
    if f.sections:
        row["description"] = "\n\n".join(dict.fromkeys(p for p in parts if p))
    if "created" in row:
        row["created"] = iso_date(row["created"], f.dates)
    row["location"] = clean_place(row.get("location", ""), f.country)
    yield {**row, "page_url": page_url, "pos": 0, "url": urljoin(f.site + "/", row.get("url") or page_url), "source": f.source}


def _parsed(pages: DataFrame, f: Format, rows: Callable[[str | None, str, Format], Iterator[dict]]) -> DataFrame:
    names = ["page_url", "pos", *_FIELDS, "source"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [r for url, html in zip(part["url"], part["html"], strict=True) for r in rows(html, url or "", f)]
            yield pd.DataFrame([[r.get(n, "") for n in names] for r in found], columns=names)

    return pages.select("url", "html").mapInPandas(run, SCHEMA)


def listings(pages: DataFrame, f: Format) -> DataFrame:
    """One row for each record of listing pages (url, html); fields that a page does not have are empty."""
    return _parsed(pages, f, listing_rows)


def details(pages: DataFrame, f: Format) -> DataFrame:
    """One row for each detail page (url, html)."""
    return _parsed(pages, f, detail_rows)


def page_texts(pages: DataFrame, most: int = 12_000) -> DataFrame:
    """url, text: each page's structured description or else its text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"url": part["url"], "text": [M.page_text(h, most) for h in part["html"]]})

    return pages.select("url", "html").mapInPandas(run, "url string, text string")


def listing_url(base: str, params: dict[str, str], name: str, page: int) -> str:
    """The address of a listing's page; the first has no number."""
    return f"{base}?{urlencode({**params, **({name: str(page)} if page > 0 else {})})}"


def further_pages(html: Column, site: str, name: str) -> Column:
    """The distinct absolute links that carry a page number, without page 1, which repeats the first page; sorted."""
    links = F.regexp_extract_all(html, F.lit(rf'href="([^"]*[?&]{name}=\d+[^"]*)"'), F.lit(1))
    whole = F.transform(links, lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(site), F.when(F.startswith(u, F.lit("/")), F.lit("")).otherwise(F.lit("/")), u)))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda u: ~u.rlike(rf"[?&]{name}=1(&|$)"))))


def known_host(urls: list[Column], hosts: tuple[str, ...], fallback: str) -> Column:
    """The host of the first URL whose host is known, else the fallback."""
    host = lambda u: F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^https?://([^/?#]+)", 1))
    return F.coalesce(*[F.when(host(u).isin(*hosts), host(u)) for u in urls], F.lit(fallback))


def details_url(url: Column, host: Column) -> Column:
    """https://host/details/number of a URL that names a posting, else empty."""
    number = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(?:details|land/ad)/(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("https://"), host, F.lit("/details/"), number)).otherwise("")
