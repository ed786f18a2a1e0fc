"""Queries over the table `pages`: each page gets, beside its own markup, the cards and facts of the three page formats, made of its keys."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.operators import extract, pages, reports
from textforge.plans import oracle as O
from textforge.plans.catalogue import joined, query
from textforge.sources.tables import read_table

SITE = "https://s.example"
#: Facts of a page, as columns over page_id and as SQL.
FACTS = {
    "n": "page_id::VARCHAR", "place": "'Place ' || page_id % 7", "firm": "'Firm ' || page_id % 11 || ' & sons'", "day": "strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d')",
    "contract": "CASE WHEN page_id % 2 = 0 THEN 'CDI' ELSE 'Stage' END",
}


def with_facts(spark, sf) -> DataFrame:
    p, n = read_table(spark, sf, "pages"), F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd")
    return p.withColumns({
        "n": n.cast("string"), "place": F.concat(F.lit("Place "), (n % 7).cast("string")), "firm": F.concat(F.lit("Firm "), (n % 11).cast("string"), F.lit(" &amp; sons")), "day": day,
        "contract": F.when(n % 2 == 0, "CDI").otherwise("Stage"),
    })


def filled(template: str, **columns):
    """The template with {name} replaced by columns; {day:format} is the day in another form."""
    out = F.lit(template)
    for name in ("n", "place", "firm", "day", "contract"):
        out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
    dotted = F.date_format(F.to_date("day"), "dd.MM.yyyy")
    return F.replace(F.replace(out, F.lit("{dotted}"), dotted), F.lit("{slashed}"), F.replace(dotted, F.lit("."), F.lit("/")))


CARD = (
    '<div class="card card-job featured"><div><h3><a href="/offre-emploi-maroc/x-{n}" title="Admin {n} &amp; more">Admin</a></h3><a class="card-job-company company-name">{firm}</a>'
    "<div class=\"card-job-description\"><p>Linux at {place}.</p></div><ul><li>Niveau d'expérience : <strong>0 &lt; 2 ans</strong></li><li>Contrat proposé : <strong>{contract}</strong></li>"
    '<li>Région de : <strong>{place}</strong></li></ul><time datetime="{day}">{dotted}</time></div></div>'
)
NO_LINK = '<div class="card card-job"><h3><a href="/elsewhere/{n}" title="No">No</a></h3></div>'
POST = (
    '<ul><li class="post-id" id="1"><img class="photo" alt="BOX" title="{firm}"><a class=\'titreJob\' href="/o-{n}.html">Infra | {place}</a><div class="info"><span>Support {n}.</span></div>'
    '<em class="date">du <span>{slashed}</span> au <span>31/12/2026</span></em><div class="info">3 poste(s) sur {place} - Maroc<ul><li>Type de contrat : {contract}</li><li>Expérience requise : -1 an</li></ul></div></li></ul>'
)
ANNOUNCE = '<ul><li><a href="mes-favoris.html"><h3>No</h3></a></li><li><a title="T" href="c/annonce/{n}/T.html"><h3>Technicien {n}</h3><span class="location">{place}</span></a><div class="time">10:42</div></li></ul>'
LISTED = ((pages.FORMAT_A, CARD + NO_LINK + CARD), (pages.FORMAT_B, POST), (pages.FORMAT_C, ANNOUNCE))
SHOWN = ("source", "page_url", "pos", "title", "company", "location", "created", "url", "description", "experience_hint", "contract_type", "time_hint")


def _facts(*columns: str) -> str:
    return f"f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in FACTS.items())} FROM pages) SELECT {', '.join(columns)} FROM f"


@query(
    "WITH c AS (SELECT unnest([0, 1])::INT AS pos), "
    + _facts("'a' AS source", "url AS page_url", "pos", "'Admin ' || n || ' & more' AS title", "firm AS company", "place AS location", "day AS created", f"'{SITE}/offre-emploi-maroc/x-' || n AS url", "'Linux at ' || place || '.' AS description", "'0 < 2 ans' AS experience_hint", "contract AS contract_type", "'' AS time_hint")
    + ", c UNION ALL SELECT 'b', url, 0, 'Infra | ' || place, firm, place || ' - Maroc', day, '" + SITE + "/o-' || n || '.html', 'Support ' || n || '.', '-1 an', contract, '' FROM f"
    + " UNION ALL SELECT 'c', url, 0, 'Technicien ' || n, '', place, '', '" + SITE + "/c/annonce/' || n || '/T.html', '', '', '', '10:42' FROM f"
)
def q_listing_formats(spark, sf):
    """Cards of three formats, found among all else that the pages hold."""
    p = with_facts(spark, sf)
    found = [pages.listings(p.select("url", F.concat("html", filled(block)).alias("html")), dataclasses.replace(f, site=SITE)) for f, block in LISTED]
    return functools.reduce(DataFrame.unionAll, found).select(*SHOWN)


JSON_LD = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Tech {n}", "datePosted": "{day} 10:42", "description": "<p>Support &amp; parc {n}.</p>", "employmentType": "{contract}", "industry": "IT", "url": "/a/{n}", "jobLocation": {"address": {"addressLocality": "{place}"}}, "hiringOrganization": {"name": "{firm}"}}</script>'
BARE = '<h1>Techniciens {n}</h1><div class="block"><div class="box1">ad</div>Missions :<br>Support {place}.</div><!-- block --><ul><li>Contrat : <a>{contract}</a></li><li>Entreprise : <a>{firm}</a></li><li>Ville : {place}</li></ul>'
DETAIL_A = (
    '<meta property="og:title" content="[{firm}] Dev"><link rel="canonical" href="/o/{n}"><h1>Dev {n}</h1><p>Publiée le {dotted}</p><ul><li class="withicon location-dot"><span>{place}</span></li>'
    '<li class="withicon chart"><span>0 &lt; 2 ans</span></li><li class="withicon graduation-cap"><span>Bac+5</span></li><li class="withicon file-signature"><span>{contract}</span></li></ul>'
    '<div class="job-description"><p>Pipelines {n}.</p><ul><li>Terraform</li></ul></div><div class="job-qualifications"><p>Cloud.</p></div><ul class="arrow-list"><li>Langues : fr</li></ul>'
)
DETAIL_B = (
    '<meta property="og:title" content="[{firm}] Infra"><meta property="og:url" content="https://s.example/o-{n}"><meta property="og:description" content="Short {n}."><h1>Infra {n}</h1>'
    '<ul><li title="Expérience requise">-1 an</li><li title="Région"><b>1</b> poste(s) sur {place} - Maroc</li></ul><span class="tagContrat" title="Type de contrat">{contract}</span>'
    '<div class="col-md-12 blc"><h2>Missions</h2><p>Support.</p></div><div class="col-md-12 blc"><h2>Adresse</h2><p>Street 1</p></div><div class="col-md-12 blc"><p>Short {n}.</p></div>'
)
DETAILED = ((pages.FORMAT_C, JSON_LD), (pages.FORMAT_C, BARE), (pages.FORMAT_A, DETAIL_A), (pages.FORMAT_B, DETAIL_B))
KNOWN = ("source", "page_url", "title", "company", "location", "created", "url", "description", "experience_hint", "education_level", "contract_type", "industry")


@query(
    "WITH " + _facts("'c' AS source", "url AS page_url", "'Tech ' || n AS title", "firm AS company", "place AS location", "day AS created", f"'{SITE}/a/' || n AS url", "'Support & parc ' || n || '.' AS description", "'' AS experience_hint", "'' AS education_level", "contract AS contract_type", "'IT' AS industry")
    + " UNION ALL SELECT 'c', url, 'Techniciens ' || n, firm, place, '', url, 'Missions Support ' || place || '.', '', '', contract, '' FROM f"
    + " UNION ALL SELECT 'a', url, 'Dev ' || n, firm, place, day, '" + SITE + "/o/' || n, 'Pipelines ' || n || '.' || chr(10) || 'Terraform' || chr(10) || chr(10) || 'Cloud.', '0 < 2 ans', 'Bac+5', contract, '' FROM f"
    + " UNION ALL SELECT 'b', url, 'Infra ' || n, firm, place || ' - Maroc', '', '" + SITE + "/o-' || n, 'Short ' || n || '.' || chr(10) || chr(10) || 'Missions Support.', '1 an', '', contract, '' FROM f"
)
def q_detail_formats(spark, sf):
    """The facts of a posting's page in three formats, each before the page's own markup."""
    p = with_facts(spark, sf)
    found = [pages.details(p.select("url", F.concat(filled(block), F.col("html")).alias("html")), dataclasses.replace(f, site=SITE)) for f, block in DETAILED]
    return functools.reduce(DataFrame.unionAll, found).select(*KNOWN)


LONG = "Support of users and of the network at {place}, with care for every server, each day. "


@query("WITH " + _facts("page_id", f"trim(replace('{LONG}', '{{place}}', place)) AS text") + " WHERE page_id % 2 = 0")
def q_page_text(spark, sf):
    """The description that a page's structured data hold at any depth, before the page's own text."""
    deep = '<script type="application/ld+json">{"@graph": [{"x": {"@type": ["Thing", "jobPosting"], "description": "' + LONG + '"}}]}</script>'
    p = with_facts(spark, sf)
    held = p.select("page_id", F.concat("url", F.lit("#"), "n").alias("url"), F.when(F.col("page_id") % 2 == 0, F.concat("html", filled(deep))).otherwise(F.col("html")).alias("html"))
    return held.select("page_id", "url").join(pages.page_texts(held), "url").where("page_id % 2 = 0").select("page_id", "text")


@query("WITH " + _facts("page_id", f"'{SITE}/b?x=' || n || '&pge=2|{SITE}/b?x=' || n || '&pge=3' AS more", "CASE WHEN page_id % 2 = 0 THEN 'be.jobs.example' ELSE 'www.jobs.example' END AS host", "'https://' || CASE WHEN page_id % 2 = 0 THEN 'be.jobs.example' ELSE 'www.jobs.example' END || '/details/' || n AS details"))
def q_url_helpers(spark, sf):
    links = '<a href="/b?x={n}&pge=1">1</a><a href="b?x={n}&pge=3"><a href="/b?x={n}&pge=2"><a href="/b?x={n}&pge=2">'
    p = with_facts(spark, sf).withColumn("html", F.concat("html", filled(links)))
    b = F.concat(F.when(F.col("page_id") % 2 == 0, "https://BE.jobs.example").otherwise("https://xx.example"), F.lit("/land/ad/"), F.col("n"), F.lit("?u=1"))
    host = pages.known_host([F.col("url"), b], ("be.jobs.example", "fr.jobs.example"), "www.jobs.example")
    return p.select("page_id", joined(pages.further_pages(F.col("html"), SITE, "pge")).alias("more"), host.alias("host"), pages.details_url(b, host).alias("details"))


@query("SELECT page_id, CASE page_id % 3 " + " ".join(f"WHEN {k} THEN '{pages.listing_url(SITE + '/r', {'f[0]': 'a:1'}, 'page', k)}'" for k in range(3)) + " END AS listing FROM pages")
def q_listing_url(spark, sf):
    made = [pages.listing_url(f"{SITE}/r", {"f[0]": "a:1"}, "page", k) for k in range(3)]
    return read_table(spark, sf, "pages").select("page_id", F.element_at(F.array(*map(F.lit, made)), (F.col("page_id") % 3 + 1).cast("int")).alias("listing"))


def _tokens(x: str) -> str:
    return O.token_set(x)


#: Each page's links with their labels, and the page's title as the posting that is looked for.
LINKS = "m AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>'), 1) AS pos FROM pages)"


@query(f"WITH {LINKS}, l AS (SELECT *, CASE WHEN page_id % 5 = 0 AND pos = 2 THEN '/details/1' || href ELSE href END AS link FROM m), s AS (SELECT page_id, pos, link, CASE WHEN contains(link, '/details/') THEN 6 ELSE 0 END + 2 * len(list_intersect({_tokens('title')}, {_tokens('label')})) + 2 * len(list_intersect({_tokens('label')}, {_tokens('title')})) AS score FROM l), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1) SELECT page_id, link FROM b WHERE score >= 2")
def q_best_link(spark, sf):
    """The page's link that fits its title best; the company and place around a link are the title's words too."""
    p = read_table(spark, sf, "pages")
    title = F.trim(extract.tag_text(F.col("html"), "title"))
    each = extract.listing(p).join(p.select("page_id", title.alias("title")), "page_id")
    link = F.when((F.col("page_id") % 5 == 0) & (F.col("pos") == 1), F.concat(F.lit("/details/1"), "href")).otherwise(F.col("href"))
    score = reports.link_score(F.col("title"), F.col("title"), F.col("title"), link, F.col("label"), F.col("label"), T.token_set)
    return reports.best_link(each.select("page_id", link.alias("link"), score.alias("score"), "pos"), "page_id")
