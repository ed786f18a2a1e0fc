"""Reports over judged postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.operators import cascade, gates, reports
from textforge.plans import oracle as O
from textforge.plans.catalogue import acted, docs, joined, postings, query, scored
from textforge.rulepack import FIXTURE
from textforge.sources.tables import read_table


@query(f"WITH {O.scored()}, f AS (SELECT row_id, {O.first_fail()} AS reason FROM scored) SELECT reason, count(*) AS n FROM f WHERE reason <> '' GROUP BY reason ORDER BY n DESC, min(row_id) LIMIT 8")
def q_top_reasons(spark, sf):
    return reports.top_reasons(cascade.attributed(scored(spark, sf), FIXTURE), "first_fail")


@query("SELECT string_agg(event_type || ':' || n, ', ' ORDER BY n DESC, first) AS summary FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type ORDER BY n DESC, first LIMIT 3)")
def q_counter_summary(spark, sf):
    return reports.summary(read_table(spark, sf, "events"), "event_type", 3, "event_id")


@query(f"WITH {O.scored()}, f AS (SELECT row_id, title, {O.first_fail()} AS reason FROM scored), t AS (SELECT reason, count(*) AS n, min(row_id) AS first FROM f WHERE reason <> '' GROUP BY reason ORDER BY n DESC, first LIMIT 5), s AS (SELECT reason, string_agg(title, ' | ' ORDER BY row_id) AS titles FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY reason ORDER BY row_id) <= 3) GROUP BY reason) SELECT reason, n, titles FROM t JOIN s USING (reason)")
def q_rule_groups(spark, sf):
    return reports.rule_groups(cascade.attributed(scored(spark, sf), FIXTURE), "first_fail", 5)


@query(f"WITH {O.scored()} SELECT count(*) AS n, 0::BIGINT AS n_differ FROM scored")
def q_parity(spark, sf):
    """The conjunction that filters against the first failure, on rows that are read and scored once."""
    return reports.parity(scored(spark, sf), cascade.first_fail(FIXTURE) == "", cascade.passes(FIXTURE))


@query(f"WITH {O.queued()} SELECT action, count(*) AS n, count(*) FILTER (length(trim(coalesce(description, ''))) < 500) AS n_short, count(*) FILTER (length(trim(coalesce(description, ''))) = 0) AS n_missing, round_even(avg(length(trim(coalesce(description, '')))), 1) AS mean_length FROM acted GROUP BY action")
def q_text_quality(spark, sf):
    return reports.quality(acted(spark, sf))


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_repeat FROM documents")
def q_repeat_mask(spark, sf):
    return docs(spark, sf).select("doc_id", reports.is_repeat(["text"], "doc_id").alias("is_repeat"))


@query(f"WITH {O.POSTING} SELECT row_id, array_to_string(list_sort(list_filter({O.hits(O.norm('description'), FIXTURE.exclude)}, lambda x: NOT list_contains({O.hits(O.norm('substring(description, 1, 400)'), FIXTURE.exclude)}, x))), '|') AS hidden FROM posting")
def q_hidden_hits(spark, sf):
    d = postings(spark, sf).select("row_id", T.normalise(F.col("description")).alias("whole"), T.normalise(F.substring("description", 1, 400)).alias("head"))
    return d.select("row_id", joined(reports.new_hits(T.hits(F.col("whole"), FIXTURE.exclude), T.hits(F.col("head"), FIXTURE.exclude))).alias("hidden"))


VIEW = "lower(trim(coalesce(status, ''))) AS status, row_id % 100 AS priority, row_id % 3 = 0 AS is_remote"


def view(spark, sf):
    p = postings(spark, sf)
    return p.select("row_id", "title", "company", "location", "url", "created", "status", F.concat((F.col("row_id") % 100).cast("string"), F.lit(".7")).alias("priority"), F.when(F.col("row_id") % 3 == 0, " Yes").otherwise("no").alias("is_remote"), F.when(F.col("row_id") % 4 == 0, "False").when(F.col("row_id") % 4 == 1, "true").otherwise("").alias("apply_ready"), F.lit("").alias("action"))


@query(f"WITH {O.POSTING} SELECT row_id, title, company, location, url, strftime(created, '%Y-%m-%d') AS created, status, (row_id % 100)::INT AS priority, row_id % 3 = 0 AS is_remote, row_id % 4 <> 0 AS ready, CASE WHEN row_id % 4 <> 0 THEN 'apply_now' ELSE 'review' END AS action FROM posting")
def q_viewer_records(spark, sf):
    return reports.records(view(spark, sf))


@query(f"WITH {O.POSTING} SELECT row_id FROM posting WHERE status = 'to_apply' AND contains(lower(title || ' ' || company || ' ' || location), 'ring') AND row_id % 100 >= 40 AND row_id % 3 = 0")
def q_viewer_filter(spark, sf):
    return reports.viewed(reports.records(view(spark, sf)), "to_apply", "Ring", 40, remote=True).select("row_id")


@query(f"WITH {O.POSTING}, v AS (SELECT row_id, company, created, CASE WHEN row_id % 4 <> 0 THEN 1 ELSE 0 END AS ready, row_id % 100 AS p, strftime(created, '%Y-%m-%d') AS day FROM posting) SELECT row_id, row_number() OVER (ORDER BY ready DESC, p DESC, day DESC, row_id) AS by_priority, row_number() OVER (ORDER BY day DESC, p DESC, row_id) AS by_created, row_number() OVER (ORDER BY lower(company), p DESC, row_id) AS by_company FROM v WHERE row_id % 3 = 0 QUALIFY by_priority <= 50")
def q_viewer_orders(spark, sf):
    d = reports.viewed(reports.records(view(spark, sf)), remote=True)
    return reports.places(d, ("priority", "created", "company"), 50)


@query(f"WITH {O.POSTING}, m AS (SELECT url FROM posting WHERE row_id % 11 = 0) SELECT row_id, CASE WHEN row_id % 2 = 0 AND url NOT IN (SELECT url FROM m) THEN 'apply_now' ELSE 'review' END AS action FROM posting")
def q_demote_manual(spark, sf):
    p = postings(spark, sf).select("row_id", "url", F.lit("").alias("canonical_url"), F.when(F.col("row_id") % 2 == 0, "apply_now").otherwise("review").alias("action"))
    return gates.demoted(p, p.where("row_id % 11 = 0").select("url", "canonical_url")).select("row_id", "action")


@query(f"WITH {O.POSTING}, e AS (SELECT lower(trim(url)) AS u, lower(trim(title)) AS t, lower(trim(company)) AS c, max(row_id) AS earlier FROM posting WHERE row_id % 5 = 0 GROUP BY ALL) SELECT row_id, coalesce(earlier, -1) AS earlier FROM posting LEFT JOIN e ON lower(trim(url)) = u AND lower(trim(title)) = t AND lower(trim(company)) = c")
def q_reuse_earlier(spark, sf):
    p = postings(spark, sf).select("row_id", "url", F.lit(" ").alias("canonical_url"), "title", "company")
    return gates.reused(p, p.where("row_id % 5 = 0").withColumn("earlier", F.col("row_id")), ("earlier",)).select("row_id", F.coalesce("earlier", F.lit(-1)).alias("earlier"))


@query("WITH s AS (SELECT 'src' || (p_size % 4) AS base, p_size % 3 AS place, p_name FROM part), g AS (SELECT 'src' || b AS base, pl AS place FROM range(5) t(b), range(4) u(pl)) SELECT g.base, g.place, count(s.base) AS n, count(*) FILTER (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AS n_hits FROM g LEFT JOIN s USING (base, place) GROUP BY ALL")
def q_parameter_probe(spark, sf):
    rows = read_table(spark, sf, "part").select(F.concat(F.lit("src"), (F.col("p_size") % 4).cast("string")).alias("base"), (F.col("p_size") % 3).cast("long").alias("place"), "p_name")
    sweep = spark.createDataFrame([(f"src{b}", p) for b in range(5) for p in range(4)], "base string, place long")
    return reports.probe(rows, sweep, "p_name", ("ring", "bolt"))


@query(f"WITH {O.queued()}, t AS (SELECT * FROM acted ORDER BY priority DESC, row_id LIMIT 3) SELECT string_agg(printf('[%d] %s - %s (%s)', priority, title, company, location), chr(10) ORDER BY priority DESC, row_id) AS message FROM t")
def q_alert_message(spark, sf):
    return reports.alert_message(acted(spark, sf), 3)
