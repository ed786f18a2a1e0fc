"""Rules on literal rows; companies and texts are invented."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textforge.functions import markup
from textforge.functions import text as T
from textforge.functions import urls as U
from textforge.operators import cascade, classify, dedup, extract, queue, roles, scoring, state
from textforge.rulepack import FIXTURE, RulePack
from textforge.sources import tables
from textforge.streaming.alerts import run_alerts

POSTING = "row_id long, title string, company string, location string, description string, url string, created timestamp, search_term string, status string"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value, want", [(None, ""), ("  Éá  ß\nœ ", "ea ß œ"), ("Ünïcode ÑANDÚ", "unicode nandu"), ("", "")])
def test_normalise(spark, value, want):
    assert one(spark, value, T.normalise) == want


@pytest.mark.parametrize("text, word, hit, match", [
    ("a token_x b", "token", True, False), ("tokens", "token", False, False), ("use c++ now", "c++", True, True),
    ("end of  the line", "of the", True, False), ("international", "intern", False, False),
])
def test_three_ways_of_matching(spark, text, word, hit, match):
    assert one(spark, text, lambda c: T.keyword_hit(c, word)) is hit
    assert one(spark, text, lambda c: T.keyword_match(c, word)) is match
    assert one(spark, "international", lambda c: T.contains_any(c, ["intern"])) is True


def test_html(spark):
    page = '<html><script>var a="<p>";</script><style>p{}</style><p>Fish &amp; chips&nbsp;&lt;hot&gt;</p></html>'
    assert one(spark, page, T.html_to_plain) == "Fish & chips"
    assert one(spark, page, T.looks_like_html) is True
    assert one(spark, "a < b", T.looks_like_html) is False


def test_snippet_and_company(spark):
    assert one(spark, "x" * 150, T.snippet) == "x" * 137 + "..."
    assert one(spark, "Acme GmbH Group", T.company_key) == "acme gmbh"  # gmbh has its turn before group
    assert one(spark, "Acme Consulting Group", T.company_key) == "acme"


def test_urls(spark):
    assert one(spark, "https://x.example/land/ad/42?se=1", U.canonical_url) == "https://x.example/details/42"
    assert one(spark, "https://x.example/a/b?q=1", U.canonical_url) == "https://x.example/a/b"
    assert one(spark, None, U.canonical_url) == ""
    assert one(spark, "/a", lambda c: U.absolute_url(c, "https://x.example")) == "https://x.example/a"


def test_years_required(spark):
    found = lambda t: (lambda y: (y["years"], y["is_range"]))(one(spark, t, roles.years_required))
    assert found("3-5 years of experience") == (3, True)
    assert found("minimum 4 years experience and 2+ years experience") == (4, False)
    assert found("founded 20 years ago") == (None, False) and found("") == (None, False)
    assert found("at least 3 years in a long and winding sort of experience") == (None, False)
    assert found("2-4 years experience, 16 years experience") == (2, True)
    assert found("experience " + "x" * 30 + " 5 years") == (None, False) and found("experience " + "x" * 28 + " 5 years") == (5, False)


def rows(spark, *values):
    return spark.createDataFrame(list(values), POSTING)


def posting(spark, **change):
    base = dict(row_id=1, title="red bolt", company="Acme", location="NATION_1", description="the quick brown fox " * 5, url="u", created=None, search_term="t", status="to_apply")
    import datetime

    base["created"] = datetime.datetime(1998, 12, 30)
    return rows(spark, tuple((base | change).values()))


@pytest.mark.parametrize("change, want", [
    ({}, ""), ({"description": "short"}, "description_short"), ({"title": "red anvil"}, "bad_title"), ({"created": None}, "not_recent"),
    ({"location": "Nation_3"}, "location"), ({"location": ""}, ""), ({"title": "hot bolt"}, "role"), ({"description": "a moron stood here " * 5}, "student_internship"),
    ({"description": "some trash is the thing " * 4}, "generic_internship"), ({"description": "worthless is the thing here " * 4}, "excluded_word"),
])
def test_first_fail(spark, change, want):
    df = scoring.scored(classify.features(posting(spark, **change)), FIXTURE)
    assert cascade.attributed(df, FIXTURE).first()["first_fail"] == want
    assert cascade.keep(df, FIXTURE).count() == (want == "")


def test_funnel_adds_up(spark, sf):
    df = scoring.scored(classify.features(tables.postings(spark, sf)), FIXTURE)
    steps = cascade.funnel(df, FIXTURE).orderBy("step_no").collect()
    assert steps[0]["before"] == df.count()
    assert all(a["kept"] == b["before"] for a, b in zip(steps, steps[1:]))
    assert steps[-1]["kept"] == cascade.keep(df, FIXTURE).count()


def test_result_does_not_depend_on_partitions(spark, sf):
    df = scoring.scored(classify.features(tables.postings(spark, sf)), FIXTURE)
    acted = queue.recommended(queue.feedback_scored(df), FIXTURE)
    a, b = (queue.queue(acted.repartition(n), FIXTURE).select("row_id", "adjusted").collect() for n in (1, 7))
    assert a == b and a
    assert all(n <= FIXTURE.company_cap for n in queue.capped(acted, 3).groupBy("company").count().toPandas()["count"])


def test_best_of_group(spark):
    import datetime

    d = datetime.datetime
    df = rows(spark, (1, "t", "c", "l", "long text", "u", d(2000, 1, 1), "", ""), (2, "t", "c", "l", "long text", "u", d(2000, 1, 2), "", ""), (3, "t", "c", "l", "x", "u", d(2001, 1, 1), "", ""), (4, "t", "c", "l", "x", "", None, "", ""), (5, "t", "c", "l", "x", None, None, "", ""))
    assert sorted(r["row_id"] for r in dedup.by_url(df).collect()) == [2, 4, 5]
    once = dedup.by_canonical_key(df).drop("key")
    assert [r["row_id"] for r in once.collect()] == [2] and dedup.by_canonical_key(once).count() == 1


def test_fuzzy():
    assert dedup.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert dedup.token_set_ratio("red bolt maker", "maker of red bolt") == 100.0
    assert dedup.token_set_ratio("", "x") == 0.0


def test_fuzzy_groups_are_those_of_a_plain_pass(spark):
    rng = random.Random(3)
    companies, titles, places = ["Acme Works", "Acme Work", "Supplier#000000001", "Supplier#000000012", "Bolt and Ring", ""], ["red bolt maker", "red bolt makers", "maker of red bolts", "small ring", "ring", "senior ring polisher of the small ring", ""], ["Rabat", "Rabat Sale", "Sale Rabat", "Fes", ""]
    rows = []
    for i in range(160):
        t = rng.choice(titles)
        if t and rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("abz") + t[k + 1 :]
        rows.append((i, rng.choice(companies), t, rng.choice(places), "d" * rng.randint(0, 9), None))
    df = spark.createDataFrame(rows, "row_id long, company string, title string, location string, description string, created timestamp")
    key = lambda *x: " ".join(re.sub("[^a-z0-9 ]", " ", " ".join(x).lower()).split())
    kept, want = [], {}
    for i, c, t, p, _, _ in rows:
        name, place = key(c, t), key(p)
        near = lambda q, own=place: not q or not own or q == own or dedup.token_set_ratio(q, own) >= 90
        want[i] = next((k for k, n, q in kept if name and near(q) and dedup.token_set_ratio(n, name) >= 92), i)
        if want[i] == i:
            kept.append((i, name, place))
    assert {r[0]: r[1] for r in dedup.fuzzy_groups(df).collect()} == want and len(set(want.values())) < 100
    best = {r["group"]: r["row_id"] for r in dedup.fuzzy_best(df).collect()}
    assert best == {g: max((i for i in want if want[i] == g), key=lambda i: (len(rows[i][4]), -i)) for g in set(want.values())}


def test_fuzzy_groups(spark):
    df = rows(spark, (1, "senior bolt maker", "Acme", "town", "", "", None, "", ""), (2, "bolt maker senior", "Acme", "town", "", "", None, "", ""), (3, "bolt maker senior", "Acme", "city", "", "", None, "", ""), (4, "baker", "Other", "", "", "", None, "", ""))
    assert {r[0]: r[1] for r in dedup.fuzzy_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pages(spark):
    ld = '<html><script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">[{"@type":"JobPosting","title":"Turner","datePosted":"2024-02-03T10:00","hiringOrganization":{"name":"Acme"},"description":"<p>Turn</p>"}]</script><h1>x</h1></html>'
    bare = "<html><body><h1>Miller</h1><p>Mill</p><li>Contrat : CDI</li></body></html>"
    out = extract.detail(spark.createDataFrame([("a", ld), ("b", bare)], "url string, html string")).orderBy("url").collect()
    assert (out[0]["title"], out[0]["company"], out[0]["created"], out[0]["description"]) == ("Turner", "Acme", "2024-02-03", "Turn")
    assert (out[1]["title"], out[1]["contract_type"]) == ("Miller", "CDI")
    assert one(spark, "x?page=2 y?page=11", extract.page_count) == 12


def test_tracker(spark):
    jobs = spark.createDataFrame([("a", "t1"), ("b", "t2")], "job_id string, title string")
    old = spark.createDataFrame([("a", " Applied ", "2001-01-01", "n", "f", "l"), ("gone", "saved", "", "", "f", "l")], "job_id string, status string, applied_date string, notes string, first_seen string, last_seen string")
    out = {r["job_id"]: r for r in state.sync_tracker(jobs, old, "now").collect()}
    assert set(out) == {"a", "b"} and out["a"]["status"] == "applied" and out["b"]["status"] == "to_apply" and out["b"]["first_seen"] == "now" and out["a"]["first_seen"] == "f"
    with pytest.raises(ValueError):
        state.update_tracker(old, "a", "lost", "now")


def test_sources(spark, tmp_path):
    assert tables.read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "raw.json").write_text('{"title":"t","company":{"display_name":"Acme"},"location":{"display_name":"Town"},"description":"","snippet":"s","updated":"2024-01-01","redirect_url":"u"}\n')
    r = tables.read_raw_json(spark, str(tmp_path / "raw.json")).first()
    assert (r["company"], r["location"], r["description"], r["created"], r["url"]) == ("Acme", "Town", "s", "2024-01-01", "u")
    tables.write_csv(spark.createDataFrame([('a "q"\nb',)], "title string"), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), "title string").first()[0] == 'a "q"\nb'


def test_pack():
    assert RulePack.from_json('{"market": "ch", "exclude": ["a", "b"], "tracks": [["x", ["y"]]]}').tracks == (("x", ("y",)),)
    with pytest.raises(ValueError):
        RulePack.from_dict({"mode": "other"})


def test_streaming_alerts(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3) for i in range(9)], "event_id long, user_id long")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    state_path, out = str(tmp_path / "state"), str(tmp_path / "out")
    run_alerts(spark, str(tmp_path / "in"), "event_id long, user_id long", state_path, out, str(tmp_path / "cp"), key="user_id")
    assert sorted(r[0] for r in spark.read.parquet(out).select("user_id").collect()) == [0, 1, 2]
    run_alerts(spark, str(tmp_path / "in"), "event_id long, user_id long", state_path, out, str(tmp_path / "cp"), key="user_id")
    assert spark.read.parquet(out).count() == 3


def test_repair(spark):
    broken = "caf\u00c3\u00a9 d\u00e2\u0080\u0099or " + "é".encode().decode("cp1252").encode().decode("cp1252")
    assert one(spark, broken, T.repair) == "café d'or é"
    assert one(spark, "déjà vu", T.repair) == "déjà vu" and one(spark, None, T.repair) == ""


def test_markup():
    root = markup.tree("<div><p>A&nbsp;b<p>c <script>x</script><ul><li>one<li>two<ul><li>in</ul></ul></b><img src=x>tail")
    assert root.lines() == "A b\nc\none\ntwo\nin\ntail" and [n.text() for n in root.all("li")] == ["one", "two in", "in"]
    assert markup.tree(None).text() == "" and markup.page_text("<b>x") == "x" and markup.job_description(markup.tree('<script type="application/ld+json">{broken</script>')) == ""


def test_spread(spark, tmp_path):
    df = spark.range(100)
    df.repartition(1).write.parquet(str(tmp_path / "one"))
    df.repartition(9).write.parquet(str(tmp_path / "nine"))
    assert tables.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.read.parquet(str(tmp_path / "nine"))
    assert tables.spread(many) is many


def test_canonical_columns(spark):
    df = spark.createDataFrame([("t", "Acme", None, "snip", "l")], "title string, `company.display_name` string, description string, snippet string, link string")
    r = tables.canonical(df).first()
    assert (r["company"], r["description"], r["url"], r["location"], r["salary_min"]) == ("Acme", "snip", "l", "", None)
    assert tables.output_name("be", "raw", "one") == "one_raw" and tables.output_name("ch", "queue") == "ch_queue"
