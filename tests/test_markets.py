"""Packs of the markets, phrases found in one pass, and the rules over rows of mixed markets; companies and texts are invented."""

import dataclasses
import random
import re

import pytest
from pyspark.sql import functions as F

from textforge import markets, vocabularies
from textforge.markets import MARKETS, Market
from textforge.operators import cascade, gates, langid, market, phrases, roles, rules
from textforge.operators import language as L

RULES = rules.of([dataclasses.replace(p, max_age_days=45) for p in MARKETS.values()], vocabularies.EXCLUDED_EXCEPTIONS)
NOW = "2024-03-01 00:00:00"
FILL = "We keep things in good order and like to work in small groups every day of the week. "


def table(spark, *rows):
    """Rows of (market, title, description, location, company)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id int, market string, title string, description string, location string, company string")


def judged(spark, *rows, when="2024-02-20", mode="strict", profiles=None):
    df = market.labelled(RULES.read(table(spark, *rows)), RULES, profiles).withColumn("created", F.lit(when).cast("timestamp"))
    df = market.scored(df, RULES, NOW)
    df = cascade.attributed(df, market.steps(RULES, NOW, mode)).withColumn("reason", market.first_reason(market.recheck_steps(RULES, NOW, mode)))
    return [r.asDict(recursive=True) for r in df.withColumn("review", L.review_reason(F.col("need"))).orderBy("row_id").collect()]


def test_which_pack_a_run_takes():
    assert markets.resolve(environment={})[0].name == "be" and markets.resolve(environment={})[1] == "strict"
    assert markets.resolve(environment={"JOB_MARKET": "CH ", "JOB_FILTER_MODE": "broad"}) == (MARKETS["ch"], "broad")
    pack, _ = markets.resolve("ch", "romandie", job_mode="speed", environment={"JOB_MARKET": "ma"})
    assert (pack.name, pack.focus, pack.speed, pack.enforce_places, pack.blocked_places) == ("ch", "romandie", True, True, ())
    assert markets.resolve("fr", "romandie", environment={})[0] == MARKETS["fr"]
    for wrong in ({"market": "zz"}, {"mode": "both"}, {"market": "ch", "focus": "ticino"}, {"job_mode": "slow"}):
        with pytest.raises(ValueError):
            markets.resolve(**wrong, environment={})


def test_packs():
    assert list(MARKETS) == ["be", "ch", "ma", "nl", "de", "fr", "gb", "ie", "ae"]
    assert all(Market.from_json(p.to_json()) == p for p in MARKETS.values())
    assert len(MARKETS["ch"].forbidden) == len(vocabularies.FORBIDDEN_ROLES) + 24 and dict(MARKETS["ch"].term_weights)["cloud support"] == 8 and dict(MARKETS["be"].term_weights)["cloud support"] == 6
    names = markets.outputs("ma")
    assert len(names) == 30 and names["apply_queue"] == "data/ma_apply_queue" and markets.outputs("be")["rekrute_jobs_filtered_broad"] == "data/rekrute_jobs_filtered_broad"


def plain_hits(kind, phrase, text):
    p = re.escape(phrase)
    if kind == "word" and re.fullmatch("[a-z0-9 ]+", phrase):
        return re.search(rf"(?<![a-z0-9]){p}(?![a-z0-9])", text) is not None
    if kind == "lone":
        return re.search(rf"(?<![a-z0-9_]){p}(?![a-z0-9_])", text) is not None
    if kind == "bounded" or (kind == "token" and re.fullmatch(r"\w+", phrase)):
        return re.search(rf"\b{p}\b", text) is not None
    return phrase in text


def test_one_pass_finds_what_single_searches_find():
    rng = random.Random(7)
    words = ["ab", "a", "b a", "a-b", "c++", "ab ", " a", "b", "_a", "é", "ba b", "9a"]
    book = phrases.Book.of([(k, words) for k in phrases.KINDS])
    for _ in range(1500):
        text = " ".join("".join(rng.choice("ab9_-+cé ") for _ in range(rng.randint(0, 14))).split())
        found = {i for _, _, i in phrases.occurrences(book, text)}
        assert found == {i for i, (k, p) in enumerate(book.entries) if plain_hits(k, p, text)}, text


def test_parts_of_a_row():
    book = phrases.Book.of([("word", ["rome", "turner", "old turner", "mill"]), ("part", [" old ", "er "])])
    look = lambda *row: {k: [book.entries[i][1] for i in v] for k, v in phrases.Reader(book, phrases.Context()).row(*row).items()}
    one = look("rome", "old turner", "mill in rome")
    assert one["loc"] == ["rome"] and one["title"] == ["turner", "old turner"] and one["desc"] == ["rome", "mill"] and one["work"] == ["rome", "turner", "old turner", "mill", "er "]
    assert one["place"] == ["rome", "turner", "old turner", " old "] and " old " not in one["title"]  # at its beginning there is no blank
    assert look("", "", "") == {k: [] for k in phrases.EVERY} and look("rome", "", "")["place"] == ["rome"] and look("", "", "mill")["text"] == ["mill"]


FAR = "x " * 200


@pytest.mark.parametrize("title, desc, reason", [
    ("Sales of pumps", "", "sales"), ("Engineer", f"sales of pumps {FAR}", "sales"), ("Engineer", f"{FAR} sales", ""), ("Engineer", f"{FAR} your role: sales", "sales"), ("Engineer", "you collaborate with sales daily", ""),
    ("", "", ""), ("Engineer", f"we work with sales {FAR} our sales {FAR} position sales", "sales"), ("Keycloak keeper", "", ""), ("Engineer", "A courier on a bicycle.", "delivery_role"),
    ("Commercial agent", "a quota each month", "commercial_sales"), ("Clerk", "commercial operations and a quota", ""), ("asp.net developer", "", ".net developer"), ("Clerk", "an asp.net developer", ""),
])
def test_role_named_in_context(spark, title, desc, reason):
    row = RULES.read(table(spark, ("be", title, desc, "", ""))).select(roles.forbidden_reason(RULES)).first()
    assert row[0] == reason


NEEDS = (
    # text, required, optional, blocked reason, review, acceptable, confidence
    ("Clerk wanted: English and Dutch (both mandatory).", "en|nl", "", "blocked_language_req:dutch_required", "", False, 0.8),
    ("English required; Dutch is a plus.", "en", "nl", "", "", False, 0.1),
    ("Une bonne maîtrise du néerlandais et du tact.", "nl", "", "blocked_language_req:dutch_required", "", False, 0.95),
    ("Nederlands is een plus. Kennis van koken is vereist.", "", "nl", "", "", False, 0.1),
    ("A trilingual desk: French, Dutch, English.", "nl", "", "blocked_language_req:dutch_required", "", False, 0.95),
    ("Our guests speak French or Dutch.", "", "", "", "", True, 0.15),
    ("German required, English required.", "de|en", "", "blocked_language_req:german_required", "", False, 0.0),
    ("Dutch or willing to learn Dutch mandatory.", "", "nl", "", "language_alternative:dutch_preferred_or_learn", False, 0.65),
    ("English or German.", "", "", "", "language_alternative:blocked_language_option", False, 0.0),
    ("Anything goes.", "", "", "", "", False, 0.0),
    ("", "", "", "", "", False, 0.0),
)


def test_language_needs(spark):
    df = spark.createDataFrame([(i, r[0].lower().replace("î", "i").replace("é", "e")) for i, r in enumerate(NEEDS)], "i int, t string").withColumn("n", L.language_need(F.col("t"), L.LanguageRules()))
    n = F.col("n")
    out = df.orderBy("i").select(F.array_join(n["required"], "|"), F.array_join(n["optional"], "|"), L.blocked_reason(n), L.review_reason(n), n["acceptable_without_main"], n["main_confidence"], L.blocked_reason(n, "broad")).collect()
    assert [tuple(r)[:6] for r in out] == [r[1:] for r in NEEDS] and {r[6] for r in out} == {""}


def test_blocked_languages_are_the_markets_own(spark):
    text = FILL + "German required. Kubernetes all day."
    out = judged(spark, *[(m, "DevOps engineer", text, "", "") for m in ("be", "ae", "fr", "de", "nl")])
    assert [r["first_fail"] for r in out] == ["blocked_language", "", "", "blocked_language", "blocked_language"]
    assert [r["first_fail"] for r in judged(spark, ("be", "DevOps engineer", text, "", ""), mode="broad")] == [""]


def test_places_by_market(spark):
    row = lambda m, place, title="DevOps engineer", desc=FILL: (m, title, desc, place, "")
    out = judged(
        spark, row("ma", "Fès"), row("ma", "Lyon"), row("ma", ""), row("be", "Lyon"), row("de", "Cluj"), row("de", "Berlin", "DevOps engineer in Kraków"), row("ch", "Zürich"), row("ch", "Lyon, France"),
        row("ch", "Lyon, France", desc=FILL + "Sometimes in Geneva."), row("xx", "Fès"),
    )
    assert [r["first_fail"] for r in out] == ["", "location", "", "", "location", "location", "location", "location", "", "known_market"]


def test_steps_one_by_one(spark):
    row = lambda title="DevOps engineer", desc=FILL, m="be": (m, title, desc, "", "")
    cases = [
        (row(), ""), (row(desc="Short."), "description_short"), (row("Senior DevOps engineer"), "bad_title"), (row("Clerk"), "role"), (row(desc=FILL + "A convention de stage is needed."), "student_internship"),
        (row(desc=FILL + "Security clearance first."), "excluded_word"), (row(desc=FILL + "At least 6 years of experience."), "experience"), (row("DevOps intern", m="ma"), "generic_internship"), (row("DevOps intern"), ""),
        (row(desc=FILL + "You work with senior engineers."), ""), (row(desc=FILL + "We seek a senior person for this position."), "excluded_word"), (row(desc=FILL + "Our lead likes tea."), ""),
        (row("DevOps lead"), "excluded_word"), (row(desc=FILL + "A track record of expertise in many tools."), "junior_score"), (row(None, None), "description_short"),
    ]
    out = judged(spark, *[c[0] for c in cases])
    assert [r["first_fail"] for r in out] == [c[1] for c in cases]
    assert [r["first_fail"] for r in judged(spark, row(), when="2024-01-01")] == ["not_recent"]


def test_recheck(spark):
    row = lambda title="DevOps engineer", desc=FILL: ("be", title, desc, "", "")
    out = judged(
        spark, row("Director of cloud"), row(desc="6 years of experience. " + FILL), row(desc="3 years of experience. " + FILL), row("Linux trainer"), row("Finance controller"), row(desc=FILL + "Every student may come."),
        row(desc=FILL + "Our lead likes tea."), row(),
    )
    assert [r["reason"] for r in out] == [
        "title_senior_marker:director", "explicit_senior_requirement:hard:6 years of experience", "explicit_experience_requirement:soft:3 years of experience", "non_target_role:trainer", "non_target_role:finance",
        "non_target_role:student_internship_required:student_only_keyword", "exclude_keyword:lead", "",
    ]
    d = spark.createDataFrame([(r["reason"], "devops engineer", {"title": []}) for r in out], "reason string, title_n string, found struct<title: array<int>>")
    told = d.select(market.triage(F.col("reason"), RULES).alias("t")).select("t.*").collect()
    assert [tuple(t) for t in told] == [(True, ""), (True, ""), (False, out[2]["reason"]), (True, ""), (True, ""), (True, ""), (False, "exclude_keyword:lead_soft"), (False, "")]


def test_scores(spark):
    out = judged(
        spark, ("ch", "Junior DevOps engineer", FILL + "Visa sponsorship. English only.", "Lausanne, Switzerland", "Amazon"), ("be", "DevOps engineer", FILL + "No visa sponsorship. Part of Accenture.", "", "Nobody"),
        ("nl", "DevOps engineer", FILL + "Visa sponsorship. 4 years experience.", "", ""),
    )
    assert [(r["sponsorship_score"], r["company_signal"], r["language_fit"]) for r in out] == [(5, 3, 2), (-8, 3, 1), (5, 0, 1)]
    assert [r["hiring_score"] for r in out] == [2, 0, -3] and out[0]["hiring_reasons"] == ["plus:junior"]
    # junior 2, fit 2, hiring 2, sponsor 5, company 3, track 2, devops + devops engineer + junior terms, training 2, region 5, age 4
    assert out[0]["priority"] == 50 + 4 + 4 + 2 + 5 + 3 + 2 + (4 + 4 + 4) + 2 + 5 + 4
    assert out[2]["priority"] == 50 + 0 + 2 - 3 + 2 * 5 + 0 + 2 + 8 + 4


def test_gates(spark):
    df = table(spark, ("ma", "Testeur QA", "Dutch speaking clients", "Fès", ""), ("ma", "Technicien IT", "", "", ""), ("be", "Testeur QA", "Dutch", "", ""), ("ma", "Ingénieur anglophone", "", "", ""), ("ma", None, None, None, None))
    df = df.withColumns({"priority": F.lit(90), "feedback_score": F.lit(0), "is_remote": F.lit(False), "sponsorship_score": F.lit(0), "language_fit": F.lit(1), "junior_score": F.lit(0), "search_term": F.lit("")})
    out = gates.gated(df, RULES, 68).orderBy("row_id").collect()
    assert [(r["adjusted"], r["penalty_reasons"], r["action"], r["gate"]) for r in out] == [
        (68, "language:nl | qa_testing", "review", "title_not_specific_enough"), (90, "", "apply_now", ""), (90, "", "apply_now", ""), (90, "", "review", "generic_language_title"), (90, "", "review", "empty_title"),
    ]
    assert {r["apply_reason"] for r in out} == {"language-fit"}


def test_languages_of_texts(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    profiles = langid.learnt(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("lang", langid.language(F.col("text"), profiles).alias("found"))
    right = {r[0]: r[1] for r in held.groupBy("lang").agg(F.avg((F.col("lang") == F.col("found")).cast("double"))).collect()}
    assert set(right) == {"en", "fr", "de", "es"} and min(right.values()) >= 0.99
    told = [
        ("nl", "Op zondag bakt mijn vader brood voor de hele straat"), ("nl", "Zij hebben het oude huis aan de gracht vorig jaar gekocht"), ("nl", "Wie te laat komt, moet achter in de zaal blijven staan"),
        ("nl", "Het water in de haven was die ochtend zo glad als een spiegel"), ("it", "La domenica mio padre cuoce il pane per tutta la strada"), ("en", "On Sundays my father bakes bread for the whole street"),
        ("fr", "Le dimanche, mon père cuit du pain pour toute la rue"), ("de", "Am Sonntag backt mein Vater Brot für die ganze Straße"), ("es", "Los domingos mi padre hace pan para toda la calle"), ("unknown", "12 34 !"), ("unknown", None),
    ]
    rows = spark.createDataFrame(told, "lang string, text string").select("lang", langid.language(F.col("text"), profiles).alias("a"), langid.language(F.col("text"), langid.built_in()).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(c, c) for c, _ in told]
    empty = spark.createDataFrame([], "text string, lang string")
    assert langid.learnt(empty) == langid.built_in()


def test_detected_language_fails_in_strict_mode(spark):
    dutch = langid.SAMPLES["nl"] + " DevOps en cloud."
    rows = [(m, "DevOps engineer", dutch, "", "") for m in ("be", "fr")]
    assert [r["first_fail"] for r in judged(spark, *rows, profiles=langid.built_in())] == ["detected_language", ""]
    assert [r["first_fail"] for r in judged(spark, *rows, mode="broad", profiles=langid.built_in())] == ["", ""]


def test_funnels_by_market_sum_up(spark):
    rows = [(m, t, FILL, "", "") for m in (*MARKETS, "xx") for t in ("DevOps engineer", "Clerk")]
    df = market.labelled(RULES.read(table(spark, *rows)), RULES).withColumn("created", F.lit("2024-02-20").cast("timestamp"))
    out = cascade.funnel(df, market.steps(RULES, NOW), by=("market",)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["market"], r["step_no"])):
        by.setdefault(r["market"], []).append(r)
    assert set(by) == {*MARKETS, "xx"}
    for name, steps in by.items():
        assert steps[0]["before"] == 2 and all(a["kept"] == b["before"] for a, b in zip(steps, steps[1:])) and steps[-1]["kept"] == (0 if name == "xx" else 1)
