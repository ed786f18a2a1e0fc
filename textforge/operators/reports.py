"""Reports and views over judged rows: reasons, parity, text quality, records for a viewer, its filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.operators.blocks import kept

#: What counts as true in text. Fixed values.
TRUE_TEXTS = ("true", "1", "yes")


def is_true(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*TRUE_TEXTS)


def whole_number(c: Column) -> Column:
    """Text as a whole number, cut towards zero; 0 where it is none."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def iso_time(c: Column) -> Column:
    """An ISO date or time as a timestamp, null where it is none."""
    return F.try_to_timestamp(F.trim(c))


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds as text, from the largest unit that is there."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def _top(df: DataFrame, column: str, most: int, order: str) -> DataFrame:
    counts = df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(most)


def top_reasons(df: DataFrame, column: str, most: int = 8, order: str = "row_id") -> DataFrame:
    """reason, n: the most frequent reasons; ties go to the one seen first."""
    return _top(df, column, most, order).select("reason", "n")


def summary(df: DataFrame, column: str, most: int = 8, order: str = "row_id") -> DataFrame:
    """One row: 'reason:n, reason:n'."""
    told = F.struct((-F.col("n")).alias("n"), "first", F.concat("reason", F.lit(":"), F.col("n").cast("string")).alias("t"))
    return _top(df, column, most, order).agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), ", ").alias("summary"))


def rule_groups(df: DataFrame, column: str, most: int, order: str = "row_id") -> DataFrame:
    """reason, n and up to three titles of rows that have it. Rows are judged once: what two passes read is written first."""
    df = kept(df.select(column, order, "title"), "groups")
    w = Window.partitionBy(column).orderBy(order)
    shown = df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 3").groupBy(column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "title"))), lambda x: x["title"]), " | ").alias("titles"))
    return top_reasons(df, column, most, order).join(shown.withColumnRenamed(column, "reason"), "reason")


def parity(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """n, n_differ: rows, and those that two ways of filtering judge differently."""
    return df.agg(F.count("*").alias("n"), F.count_if(~a.eqNullSafe(b)).alias("n_differ"))


def quality(df: DataFrame, least: int = 500) -> DataFrame:
    """action, n, n_short, n_missing, mean_length of the descriptions that an action rests on."""
    size = F.length(F.trim(F.coalesce("description", F.lit(""))))
    return df.groupBy("action").agg(F.count("*").alias("n"), F.count_if(size < least).alias("n_short"), F.count_if(size == 0).alias("n_missing"), F.bround(F.avg(size), 1).alias("mean_length"))


def is_repeat(keys: list[str], order: str = "row_id") -> Column:
    """Whether an earlier row has the same keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1


def new_hits(after: Column, before: Column) -> Column:
    """Hits that only the longer text has, sorted."""
    return F.array_sort(F.array_except(after, before))


def records(df: DataFrame) -> DataFrame:
    """df as a viewer shows it: numbers from text, defaults, flags. A row without a triage flag counts as ready."""
    text = lambda n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))
    status = F.lower(text("status"))
    ready = F.when(text("apply_ready") == "", F.lit(True)).otherwise(is_true(F.col("apply_ready")))
    return df.select(
        "row_id", text("title").alias("title"), text("company").alias("company"), text("location").alias("location"), text("url").alias("url"), F.substring(text("created"), 1, 10).alias("created"),
        F.when(status == "", "to_apply").otherwise(status).alias("status"), whole_number(F.col("priority")).alias("priority"), is_true(F.col("is_remote")).alias("is_remote"), ready.alias("ready"),
        F.when(text("action") == "", F.when(ready, "apply_now").otherwise("review")).otherwise(text("action")).alias("action"),
    )


def viewed(df: DataFrame, status: str = "", search: str = "", least: int | None = None, remote: bool = False) -> DataFrame:
    """Records by status, words in title, company or place, least priority and remote work; what is not given asks nothing."""
    if status:
        df = df.where(F.col("status") == status)
    if search:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", "title", "company", "location")), F.lit(search.lower())))
    if least is not None:
        df = df.where(F.col("priority") >= least)
    return df.where("is_remote") if remote else df


#: Orders by name; the last key makes each of them total.
ORDERS = {
    "priority": ("-action_rank", "-priority", "-created", "row_id"),
    "created": ("-created", "-priority", "row_id"),
    "company": ("company_key", "-priority", "row_id"),
    "tracker": ("-last_seen", "-first_seen", "-priority", "-created", "row_id"),
    "market": ("-priority", "-junior_score", "-language_fit", "-created", "row_id"),
}


def _key(name: str) -> Column:
    return {"action_rank": (F.col("action") == "apply_now").cast("int"), "company_key": F.lower("company")}.get(name, F.col(name))


def order_by(name: str) -> list[Column]:
    out = []
    for key in ORDERS[name]:
        c = _key(key.lstrip("-"))
        out.append(c.desc_nulls_last() if key.startswith("-") else c.asc())
    return out


def _precedes(row: Column, name: str) -> Column:
    """Whether a record stands before the given one, a struct of its keys, in an order."""
    ahead, same = F.lit(False), F.lit(True)
    for key in ORDERS[name]:
        c, v = _key(key.lstrip("-")), row[key.lstrip("-")]
        less = (c > v) if key.startswith("-") else (c < v)
        ahead, same = ahead | (same & F.coalesce(less, c.isNotNull() & v.isNull())), same & c.eqNullSafe(v)
    return ahead


def places(df: DataFrame, names: tuple[str, ...], most: int) -> DataFrame:
    """row_id and by_<name>, its place in each order, of the first `most` records by the first order.

    The orders are total. The few records are picked first, and one pass counts what stands before each of them: no
    order of the whole table is made.
    """
    keys = sorted({k.lstrip("-") for n in names for k in ORDERS[n]})
    top = df.orderBy(*order_by(names[0])).limit(most).select(*[_key(k).alias(k) for k in keys])
    picked = T.constant([r.asDict() for r in top.collect()], f"array<{top.schema.simpleString()}>")
    each = df.select(F.explode(F.transform(picked, lambda r: F.struct(r["row_id"].alias("row_id"), *[_precedes(r, n).cast("int").alias(n) for n in names]))).alias("x")).select("x.*")
    return each.groupBy("row_id").agg(*[(F.sum(n) + 1).alias(f"by_{n}") for n in names])


def link_score(title: Column, company: Column, location: Column, link: Column, label: Column, around: Column, tokens) -> Column:
    """How well a link of a results page fits a posting: 6 for a details link, 2 for each word of the title in its label, 1 for company and place around it."""
    common = lambda a, b: F.size(F.array_intersect(tokens(a), tokens(b)))
    return F.when(F.contains(link, F.lit("/details/")), 6).otherwise(0) + 2 * common(title, label) + common(company, around) + common(location, around)


def best_link(df: DataFrame, key: str, position: str = "pos", least: int = 2) -> DataFrame:
    """key, link: of df (key, link, score, pos) the first link with the greatest score, if that is enough."""
    best = df.groupBy(key).agg(F.max_by(F.struct("link", "score"), F.struct("score", -F.col(position))).alias("b"))
    return best.where(F.col("b.score") >= least).select(key, F.col("b.link").alias("link"))


def probe(rows: DataFrame, params: DataFrame, column: str, tokens: tuple[str, ...]) -> DataFrame:
    """Each parameter row with n and n_hits: sample rows of its base and place, and those whose column holds one of the tokens."""
    hit = F.lower(F.coalesce(F.col(column), F.lit(""))).rlike("|".join(tokens))
    counts = rows.groupBy("base", "place").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hits"))
    return params.join(counts, ["base", "place"], "left").na.fill(0, ["n", "n_hits"])


def alert_message(df: DataFrame, most: int = 10) -> DataFrame:
    """One row: the message column that a webhook would carry, one line for each of the first rows by priority."""
    top = df.orderBy(F.desc("priority"), "row_id").limit(most)
    line = F.format_string("[%d] %s - %s (%s)", "priority", "title", "company", "location")
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("k"), "row_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("message"))
