"""Scans and sinks: fixed schemas, tolerant reading, canonical postings from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textforge.functions.text import blank_null

RAW = "title string, company string, location string, created string, url string, salary_min double, salary_max double, description string, search_term string, source string"


def read_csv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """A CSV file with header and quoted line breaks; a missing one is an empty table."""
    try:
        return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Postings as an API returns them, company and location nested, in the canonical columns."""
    nested = "title string, company struct<display_name: string, name: string>, location struct<display_name: string>, description string, snippet string, created string, updated string, redirect_url string, url string, link string, salary_min double, salary_max double, search_term string"
    df = spark.read.schema(nested).json(path)
    return df.select(
        "title", F.coalesce("company.display_name", "company.name").alias("company"), F.col("location.display_name").alias("location"),
        F.coalesce(blank_null(F.col("created")), F.col("updated")).alias("created"), F.coalesce("redirect_url", "url", "link").alias("url"),
        "salary_min", "salary_max", F.coalesce(blank_null(F.col("description")), F.col("snippet")).alias("description"), "search_term",
    )


#: Where each canonical column comes from, first non-blank one first. Fixed values.
ALIASES = {"company": ("company", "company.display_name"), "location": ("location.display_name", "location"), "created": ("created", "updated"), "url": ("redirect_url", "url", "link"), "description": ("description", "snippet")}


def canonical(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A source's flat columns as the canonical ones, and those of `extra` that it has: texts never null, salaries as they are."""

    def text(name: str):
        found = [blank_null(F.col(f"`{c}`").cast("string")) for c in ALIASES.get(name, (name,)) if c in df.columns]
        return F.coalesce(*found, F.lit("")).alias(name)

    number = lambda n: (F.col(n).cast("double") if n in df.columns else F.lit(None).cast("double")).alias(n)
    names = ("title", "company", "location", "created", "url")
    return df.select(*map(text, names), number("salary_min"), number("salary_max"), text("description"), text("search_term"), *[n for n in extra if n in df.columns])


def output_name(market: str, stage: str, source: str = "", default_market: str = "be") -> str:
    """The logical name of a table: market (but for the default one), source and stage."""
    return "_".join(x for x in ("" if market == default_market else market, source, stage) if x)


def unify(sources: dict[str, DataFrame], default_term: str = "") -> DataFrame:
    """Union of the sources in the order given: `source` and `source_rank` are set, missing columns null, a blank term the default."""

    def mapped(rank: int, name: str, df: DataFrame) -> DataFrame:
        term = F.coalesce(blank_null(F.col("search_term")), F.lit(default_term)) if "search_term" in df.columns else F.lit(default_term)
        return df.withColumn("search_term", term).withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))

    parts = [mapped(i, n, d) for i, (n, d) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ranked_sources(df: DataFrame, default_term: str = "") -> DataFrame:
    """A table that holds several sources as unify() would make it of their parts: source_rank by name, a blank term the default.

    The distinct sources are ranked on their own and joined back, so the table is read once, whatever their number; rows
    without a source come last.
    """
    names = df.groupBy("source").agg(F.count("*").alias("_n"))
    ranks = names.select(F.col("source").alias("_source"), (F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("source_rank"))
    joined = df.join(ranks, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("search_term", F.coalesce(blank_null(F.col("search_term")), F.lit(default_term)))


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV file with header; quotes, line breaks and blanks at the ends of texts stay."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, share: int = 32 << 20) -> DataFrame:
    """A small table of fewer files than cores, dealt to all cores; any other as it is, so a large scan is never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * share and len(df.inputFiles()) < cores else df


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's tables as postings: row_id, title, company, location, description, url, html, created, search_term, lang, status."""
    t = {n: read_table(spark, sf_dir, n) for n in ("documents", "part", "supplier", "nation", "pages", "orders", "labels")}
    n = {k: t[k].count() for k in ("part", "supplier", "pages", "orders")}  # from the files' footers
    key = lambda k: F.col("doc_id") % n[k]
    status = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "interview").when((F.col("quality") == 1) & (F.col("toxic") == 1), "applied")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "rejected").when((F.col("quality") == 0) & (F.col("toxic") == 1), "withdrawn").otherwise("to_apply")
    )
    return (
        spread(t["documents"])
        .join(t["part"].select("p_partkey", F.col("p_name").alias("title")), key("part") == F.col("p_partkey"))
        .join(t["supplier"].select("s_suppkey", "s_nationkey", F.col("s_name").alias("company")), key("supplier") == F.col("s_suppkey"))
        .join(t["nation"].select("n_nationkey", F.col("n_name").alias("location")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["pages"].select("page_id", "url", "html"), key("pages") == F.col("page_id"))
        .join(t["orders"].select("o_orderkey", F.col("o_orderdate").alias("created")), key("orders") == F.col("o_orderkey"))
        .join(t["labels"], "doc_id", "left")
        .select(F.col("doc_id").alias("row_id"), "title", "company", "location", F.col("text").alias("description"), "url", "html", "created", F.col("source").alias("search_term"), "lang", status.alias("status"))
    )
