"""The driver's tables as postings of nine markets: each document becomes a posting whose title, place and requirements come from other tables.

The invented prose has no job words, so each row gets a title, a place and a few sentences by the remainders of its keys;
its own text, whole, follows them. The phrases below are made up for this purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.functions.text import constant
from textforge.markets import MARKETS
from textforge.sources.tables import postings

TITLES = (
    "DevOps Engineer", "Junior Cloud Engineer (m/f/x)", "Senior Linux Administrator", "Système & réseau : administrateur réseau", "IT Support Specialist", "Sales Representative",
    "Trainee Platform Engineering", "Application Support Engineer", "Data Engineer", "Stage informatique", "Site Reliability Engineer", "Automation Engineer",
    "Automation Engineer PLC", "Helpdesk Agent", "Network Engineer", "Lead DevOps", "Commercial Manager", "Intern Kubernetes", "Clerk", "Build Engineer", "Technicien support",
    "Business Analyst", "Test Analyst", "Release Engineer (QA)", "Java Developer", "Railway Systems Engineer", "Cloud Operations Graduate", "Product Owner", "Staff Engineer", "Sysadmin",
    "Proxy Product Owner QA", "Ingénieur anglophone", "Formateur Linux", "Finance Controller", "Keycloak Administrator", "Electrical Technician", "Delivery Courier",
)
PLACES = (
    "Brussels", "Genève", "Zürich", "Casablanca", "Rabat-Salé", "Amsterdam", "Cluj", "Lyon", "London, United Kingdom", "Dublin", "Dubai", "", "Berlin", "Remote", "Lausanne, Switzerland",
    "Tangier", "Paris, France", "Vienna, Austria", "Sofia, Bulgaria",
)
DUTIES = (
    "You keep our servers running.", "Your role is business development in the region.", "We use Kubernetes, Docker and Terraform every day.", "The team includes sales and marketing colleagues.",
    "You work with data engineers from time to time.", "We are looking for a driver.", "You look after Linux and Azure.", "You will be trained on the job.", "Quota and pipeline matter to our commercial team.",
    "Hybrid work is possible.", "Work from home, fully remote.", "On-site in our office.", "A convention de stage is needed.", "Open to graduates.", "Every student may apply.", "You test PLC programs.",
    "You grow into senior roles and work with senior engineers.", "We seek a senior person for this position.", "Part of Accenture since last year.", "An international team with offices in four towns.",
    "Visa sponsorship and a relocation package.", "No visa sponsorship.", "You support the apprenticeship programme.", "BGP and OSPF are home to you.", "The job is in Geneva or in France.", "Security clearance is a must.",
    "",
)
YEARS = (
    "", "3 years of experience", "At least 5 years, experience in networks", "2-4 years experience", "1 year experience", "experience de 6 ans", "founded 20 years ago", "extensive experience",
    "solid experience with clients", "min 2 years in a team", "au moins 4 ans", "10 to 12 years experience", "experience significative",
)
SPEECH = (
    "", "English and Dutch are mandatory.", "Dutch is a plus, English required.", "Une bonne maîtrise du néerlandais.", "French or Dutch; both are welcome.", "German required.", "Trilingual: French, Dutch, English.",
    "English or German.", "Dutch or willing to learn Dutch mandatory.", "Nederlands is een plus.", "Fluent French.", "Italian required.", "English only.", "Fluent in Dutch and French.",
)
COMPANIES = ("Hillside", "Capgemini", "Amazon Web Services", "Lowland Works", "Orange", "Marble & Sons", "BT Group")
#: Markets as rows have them, and one that no pack knows.
NAMES = (*MARKETS, "xx")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(constant(list(values), "array<string>"), (key % len(values) + 1).cast("int"))


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings() with market, and title, company, location and description of a job: requirements first, then the whole document."""
    df, n = postings(spark, sf_dir), F.col("row_id")
    told = F.concat_ws(" ", _pick(DUTIES, n), F.concat(_pick(YEARS, F.floor(n / 3)), F.lit(".")), _pick(SPEECH, F.floor(n / 5)))
    return df.withColumns({
        "market": _pick(NAMES, n), "title": F.concat_ws(" - ", _pick(TITLES, F.floor(n / 2)), "title"), "company": _pick(COMPANIES, n), "location": _pick(PLACES, F.floor(n / 7)),
        "description": F.concat_ws(" ", told, F.col("description")),
    })


def _sql(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({key}) % {len(values)} + 1]"


#: The same rows in SQL, over the rows of `posting`.
JOBS_SQL = f"""jobs AS (
  SELECT * REPLACE ({_sql(TITLES, 'row_id // 2')} || ' - ' || title AS title, {_sql(COMPANIES, 'row_id')} AS company, {_sql(PLACES, 'row_id // 7')} AS location,
    concat_ws(' ', {_sql(DUTIES, 'row_id')}, {_sql(YEARS, 'row_id // 3')} || '.', {_sql(SPEECH, 'row_id // 5')}, description) AS description), {_sql(NAMES, 'row_id')} AS market
  FROM posting)"""
