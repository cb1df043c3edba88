"""Raw postings of four applicant-tracking systems, read with fixed schemas and brought to one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.functions.markup import commitment, html_to_text, parse_date
from laborlens.functions.places import parse
from laborlens.functions.titles import seniority

GREENHOUSE = "id string, absolute_url string, title string, location struct<name:string>, departments array<struct<name:string>>, content string, updated_at string"
LEVER = "id string, hostedUrl string, text string, createdAt string, descriptionPlain string, additional string, categories struct<location:string,team:string,commitment:string>, lists array<struct<text:string,content:string>>"
ASHBY = (
    "id string, slug string, title string, location string, locationName string, jobLocation struct<name:string>, department string, team string, departmentName string, employmentType string, type string, descriptionHtml string, description string, descriptionPlain string, "
    "jobUrl string, applyUrl string, publishedAt string, createdAt string, postedAt string"
)
WORKABLE = "id string, shortcode string, title string, location string, remote boolean, url string, application_url string, department string, worktype string, description string, published_on string, created_at string"
#: The record that all sources come to.
RECORD = [
    "source_ats", "source_job_id", "source_url", "title", "location_raw", "location_city", "location_state", "location_country", "location_is_remote", "department", "seniority_level", "employment_type", "description", "description_text", "posted_at",
]


def first_of(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns), F.lit(""))


def _record(raw: DataFrame, ats: str, **c: Column) -> DataFrame:
    place = parse(c["location"])
    limit = lambda e, n: F.nullif(F.left(e, F.lit(n)), F.lit("")) if ats == "greenhouse" else e
    html = c["description"]
    return raw.select(
        F.lit(ats).alias("source_ats"), c["id"].alias("source_job_id"), c["url"].alias("source_url"), F.coalesce("title", F.lit("")).alias("title"),
        F.left(c["location"], F.lit(512)).alias("location_raw") if ats == "greenhouse" else c["location"].alias("location_raw"),
        limit(place["city"], 255).alias("location_city"), limit(place["state"], 100).alias("location_state"), limit(place["country"], 100).alias("location_country"),
        (c.get("remote", F.lit(False)) | place["is_remote"]).alias("location_is_remote"), c["department"].alias("department"), seniority(F.col("title")).alias("seniority_level"),
        c.get("employment", F.lit("")).alias("employment_type"), html.alias("description"), c.get("plain", html_to_text(html)).alias("description_text"), c["posted"].alias("posted_at"),
    )


def greenhouse(raw: DataFrame) -> DataFrame:
    """First department; the last update as posting date; long places are cut."""
    return _record(
        raw, "greenhouse", id=first_of("id"), url=first_of("absolute_url"), location=first_of("location.name"), department=F.coalesce(F.try_element_at("departments", F.lit(1))["name"], F.lit("")), description=first_of("content"), posted=parse_date(F.col("updated_at"))
    )


def lever(raw: DataFrame) -> DataFrame:
    """Dates in milliseconds; the description put together from its parts and lists."""
    p = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("<p>"), c, F.lit("</p>")))
    listed = F.transform("lists", lambda x: F.concat_ws("\n", F.when(F.coalesce(x["text"], F.lit("")) != "", F.concat(F.lit("<h3>"), x["text"], F.lit("</h3>"))), F.nullif(x["content"], F.lit(""))))
    html = F.concat_ws("\n", p("descriptionPlain"), p("additional"), F.filter(listed, lambda x: x != ""))
    raw = raw.withColumn("title", F.col("text"))
    return _record(raw, "lever", id=first_of("id"), url=first_of("hostedUrl"), location=first_of("categories.location"), department=first_of("categories.team"), employment=commitment(F.col("categories.commitment")), description=html, posted=parse_date(F.col("createdAt")))


def ashby(raw: DataFrame) -> DataFrame:
    """The first filled of alternative fields; a plain description where there is no other."""
    html = first_of("descriptionHtml", "description")
    plain = first_of("descriptionPlain")
    whole = F.when((html == "") & (plain != ""), F.concat(F.lit("<p>"), plain, F.lit("</p>"))).otherwise(html)
    text = F.when((html == "") & (plain != ""), plain).otherwise(html_to_text(html))
    url = first_of("jobUrl", "applyUrl", F.concat(F.lit("https://jobs.ashbyhq.com/"), "slug", F.lit("/"), "id"))
    return _record(
        raw, "ashby", id=first_of("id"), url=url, location=first_of("location", "locationName", "jobLocation.name"), department=first_of("department", "team", "departmentName"), employment=commitment(first_of("employmentType", "type")), description=whole, plain=text, posted=parse_date(first_of("publishedAt", "createdAt", "postedAt"))
    )


def workable(raw: DataFrame) -> DataFrame:
    """Remote if flagged or if the place says so."""
    return _record(
        raw, "workable", id=F.coalesce("shortcode", "id"), url=F.coalesce("url", "application_url", F.lit("")), location=first_of("location"), remote=F.coalesce("remote", F.lit(False)), department=first_of("department"), employment=commitment(F.col("worktype")), description=first_of("description"), posted=parse_date(first_of("published_on", "created_at"))
    )


SOURCES = {"greenhouse": (GREENHOUSE, greenhouse), "lever": (LEVER, lever), "ashby": (ASHBY, ashby), "workable": (WORKABLE, workable)}


def read_postings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All sources (name to path of JSON files) as one table of RECORD."""
    out = None
    for name, path in paths.items():
        schema, normalise = SOURCES[name]
        one = normalise(spark.read.schema(schema).json(path)).select(*RECORD)
        out = one if out is None else out.unionByName(one)
    return out
