"""Everything about a role in one bundle, from one set of filtered postings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace as with_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import demand, filters, people, trends
from laborlens.params import Params
from laborlens.star import Star


def role_insights(
    star: Star, role_id: int, p: Params = Params(), seniority: str | None = None, locations: Sequence[str] | None = None, industries: Sequence[str] | None = None, company_ids: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """Named results for one role after filters F02 to F07. Trends count the filtered postings, among the cohort of all.

    All of them are lazy; the filtered postings are a filter pushed to the scan, cheaper to repeat than to keep.
    """
    jobs = star.jobs.filter((F.col("role_id") == role_id) & filters.seniority(seniority) & filters.place(locations))
    jobs = filters.by_company(filters.by_industry(jobs, star, industries), company_ids)
    own, whole = with_(star, jobs=jobs), with_(star, jobs=star.jobs.filter(F.col("role_id") == role_id))
    of = lambda df: df.filter(F.col("role_id") == role_id)
    return {
        "skills": demand.skill_demand(own, p).join(demand.skill_growth(whole, p).select("role_id", "skill_id", "growth_pct"), ["role_id", "skill_id"], "left"),
        "companies": demand.hiring_companies(own, p),
        "companies_of_skills": demand.companies_of_skills(own),
        "salary": demand.salary_band(own, p),
        "remote": demand.remote_split(own),
        "trend": of(trends.role_trend(star, p, jobs)),
        "market": of(trends.market_trend(star, p, jobs)),
        "ai": of(trends.ai_exposure(star, p, jobs)),
        "coverage": of(trends.trend_coverage(star, p, jobs)),
        "alternatives": of(people.alternative_roles(star, p)),
        "fitting_roles": people.person_alternatives(with_(star, persons=star.persons.filter(F.col("target_role_id") == role_id)), p),
    }


def sorted_skills(skills: DataFrame, category: str | None = None, by: str = "demand_pct", subcategory: str | None = None, descending: bool = True) -> DataFrame:
    """Skills of a category and subcategory, or all, by a column; unknown growth comes last when descending."""
    chosen = skills if filters.is_all(category) else skills.filter(F.lower("category") == category.lower())
    chosen = chosen if filters.is_all(subcategory) else chosen.filter(F.col("subcategory") == subcategory)
    return chosen.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first(), "skill_id")


def sorted_employers(companies: DataFrame, industry: str | None = None, by: str = "job_count", descending: bool = True) -> DataFrame:
    """A role's employers (as from ``hiring_companies``) of an industry, or all, by a column; unknown growth last."""
    chosen = companies if filters.is_all(industry) else companies.filter(F.lower("industry") == industry.lower())
    return chosen.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first(), "company_id")
