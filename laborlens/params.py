"""Thresholds and windows, as the product defines them; ``as_of`` takes the place of the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Params:
    as_of: date = date(2001, 7, 15)
    months: int = 4
    #: A posting unseen for so many days counts as closed.
    stale_days: int = 90
    #: A cohort company was first seen so many days before the window starts, at the latest.
    cohort_buffer_days: int = 14
    min_cohort: int = 5
    top_skills: int = 150
    top_companies: int = 100
    min_salaries: int = 30
    min_role_jobs: int = 30
    match_threshold: float = 0.6
    match_min_skills: int = 3
    match_limit: int = 50
    qualify_active: int = 50
    qualify_cohort: int = 10
    qualify_top_share: float = 0.30
    min_abs_delta: int = 30
    top_n: int = 10
    sector_min: int = 3
    skill_min_jobs: int = 50
    skill_min_base: int = 20
    skill_min_share_delta: float = 0.3
    skill_min_companies: int = 8
    skill_max_concentration: float = 0.5
    emerging_days: int = 75
    emerging_companies: int = 3
    ai_subcategory: str = "AI & Machine Learning"
