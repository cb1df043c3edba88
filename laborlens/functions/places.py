"""Locations as column expressions; gazetteers are tables (see ``enrich``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of states.
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
REMOTE = r"(?i)\b(remote|anywhere|distributed|worldwide)\b"


def parse(location: Column) -> Column:
    """Struct of city, state, country, is_remote.

    Remote places keep what follows a dash, or the last comma, as their country; others are city; city and state code
    or country; city, state and country.
    """
    text = F.trim(F.coalesce(location, F.lit("")))
    remote = text.rlike(REMOTE)
    dashed, listed = F.split(text, " - "), F.split(text, ", ")
    away = F.when(F.size(dashed) > 1, F.trim(F.get(dashed, F.lit(1)))).when(F.size(listed) > 1, F.trim(F.element_at(listed, -1))).otherwise("")
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    n = F.size(parts)
    second = F.get(parts, F.lit(1))
    code = F.upper(second).isin(US_STATES)
    country = F.when(n >= 3, F.get(parts, F.lit(2))).when(code, "US").when(n == 2, second).otherwise("")
    state = F.when(n >= 3, second).when(code, F.upper(second)).otherwise("")
    here = F.struct(F.get(parts, F.lit(0)).alias("city"), F.coalesce(state, F.lit("")).alias("state"), F.coalesce(country, F.lit("")).alias("country"), F.lit(False).alias("is_remote"))
    far = F.struct(F.lit("").alias("city"), F.lit("").alias("state"), away.alias("country"), F.lit(True).alias("is_remote"))
    return F.when(remote, far).otherwise(here)
