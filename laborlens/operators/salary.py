"""Salaries stated in descriptions: found by form and by what stands around them, brought to a year, checked against
likely ranges. All of it is column expressions over the text and the positions of its amounts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS = 2080
#: Likely yearly salaries by currency.
YEARLY = {
    "USD": (20000, 600000), "EUR": (18000, 450000), "GBP": (15000, 400000), "CAD": (20000, 650000), "AUD": (25000, 650000), "NZD": (25000, 550000), "INR": (150000, 30000000), "JPY": (2000000, 60000000), "CNY": (40000, 2500000),
    "SGD": (20000, 700000), "HKD": (100000, 4000000), "CHF": (35000, 500000), "SEK": (150000, 5000000), "NOK": (200000, 5000000), "DKK": (150000, 3500000), "PLN": (30000, 1000000), "CZK": (200000, 5000000), "BRL": (20000, 1200000),
    "MXN": (80000, 5000000), "ARS": (500000, 100000000), "CLP": (5000000, 300000000), "COP": (15000000, 250000000), "ILS": (60000, 1200000), "AED": (50000, 1800000), "SAR": (50000, 1500000), "KRW": (20000000, 300000000),
    "TWD": (400000, 15000000), "PHP": (150000, 12000000), "MYR": (25000, 1000000), "THB": (200000, 8000000), "IDR": (50000000, 2500000000), "VND": (100000000, 6000000000), "ZAR": (100000, 5000000), "EGP": (100000, 5000000),
    "NGN": (1000000, 250000000), "PKR": (300000, 25000000),
}
#: Likely hourly rates by currency.
HOURLY = {"USD": (8, 300), "EUR": (8, 275), "GBP": (7, 250), "CAD": (10, 325), "AUD": (12, 325), "NZD": (12, 275), "INR": (50, 15000), "SGD": (8, 350), "HKD": (50, 2500), "CHF": (15, 350), "JPY": (800, 40000)}
#: Forms in which pay is stated, in order, with the kind that tells what their numbers are.
FORMS = [
    ("lakh", r"₹?\s*([\d.]+)\s*(?:L|lakhs?|lacs?)\s*[-–—to]+\s*₹?\s*([\d.]+)\s*(?:L|lakhs?|lacs?|LPA|lpa)?\b"),
    ("lakh", r"([\d.]+)\s*[-–—to]+\s*([\d.]+)\s*(?:LPA|lpa|L\.?P\.?A\.?|lakhs?|lacs?)\b"),
    ("lakh", r"₹?\s*([\d.]+)\s*(?:LPA|lpa|L\.?P\.?A\.?|lakhs?|lacs?|L)\b"),
    ("thousands", r"[ACSNHK]{1,2}\$\s*([\d.]+)\s*[kK]\s*[-–—to]+\s*[ACSNHK]{0,2}\$?\s*([\d.]+)\s*[kK]"),
    ("plain", r"[ACSNHK]{1,2}\$\s*([\d,]+(?:\.\d+)?)\s*[-–—to]+\s*[ACSNHK]{0,2}\$?\s*([\d,]+(?:\.\d+)?)"),
    ("thousands", r"[\$£€]\s*([\d.]+)\s*[kK]\s*[-–—to]+\s*[\$£€]?\s*([\d.]+)\s*[kK]"),
    ("thousands first", r"[\$£€]\s*([\d.]+)\s*[kK]\s*[-–—to]+\s*[\$£€]?\s*([\d,]+)(?![kK\d])"),
    ("thousands last", r"[\$£€]\s*([\d,]+)\s*[-–—to]+\s*[\$£€]?\s*([\d.]+)\s*[kK]"),
    ("thousands", r"[\$£€]\s*([\d.]+)\s*[kK](?:[\s/,.\-+;)]|per|annum|annual|year|$)"),
    ("plain", r"[\$£€₹]\s*([\d,]+(?:\.\d+)?)\s*(?:to|TO|To)\s*[\$£€₹]?\s*([\d,]+(?:\.\d+)?)"),
    ("plain", r"[\$£€₹]\s*([\d,]+(?:\.\d+)?)\s*-\s*[\$£€₹]?\s*([\d,]+(?:\.\d+)?)"),
    ("hourly", r"[\$£€]\s*([\d,]+(?:\.\d+)?)\s*(?:/\s*(?:hr|hour|h\b)|per\s+hour)"),
    ("marked", r"[\$£€]\s*([\d,]+(?:\.\d+)?)\s*[kK]?\s*(?:/\s*(?:year|yr|annum|annual|p\.?a\.?)|per\s+(?:year|annum))"),
    ("marked", r"(?:base\s+)?(?:salary|compensation|pay|package)[:\s]+[\$£€₹]\s*([\d,]+(?:\.\d+)?)[kK]?"),
    ("marked", r"(?:USD|EUR|GBP|CAD|AUD|SGD)\s*([\d,]+(?:\.\d+)?)\s*[kK]?"),
    ("marked", r"([\d,]+(?:\.\d+)?)\s*[kK]?\s*(?:USD|EUR|GBP|CAD|AUD|SGD)"),
    ("single", r"[\$£€₹]\s*([\d,]+(?:\.\d+)?)"),
]
#: Announcements and figures that are taken out of a text before it is read.
ANNOUNCED = [
    r"(?:we've\s+|we\s+have\s+)?raised\s+[\$€£]?\s*[\d,.]+(?:\.\d+)?[mMbB](?:\s+(?:in\s+)?(?:funding|from|series|to\s+date))?[^.]*\.",
    r"[\$€£][\d,.]+(?:\.\d+)?[mMbB]\s+(?:raised|in\s+funding|funding)[^.]*\.",
    r"series\s+[a-z]\s+(?:of\s+)?[\$€£]?\s*[\d,.]+[mMbB][^.]*\.",
    r"backed\s+by\s+[\$€£]?\s*[\d,.]+[mMbB][^.]*\.",
    r"valued\s+at\s+[\$€£]?\s*[\d,.]+[mMbB][^.]*\.",
    r"[\$€£][\d,.]+[mMbB]\s+valuation[^.]*\.",
    r"(?:\d+\+?\s+(?:countries|languages|employees|customers|users|members|offices)[,\s;]*){2,}[\$€£]?[\d,.]+[mMbB]?[^.]*",
]
#: Phrases within 120 characters of an amount that make it no pay: funding, budgets, revenue, perks.
OTHER = [
    r"raised\s+[\$€£]?\s*[\d,.]+", r"[\$€£]?\s*[\d,.]+[mMbB]?\s+(?:raised|funding|in\s+funding)", r"series\s+[a-z]\s+(?:of\s+)?[\$€£]?\s*[\d,.]+", r"(?:seed|venture|funding)\s+(?:round|of)\s+[\$€£]?\s*[\d,.]+",
    r"(?:secured|closed|announced)\s+[\$€£]?\s*[\d,.]+[mMbB]?", r"[\$€£]?\s*[\d,.]+[mMbB]?\s+(?:valuation|investment|round)", r"total\s+funding\s+(?:of\s+)?[\$€£]?\s*[\d,.]+", r"backed\s+by\s+[\$€£]?\s*[\d,.]+", r"(?:venture|vc|pe)\s+backed", r"funding\s+to\s+date",
    r"budget[s]?\s+(?:of\s+|greater\s+than\s+|over\s+|exceeding\s+|up\s+to\s+)?[\$€£]?\s*[\d,.]+", r"[\$€£]?\s*[\d,.]+[kKmM]?\s+budget", r"managing\s+(?:a\s+)?[\$€£]?\s*[\d,.]+", r"(?:manage|handle|oversee|responsible\s+for)\s+.*?[\$€£]?\s*[\d,.]+[kKmM]?\s+(?:budget|spend|portfolio)",
    r"(?:budget|spend|investment)\s+(?:of\s+)?[\$€£]?\s*[\d,.]+", r"revenue\s+(?:of\s+)?[\$€£]?\s*[\d,.]+", r"[\$€£]?\s*[\d,.]+[mMbB]?\s+(?:revenue|arr|mrr|gmv|aum)", r"(?:annual|monthly|yearly)\s+(?:revenue|recurring)", r"(?:generated|generating|driving|drove|grew|grown)\s+[\$€£]?\s*[\d,.]+",
    r"(?:pipeline|bookings|sales)\s+(?:of\s+)?[\$€£]?\s*[\d,.]+", r"[\$€£]?\s*[\d,.]+\s+(?:in\s+)?(?:revenue|sales|bookings)", r"(?:save|saving|discount|off)\s+[\$€£]?\s*[\d,.]+", r"[\$€£]?\s*[\d,.]+\s+(?:off|discount|savings?|gift)", r"gift\s*card",
    r"(?:referral|signing|sign-on|sign\s+on)\s+bonus\s+(?:of\s+)?[\$€£]?\s*[\d,.]+", r"[\$€£]?\s*[\d,.]+\s+(?:referral|signing|sign-on)\s+bonus", r"(?:wellness|learning|education|home\s+office)\s+(?:stipend|allowance|budget)", r"(?:stipend|allowance)\s+(?:of\s+)?[\$€£]?\s*[\d,.]+",
]
#: Figures of a company; two kinds of them around an amount make it no pay.
FIGURES = [
    r"\d+\+?\s+(?:countries|languages|employees|customers|users|members)", r"community\s+(?:of\s+)?\d+", r"\d+[kKmM]?\+?\s+(?:community|users|customers|clients)", r"(?:across|in)\s+\d+\+?\s+(?:countries|markets|regions)", r"team\s+of\s+\d+", r"\d+\+?\s+(?:team\s+)?members",
]
#: Equity, unless pay is said to come with it.
EQUITY = r"(?:equity|stock|rsu|options?)\s+(?:grant|award|package)\s+(?:of\s+)?[\$€£]?\s*[\d,.]+|[\$€£]?\s*[\d,.]+\s+(?:in\s+)?(?:equity|stock|rsu)|(?:vest|vesting)\s+[\$€£]?\s*[\d,.]+"
WITH_EQUITY = r"(?:salary|base|cash|compensation)\s*(?:\+|plus|and)"
#: What an amount is that one of these phrases, within 50 characters, overlaps; and marks of postings' numbers.
COUNTS = [
    r"years?\s+(?:of\s+)?experience", r"experience\s*[:]\s*\d+", r"\d+\s*\+?\s*years?", r"\d+\s*months?", r"\d+\s*days?", r"\d+\s*hours?", r"\d+\s*weeks?", r"team\s+of\s+\d+", r"\d+\s*people", r"\d+\s*employees", r"\d+\s*customers", r"\d+\s*users", r"\d+\s*members", r"\d+\s*locations",
    r"\d+\s*countries", r"\d+\s*offices", r"founded\s+(?:in\s+)?\d+", r"since\s+\d+", r"established\s+\d+", r"\d+\s*%", r"top\s*\d+", r"#\d+",
]
NUMBERED = r"#?li-[a-z0-9]+|ref[:\s#]*\d+|id[:\s#]*\d+|job[:\s#]*\d+|requisition[:\s#]*\d+|posting[:\s#]*\d+|req[:\s#]*\d+"
MODELS = [r"[a-z]\d+l\b", r"model\s*\d+", r"version\s*\d+", r"v\d+\.\d+", r"iphone\s*\d+", r"series\s*\d+"]
#: Words around short amounts that speak of pay, around single amounts too, and those that rule these out.
PAY = r"salary|compensation|pay|package|ctc|annual|per year|per annum|p\.a\.|/year|/yr|base|total|offer|range|between|from|upto|up to|earn|income|remuneration|wage|lpa|lakhs|lacs|₹|inr|usd|eur|gbp|k/year|k per|k annually"
SAID = r"salary|compensation|pay|wage|earning|base|annual|yearly|per year|per annum|p\.a\.|/year|/yr|/annum|ctc|package|offer|lpa|lakhs per annum|ote|on-target|on target|on-track|cash comp|total comp"
NO_PAY = r"gift|card|stipend|allowance|save |discount|purchase|buy |price|cost|fee|funding|revenue|investment|valuation|budget|credit|reimburs|expense|bonus of|referral|raised|series|venture|backed|round|arr|mrr"
PER_HOUR = r"[\d.,]+\s*/\s*(?:hr|hour)|\$\s*[\d.,]+\s+(?:per|an)\s+hour|hourly\s+(?:rate|pay|wage|salary|compensation)|[\d.,]+\s+per\s+hour|rate[:\s]+\$\s*[\d.,]+\s*/\s*h|(?:hourly|per\s+hour)[:\s]*\$|\$\s*[\d.,]+\s*(?:hr|hour)\b"
SHOPPING = r"gift\s*card|stipend|allowance|save\s+\$|discount|purchase|buy\s+|\bprice\b|\bcost\b|\bfee\s|raised\s+\$|\bfunding\b|\brevenue\b|\binvestment\b|\bvaluation\b|market\s*cap|\bbudget\b|credit\b|reimburs|expense"
#: Signs and codes by which an amount names its currency, in order.
SIGNS = [("A$", "AUD"), ("C$", "CAD"), ("S$", "SGD"), ("HK$", "HKD"), ("NZ$", "NZD"), ("£", "GBP"), ("€", "EUR"), ("₹", "INR")]
CODES = ["CAD", "AUD", "USD", "GBP", "EUR", "SGD", "INR", "CHF"]
DOLLARS = ["USD", "CAD", "AUD", "NZD", "SGD", "HKD"]


def _limit(table: dict[str, tuple[int, int]], currency: Column, which: int, default: str = "USD") -> Column:
    bounds = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(float(v[which])))))
    return F.coalesce(F.try_element_at(bounds, currency), F.lit(float(table[default][which])))


def is_valid(low: Column, high: Column, currency: Column) -> Column:
    """Within the currency's range (a tenth over it at the top), in order, and at most four to one."""
    return (low >= _limit(YEARLY, currency, 0)) & (high <= _limit(YEARLY, currency, 1) * 1.1) & (low <= high) & (high <= low * 4)


def currencies_of(locations: DataFrame, places: DataFrame) -> DataFrame:
    """(location, currency) of distinct ``locations`` by ``places`` (place, currency): the whole, else a part
    between delimiters, else a word of it; the longest wins."""
    each = locations.select("location").distinct().withColumn("l", F.lower(F.trim("location")))
    parts = F.array_distinct(F.concat(F.array("l"), F.split("l", r"\s*[,;|/]\s*"), F.split("l", r"[^\p{L}]+")))
    keys = each.select("location", F.posexplode(parts).alias("p", "key"))
    met = keys.join(places.select(F.lower("place").alias("key"), "currency"), "key")
    return met.groupBy("location").agg(F.min(F.struct(F.when(F.col("p") == 0, 0).otherwise(1), (-F.char_length("key")), "key", "currency"))["currency"].alias("currency"))


def readable(text: Column) -> Column:
    """A description without announcements and company figures, dashes and signs in one way."""
    for pattern, put in zip(ANNOUNCED, [" [FUNDING_REMOVED] "] * 6 + [" [STATS_REMOVED] "], strict=True):
        text = F.regexp_replace(text, f"(?i){pattern}", put)
    return F.regexp_replace(F.translate(text, "–—−", "---"), r"([$£€])\s+", "$1")


def _around(reach: int, start: Column, stop: Column) -> Column:
    """The text within so many characters of the amount, in lower case."""
    begin = F.greatest(start - reach, F.lit(1))
    return F.lower(F.col("t").substr(begin, stop + reach - begin))


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _is_other() -> Column:
    """Whether what stands within 120 characters of an amount makes it something else than pay."""
    near, after = F.col("near"), F.lower(F.trim(F.col("t").substr(F.col("stop"), F.lit(15))))
    large = F.col("m").rlike(r"[\d.]+\s*[mMbB]\b") | after.rlike(r"^(?:mm?|bn?)\b|^million|^billion")
    figures = sum((near.rlike(p).cast("int") for p in FIGURES), F.lit(0))
    return large | near.rlike(_any(OTHER)) | (figures >= 2) | (near.rlike(EQUITY) & ~near.rlike(WITH_EQUITY))


def _is_number() -> Column:
    """Whether an amount is part of a link, tag, model or reference, or a count of something."""
    close, low = F.col("close"), F.lower("m")
    first = F.greatest(F.col("start") - 50, F.lit(1))
    linked = F.exists(F.split(close, r"\s+"), lambda w: w.rlike("https?://|www\\.|#") & F.contains(w, F.trim(low)))
    before, after = F.col("t").substr(F.greatest(F.col("start") - 5, F.lit(1)), F.least(F.lit(5), F.col("start") - 1)), F.col("t").substr(F.col("stop"), F.lit(5))
    rupees = F.contains(F.col("t").substr(F.greatest(F.col("start") - 3, F.lit(1)), F.least(F.lit(3), F.col("start") - 1)), F.lit("₹")) & F.startswith(F.lower(after), F.lit("l"))
    glued = before.rlike("[a-zA-Z]$") | (after.rlike("^[a-zA-Z]") & ~after.rlike(r"^[kK]\b") & ~rupees)
    model = F.lit(False)
    for p in MODELS:
        model = model | F.contains(F.regexp_extract(close, p, 0), low)
    counted = F.lit(False)
    for p in COUNTS:
        at = F.regexp_instr(close, F.lit(p))
        counted = counted | ((at > 0) & (F.col("stop") > first + at - 1) & (F.col("start") < first + at - 1 + F.char_length(F.regexp_extract(close, p, 0))))
    short = (F.char_length("m") <= 3) & ~close.rlike(PAY)
    return linked | F.contains(before, F.lit("#")) | model | glued | close.rlike(NUMBERED) | counted | short


def stated_salaries(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, salary_min, salary_max, currency, is_hourly) of ``docs`` (id, text, location) that state one.

    Forms of stating pay are tried in order, each on the first place where it stands; the first that the text around
    doesn't make something else, and that gives a likely salary, tells. An amount alone must be said to be pay. What
    stands around a place is cut out of the text by its position: 120 characters for funding, budgets, revenue and perks,
    100 for words of pay, 50 for counts and numbers, 30 for what is bought. A text of one place is read once, however many
    postings say it, and goes back to them by its digest.
    """
    each = docs.filter(F.col("text").rlike(r"\d"))
    texts = each.select("text", "location").distinct()
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    t = texts.join(currencies_of(texts, places), "location", "left").select(digest, "location", F.lower("text").alias("whole"), readable(F.col("text")).alias("t"), F.coalesce("currency", F.lit("USD")).alias("local"))
    group = lambda p, i: F.regexp_extract("t", f"(?i){p}", i)
    found = [
        F.when(F.regexp_instr("t", F.lit(f"(?i){p}")) > 0, F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.regexp_instr("t", F.lit(f"(?i){p}")).alias("start"), group(p, 0).alias("m"), group(p, 1).alias("n1"), (group(p, 2) if re.compile(p).groups == 2 else group(p, 1)).alias("n2")))
        for k, (kind, p) in enumerate(FORMS)
    ]
    # What stands around is cut out before the places become rows: behind, each of the patterns would cut it out again.
    stops = lambda x: x["start"] + F.char_length(x["m"])
    about = lambda x: x.withField("stop", stops(x)).withField("near", _around(120, x["start"], stops(x))).withField("close", _around(50, x["start"], stops(x)))
    places_of = F.transform(F.filter(F.array(*found), lambda x: x.isNotNull()), about)
    text = ["digest", "location", "whole", "t", "local"]
    rows = t.select(*text, F.explode(places_of).alias("f")).select(*text, "f.*").filter(~_is_other() & ~_is_number())
    currency = F.lit(None).cast("string")
    for code in reversed(CODES):
        currency = F.when(F.col("m").rlike(rf"(?i)\b{code}\b"), code).otherwise(currency)
    for sign, code in reversed(SIGNS):
        currency = F.when(F.contains("m", F.lit(sign)), code).otherwise(currency)
    dollar = F.when(F.contains("m", F.lit("$")), F.when(F.col("local").isin(DOLLARS), F.col("local")).otherwise("USD"))
    kind = F.col("kind")
    rows = rows.withColumn("cur", F.when(kind == "lakh", "INR").otherwise(F.coalesce(currency, dollar, "local")))
    thousand = F.when(F.lower("m").contains("k"), 1e3).otherwise(1.0)
    first = F.when(kind == "lakh", 1e5).when(kind.isin("thousands", "thousands first"), 1e3).when(kind == "marked", thousand).otherwise(1.0)
    last = F.when(kind == "lakh", 1e5).when(kind.isin("thousands", "thousands last"), 1e3).when(kind == "marked", thousand).otherwise(1.0)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    rows = rows.withColumns({"a": number("n1") * first, "b": number("n2") * last})
    said = (kind != "single") | (_around(100, F.col("start"), F.col("stop")).rlike(SAID) & ~_around(30, F.col("start"), F.col("stop")).rlike(NO_PAY))
    rate = (F.col("a") >= _limit(HOURLY, F.col("cur"), 0)) & (F.col("a") <= _limit(HOURLY, F.col("cur"), 1))
    by_hour = rate & ((kind == "hourly") | ((kind == "single") & F.col("whole").rlike(PER_HOUR) & ~F.col("whole").rlike(SHOPPING)))
    rows = rows.filter(said & ((kind != "hourly") | rate)).withColumn("is_hourly", by_hour)
    times = F.when(F.col("is_hourly"), float(HOURS)).otherwise(1.0)
    rows = rows.withColumns({"low": F.floor(F.least("a", "b") * times), "high": F.floor(F.greatest("a", "b") * times)}).filter(is_valid(F.col("low"), F.col("high"), F.col("cur")))
    told = rows.groupBy("digest", F.col("location").alias("at")).agg(F.min(F.struct("k", "low", "high", "cur", "is_hourly")).alias("f"))
    met = each.select("id", "location", digest).join(told, "digest").filter(F.col("location").eqNullSafe(F.col("at")))
    best = met.groupBy("id").agg(F.min("f").alias("f"))
    return best.select("id", F.col("f.low").alias("salary_min"), F.col("f.high").alias("salary_max"), F.col("f.cur").alias("currency"), "f.is_hourly")
