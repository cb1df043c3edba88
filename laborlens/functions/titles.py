"""Job titles as column expressions: seniority, cleaning, noise. Rules run on distinct titles (see ``enrich``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level of a title by the first pattern that it holds.
LEVELS = [
    (r"\b(intern|internship|co[- ]?op)\b", "intern"),
    (r"\b(director|vp|svp|evp|chief|c[tfmoprs]o|ciso|head of|founding)\b", "director"),
    (r"\bdistinguished\b", "distinguished"),
    (r"\b(principal|fellow)\b", "principal"),
    (r"\b(senior|sr\.?)\s+staff\b", "senior-staff"),
    (r"\bstaff\b", "staff"),
    (r"\b(senior|sr\.?)\b", "senior"),
    (r"\biii\b", "senior"),
    (r"\blevel\s*3\b", "senior"),
    (r"\bengineer\s*3\b", "senior"),
    (r"\blead\b", "lead"),
    (r"\bii\b", "mid"),
    (r"\blevel\s*2\b", "mid"),
    (r"\bengineer\s*2\b", "mid"),
    (r"\bmid[- ]?level\b", "mid"),
    (r"\b(entry[- ]level|new\s*grad|early\s*career|apprentice|graduate)\b", "entry"),
    (r"\bengineer\s*(i|1)\b", "entry"),
    (r"\blevel\s*(i|1)\b", "entry"),
    (r"\b(junior|jr\.?)\b", "junior"),
    (r"\bassociate\b", "associate"),
]
#: Words for a level that are taken out of a title, the first that it holds.
STRIPPED = [
    (r"\bdistinguished\b", "distinguished"),
    (r"\bprincipal\b", "principal"),
    (r"\bstaff\b", "staff"),
    (r"\bsr\b\.?|\bsenior\b", "senior"),
    (r"\blead\b", "lead"),
    (r"\bjr\b\.?|\bjunior\b", "junior"),
    (r"\bentry[- ]level\b|\bearly[- ]career\b|\bnew grad\b", "entry"),
    (r"\bintern(?:ship)?\b", "intern"),
    (r"\bmid[- ]level\b|\bintermediate\b", "mid"),
]
#: Phrases in which "lead" is the role.
LEAD_ROLES = ("tech lead", "team lead", "technical lead", "engineering lead", "product lead", "design lead", "platform lead", "data lead")
#: Places and ways of working that end a title.
TAILS = (
    "remote|hybrid|on[- ]?site|us|usa|emea|apac|na|latam|europe|americas|global|north america|south america|united states|united kingdom|uk|canada|india|australia|japan|china|germany|france|spain|italy|brazil|mexico|"
    "new york|nyc|sf|san francisco|la|los angeles|seattle|austin|boston|london|berlin|paris|tokyo|singapore|amsterdam|dublin|toronto|100% remote(?:\\s*-\\s*usa)?|[a-z]{2}(?:\\s*-\\s*[a-z]{2,})?"
)
#: Kinds of employment in brackets, and bonus notes.
EMPLOYMENT = (
    r"\((?:remote|hybrid|on[- ]site|onsite|contract(?:or)?|full[- ]time|part[- ]time|work from home|wfh|temporary|temp|intern(?:ship)?|casual employee|full[- ]time contractor|ai[- ]native)\)"
    r"|-\s*sign[- ]on bonus available|sign[- ]on bonus|\bper diem\b"
)
#: Nouns that show that the role comes before a dash.
NOUNS = (
    "manager|engineer|analyst|specialist|coordinator|associate|lead|director|designer|scientist|developer|architect|consultant|representative|administrator|technician|supervisor|officer|head|advisor|agent|writer|editor|researcher|"
    "marketer|buyer|planner|trainer|recruiter|controller|accountant|auditor|counsel|paralegal|vp|president|executive|artist|producer|strategist|owner|principal"
)
#: What shows that a title isn't a role.
NOISE = (
    r"(?i)\bintern(?:ship)?\b|\bvolunteer\b|\bapprentice\b|\bwerkstudent\b|\bpraktikum\b|\bstagiaire\b|\bgeneral application\b|\bopen application\b|\bspontaneous\b|\bdon'?t see\b|\bexpress interest\b|\btalent pool\b|\bfuture role\b"
    r"|\bresume submission\b|\bsubmit your\b|\bjoin our\b|\bkeep me in mind\b|\btest job\b|\bbug bash\b|\bunicorn job\b|\bdummy\b"
)
#: Phrases of postings that are open invitations.
SKIPPED = [
    "talent pool", "talent community", "join our talent", "talent network", "candidate pool", "oyster talent", "don't see what you're looking for", "didn't see what you are looking for", "don't see your dream job", "don't see a role",
    "don't see the job", "don't see the perfect", "can't find a role", "general application", "general apply", "general interest", "general resume submittal", "open application", "interested in joining", "join our community",
    "introduce yourself", "register your interest", "sign up to our", "university talent network", "future opportunities", "future openings", "expression of interest", "early career program",
]


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, label in rules[1:]:
        out = out.when(text.rlike(pattern), label)
    return out


def seniority(title: Column) -> Column:
    """Level of a title; ``mid`` if nothing tells."""
    return F.coalesce(_first(F.lower(title), LEVELS).otherwise("mid"), F.lit("mid"))


def tidy(c: Column) -> Column:
    """Single spaces, no spaces, commas or dashes at the ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,-"))


def strip_level(title: Column) -> tuple[Column, Column]:
    """The level word of a title and the title without it; only the first that is found goes."""
    t = F.lower(title)
    role_lead = F.lit(False)
    for phrase in LEAD_ROLES:
        role_lead = role_lead | t.contains(phrase)
    level, rest = F.lit(None).cast("string"), t
    for pattern, name in reversed(STRIPPED):
        hit = t.rlike(pattern) & ~role_lead if name == "lead" else t.rlike(pattern)
        level = F.when(hit, name).otherwise(level)
        rest = F.when(hit, F.regexp_replace(t, pattern, " ")).otherwise(rest)
    return level, tidy(rest)


def delevel(title: Column) -> Column:
    """A lower-cased title without brackets at the end, employment and place tails, level numerals, and the
    project after a dash that follows a role noun. Repeated tails are taken up to three times, in one pattern each."""
    t = F.lower(F.translate(F.trim(title), "‘’–—", "''--"))
    t = F.trim(F.regexp_replace(t, r"(?:\s*\([^)]*\)\s*){1,3}$", ""))
    t = F.trim(F.regexp_replace(t, EMPLOYMENT, ""))
    for _ in range(3):
        t = F.btrim(F.regexp_replace(t, rf"[,\-|]\s*(?:{TAILS})\s*$", ""), F.lit(" ,-"))
    t = F.btrim(F.regexp_replace(t, r"(?:\s+|[-,]\s*)(?:i{1,3}v?|iv|v|[1-5])\s*$", ""), F.lit(" ,-"))
    t = F.regexp_replace(t, rf"^((?:.*\s)?(?:{NOUNS})(?:\s[^-]*?)?)\s+-\s+[a-z0-9&'!,.\s/-]+$", "$1")
    return tidy(t)


def is_noise(title: Column) -> Column:
    """Too short or long, mostly not ASCII, or in the words of an open invitation."""
    n = F.char_length(F.trim(title))
    foreign = F.char_length(F.regexp_replace(title, r"[\x00-\x7F]", ""))
    return (n < 3) | (n > 120) | (foreign / F.greatest(F.char_length(title), F.lit(1)) > 0.3) | title.rlike(NOISE)


def is_skipped(title: Column) -> Column:
    """An open invitation rather than a role."""
    t = F.translate(F.lower(title), "‘’", "''")
    out = F.lit(False)
    for phrase in SKIPPED:
        out = out | t.contains(phrase)
    return F.coalesce(out, F.lit(False))


def slug(title: Column) -> Column:
    """Lower-case letters and digits joined by dashes."""
    return F.btrim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), F.lit("-"))
