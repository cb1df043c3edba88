"""Names of skills as column expressions: display casing, and cleaning of mined candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are written in capitals.
ACRONYMS = (
    "sql aws gcp api apis html css js ui ux php xml json yaml csv npm cdn dom ci cd qa vpc ec2 s3 rds eks ecs iam sns sqs ssl tls ssh ftp tcp ip dns http https ml ai nlp llm gpt cv "
    "etl crm erp saas paas iaas bi kpi okr roi b2b b2c seo sem ppc jwt oauth sso sdk ide orm mvc mvp ios nosql css3 html5 es6 rest graphql ab"
).split()
#: Names with a casing of their own.
CASING = {
    "javascript": "JavaScript", "typescript": "TypeScript", "nodejs": "Node.js", "node.js": "Node.js", "reactjs": "React.js", "react.js": "React.js", "react": "React", "vuejs": "Vue.js", "vue.js": "Vue.js", "vue": "Vue",
    "angular": "Angular", "angularjs": "AngularJS", "nextjs": "Next.js", "next.js": "Next.js", "expressjs": "Express.js", "express.js": "Express.js", "nuxtjs": "Nuxt.js", "nuxt.js": "Nuxt.js",
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mongodb": "MongoDB", "mysql": "MySQL", "sqlite": "SQLite", "dynamodb": "DynamoDB", "mariadb": "MariaDB", "couchdb": "CouchDB", "neo4j": "Neo4j", "redis": "Redis",
    "github": "GitHub", "gitlab": "GitLab", "bitbucket": "Bitbucket", "devops": "DevOps", "devsecops": "DevSecOps", "jenkins": "Jenkins", "kubernetes": "Kubernetes", "docker": "Docker", "dockerfile": "Dockerfile", "terraform": "Terraform", "ansible": "Ansible",
    "tensorflow": "TensorFlow", "pytorch": "PyTorch", "scikit-learn": "scikit-learn", "sklearn": "scikit-learn", "opencv": "OpenCV", "openai": "OpenAI", "chatgpt": "ChatGPT", "numpy": "NumPy", "pandas": "pandas", "scipy": "SciPy", "matplotlib": "Matplotlib",
    "python": "Python", "java": "Java", "golang": "Go", "ruby": "Ruby", "rust": "Rust", "kotlin": "Kotlin", "scala": "Scala", "perl": "Perl", "r": "R", "c++": "C++", "c#": "C#", "csharp": "C#",
    "powerpoint": "PowerPoint", "powerbi": "Power BI", "power bi": "Power BI", "sharepoint": "SharePoint", "linkedin": "LinkedIn", "outlook": "Outlook", "onenote": "OneNote", "azure": "Azure", "dotnet": ".NET", ".net": ".NET",
    "ios": "iOS", "macos": "macOS", "watchos": "watchOS", "tvos": "tvOS", "xcode": "Xcode", "swift": "Swift", "objective-c": "Objective-C",
    "a/b testing": "A/B Testing", "ab testing": "A/B Testing", "ci/cd": "CI/CD", "cicd": "CI/CD", "agile/scrum": "Agile/Scrum", "agile": "Agile", "scrum": "Scrum", "kanban": "Kanban", "go-to-market": "Go-to-Market", "gtm": "GTM",
    "graphql": "GraphQL", "firebase": "Firebase", "webpack": "Webpack", "eslint": "ESLint", "prettier": "Prettier", "makefile": "Makefile", "linux": "Linux", "unix": "Unix", "bash": "Bash", "git": "Git",
    "jira": "Jira", "confluence": "Confluence", "figma": "Figma", "sketch": "Sketch", "photoshop": "Photoshop", "illustrator": "Illustrator",
}
#: Words that stay small inside a name.
SMALL_WORDS = "a an the and but or for nor on at to from by with in of as is vs".split()


def _casing() -> Column:
    return F.create_map(*(F.lit(x) for pair in CASING.items() for x in pair))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.char_length(word))))


def _titled(word: Column) -> Column:
    """First letter upper-cased; words all in capitals lose the others."""
    shouted = (word == F.upper(word)) & (word != F.lower(word))
    return F.when(shouted, _capital(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.char_length(word))))


def display_name(name: Column) -> Column:
    """A skill's name as it is shown: its own casing, capitals of acronyms, parts of a slash or dash, words."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    low = F.lower(n)
    acronym = lambda w: F.lower(w).isin(ACRONYMS)
    part = lambda w: F.coalesce(_casing()[F.lower(w)], F.when(acronym(w), F.upper(w)).otherwise(_titled(w)))
    small = lambda w, i: F.lower(w).isin(SMALL_WORDS) & (i > 0)
    slashed = F.array_join(F.transform(F.split(n, "/"), lambda w: part(F.trim(w))), "/")
    dashed = F.array_join(F.transform(F.split(n, "-"), lambda w, i: F.when(acronym(w), F.upper(w)).when(small(w, i), F.lower(w)).otherwise(_capital(w))), "-")
    words = F.array_join(F.transform(F.split(n, " "), lambda w, i: F.coalesce(_casing()[F.lower(w)], F.when(acronym(w), F.upper(w)).when(small(w, i), F.lower(w)).otherwise(_titled(w)))), " ")
    shaped = F.when(n.contains("/"), slashed).when(n.contains("-") & ~n.contains(" "), dashed).otherwise(words)
    return F.coalesce(_casing()[low], F.when(acronym(n), F.upper(n)).otherwise(shaped))


#: What a mined name loses at its front and at its end.
FRONT = (
    r"(?i)^(?:(?:a|an|the|our|your|their|its|strong|good|excellent|solid|deep|broad|extensive|proven|demonstrated|exceptional|advanced|basic|general|relevant|applicable|appropriate|significant|substantial|considerable)\s+)+"
)
END = r"(?i)\s*(?:skills?|experience|knowledge|background|expertise|tools?|ability|capabilities?|proficiency|understanding|principles?|concepts?|practices?|methodologies?|frameworks?)\s*$"
#: Names that are no skills.
NOT_SKILLS = [
    "pregnancy", "childbirth", "disability", "accommodation", "breastfeeding", "marital status", "national origin", "sexual orientation", "gender identity", "veteran status", "religion", "race", "ethnicity", "age", "color",
    "etc", "other", "similar", "relevant tools", "various", "any", "best practices", "methodologies", "various tools", "qualifications", "requirements", "preferred qualifications", "additional skills",
    "catered meals", "free lunch", "dental", "vision", "wellness", "paid time off", "equity", "vacation", "benefits", "hiring", "staffing", "recruiting", "onboarding",
    "using one", "layout", "specificity", "readiness", "please", "including", "such", "especially", "best", "secure", "web", "frontend", "backend", "full stack", "full-stack", "mobile", "cloud", "data", "software", "systems",
    "platform", "service", "services", "application", "applications", "integration", "infrastructure", "architecture", "development", "engineering", "design", "product", "operations",
    "particularly", "specifically", "primarily", "additional", "relevant", "applicable", "related",
]
#: Shapes of sentences, adjectives, fragments and occupations that are no skills either.
NO_NAME = [
    r"^[a-z]{1,3}$",
    r"(?i)^\d{1,2}\+?\s*years?$",
    r"(?i)\b(?:is|are|was|were|have|has|had|will|would|can|could|should|must|need to|able to|required to|expected to)\b",
    r"(?i)^(?:fast[- ]paced|large[- ]scale|high[- ]growth|early[- ]stage|cross[- ]functional|regulated|modern|legacy|agile|complex|distributed|scalable|global|local|remote|hybrid)\b",
    r"(?i)^(?:focus(?:ing)?\s+on|building\s+|working\s+(?:with|in|on)|managing\s+|leading\s+|designing\s+|developing\s+)",
    r"(?i)^(?:engineers?|developers?|designers?|managers?|analysts?|scientists?|researchers?|architects?|consultants?|specialists?|coordinators?|directors?|executives?|PMs?|VPs?|ICs?|devs?)$",
]


def clean_candidate(raw: Column) -> Column:
    """A mined name without brackets, filler and trailing nouns; null if what is left names no skill."""
    c = F.trim(F.regexp_replace(F.trim(raw), r"\s*\(.*?\)\s*$", ""))
    c = F.trim(F.regexp_replace(c, FRONT, ""))
    short = F.trim(F.regexp_replace(c, END, ""))
    c = F.regexp_replace(F.trim(F.when(F.char_length(short) >= 2, short).otherwise(c)), r"\.+$", "")
    bad = ~F.char_length(c).between(2, 50) | ~c.rlike("[A-Za-z]") | (F.size(F.split(F.trim(c), r"\s+")) > 6) | F.lower(c).isin(NOT_SKILLS)
    for pattern in NO_NAME:
        bad = bad | c.rlike(pattern)
    return F.when(~bad, c)


#: Verbs that begin a duty, words that begin a fragment, words of benefits, schooling and disclaimers.
DUTIES = (
    "manage|develop|design|build|create|implement|maintain|ensure|provide|support|help|work|lead|drive|own|coordinate|define|establish|partner|collaborate|communicate|deliver|execute|identify|monitor|improve|leverage|utilize|analyze|report|"
    "research|track|evaluate|review"
)
FRAGMENTS = r"(?i)^(?:and|or|the|a|an|in|of|for|with|to|at|by|as|on|our|your|their|this|that|these|those|is|are|was|were) "
OFF_TOPIC = (
    r"(?i)\b(?:intern(?:ship)?|volunteer|apprentice|werkstudent|praktikum|stagiaire|preferred|a plus|required|not required|lieu of education|degree required|benefits?|insurance|vacations?|holidays?|pto|401k?|wellness|tuition|reimbursement|disability|"
    r"accommodation|eeo|base pay|salary range|competitive pay|bonus|join our|we are looking|about us|equal opportunity|diversity|inclusion|disclaimer|please note|important note|high school|ged|diploma|bachelor|master'?s?|phd|degree in|graduate|"
    r"lift|carry|stand|walk|sit)\b"
)
QUALIFIERS = r"(?i)\s+(?:preferred|required|a plus|or similar|or equivalent|etc\.?)$"


def is_noise_candidate(name: Column) -> Column:
    """Too short or long, mostly foreign signs, a duty, a fragment, off topic, or a sentence."""
    n = F.trim(name)
    foreign = F.char_length(F.regexp_replace(n, r"[\x00-\x7F]", "")) / F.greatest(F.char_length(n), F.lit(1)) > 0.25
    left = F.char_length(F.trim(F.regexp_replace(n, QUALIFIERS, ""))) < 3
    return ~F.char_length(n).between(3, 70) | foreign | n.rlike(rf"(?i)^(?:{DUTIES})\b") | n.rlike(FRAGMENTS) | n.rlike(OFF_TOPIC) | left | (F.size(F.split(n, r"\s+")) > 8)
