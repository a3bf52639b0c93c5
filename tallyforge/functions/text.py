"""Deterministic text features: normal form, tokens, tags, counts and classes."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, tag terms and class patterns of the feature schema.
BODY_STOPWORDS = [
    "about", "after", "again", "against", "also", "among", "been", "being", "between", "bill", "chapter", "commissioner", "each", "from", "have",
    "into", "more", "must", "other", "provided", "providing", "relating", "section", "shall", "state", "than", "that", "their", "there", "these",
    "this", "under", "upon", "which", "with", "within", "would", "minnesota",
]
TITLE_STOPWORDS = [
    "about", "after", "against", "also", "among", "and", "are", "bill", "chapter", "concerning", "for", "from", "into", "law", "laws", "making",
    "minnesota", "of", "on", "or", "relating", "section", "sections", "state", "the", "this", "to", "under", "with", "providing", "requiring",
    "certain", "various", "modifying", "establishing", "authorizing", "appropriating",
]
POLICY_TERMS = {
    "agriculture": ["agriculture", "agricultural", "farm", "farmer", "crop", "livestock"],
    "commerce": ["commerce", "consumer", "business", "license", "licensing", "insurance"],
    "education": ["education", "school", "teacher", "student", "college", "university"],
    "elections": ["election", "ballot", "voter", "campaign", "candidate"],
    "environment": ["environment", "pollution", "climate", "water", "natural resources", "wetland"],
    "health": ["health", "medical", "hospital", "patient", "medicaid", "pharmacy"],
    "housing": ["housing", "tenant", "landlord", "rent", "residential"],
    "human_services": ["human services", "child care", "disability", "public assistance", "foster care"],
    "judiciary": ["court", "judge", "judicial", "attorney", "civil law"],
    "labor": ["labor", "employment", "employer", "employee", "wage", "workplace"],
    "local_government": ["county", "municipal", "municipality", "township", "city council"],
    "public_safety": ["police", "law enforcement", "crime", "criminal", "corrections", "firearm"],
    "state_government": ["state agency", "department", "commission", "office of", "inspector general"],
    "taxes": ["tax", "taxation", "revenue", "credit", "deduction", "exemption"],
    "transportation": ["transportation", "highway", "road", "transit", "vehicle", "driver"],
}
ACTION_TERMS = {
    "appropriation": ["appropriat"],
    "authorization": ["authorized", "authorization", "may establish", "may issue"],
    "bonding": ["bond", "general obligation"],
    "grant": ["grant program", "grants", "grant award"],
    "mandate": ["shall", "must", "required to", "requirement"],
    "prohibition": ["may not", "shall not", "prohibited", "prohibition"],
    "regulatory": ["license", "permit", "rulemaking", "regulation", "regulated"],
    "reporting": ["report to", "submit a report", "study", "task force"],
    "tax_change": ["tax", "credit", "deduction", "exemption", "surcharge"],
}
ENTITY_TERMS = {
    "agencies": ["department", "agency", "commissioner", "board"],
    "children_families": ["child", "children", "family", "families"],
    "courts": ["court", "judge", "judicial"],
    "employers_workers": ["employer", "employee", "worker", "workplace"],
    "health_providers": ["hospital", "provider", "physician", "pharmacy"],
    "local_governments": ["county", "city", "municipal", "township"],
    "schools_students": ["school", "student", "teacher", "district"],
    "taxpayers": ["taxpayer", "tax credit", "income tax", "sales tax"],
    "voters": ["voter", "election", "ballot"],
}
EXPANSIONARY = "tax credit|tax deduction|tax exemption|grant program|money is appropriated"
CONTRACTIONARY = "tax increase|increase the tax|surcharge|fee increase|reduce the appropriation|appropriation is reduced"
#: The first class whose pattern is found anywhere.
ISSUE_PATTERNS = {
    "education": "education|school|teacher|student|college|university",
    "health": "health|medical|hospital|patient|pharmacy|medicaid|mncare",
    "human_services": "human services|child care|disabilit|foster care|public assistance",
    "taxes_revenue": "tax|revenue|credit|deduction|exemption",
    "public_safety": "public safety|police|law enforcement|crime|criminal|correction|firearm",
    "housing": "housing|tenant|landlord|rent|residential",
    "transportation": "transportation|highway|road|transit|vehicle|driver",
    "environment_natural_resources": "environment|natural resources|water|climate|pollution|wetland",
    "labor_employment": "labor|employment|employer|employee|wage|workplace",
    "elections": "election|ballot|voter|campaign",
    "agriculture": "agricultur|farm|crop|livestock",
    "commerce_consumer": "commerce|consumer|business|insurance|licens",
    "local_government": "local government|county|municipal|township|city",
    "judiciary_civil_law": "judiciar|court|judge|civil law|attorney",
    "state_government": "state government|state agency|department|commission",
}
#: The same classes by words.
ISSUE_WORDS = {
    "education": r"\beducation\b|\bschool|\bteacher|\bstudent|\bcollege|\buniversity",
    "health": r"\bhealth\b|\bmedical\b|\bhospital|\bpatient|\bpharmacy|\bmedicaid\b|\bmncare\b",
    "human_services": r"\bhuman services\b|\bchild care\b|\bdisabilit|\bfoster care\b|\bpublic assistance\b",
    "taxes_revenue": r"\btax|\brevenue\b|\bcredit\b|\bdeduction\b|\bexemption\b",
    "public_safety": r"\bpublic safety\b|\bpolice\b|\blaw enforcement\b|\bcrime\b|\bcriminal\b|\bcorrection|\bfirearm",
    "housing": r"\bhousing\b|\btenant|\blandlord|\brent\b|\bresidential\b",
    "transportation": r"\btransportation\b|\bhighway\b|\broad\b|\btransit\b|\bvehicle\b|\bdriver",
    "environment_natural_resources": r"\benvironment|\bnatural resources\b|\bwater\b|\bclimate\b|\bpollution\b|\bwetland",
    "labor_employment": r"\blabor\b|\bemployment\b|\bemployer|\bemployee|\bwage|\bworkplace\b",
    "elections": r"\belection|\bballot|\bvoter|\bcampaign\b",
    "agriculture": r"\bagricultur|\bfarm|\bcrop\b|\blivestock\b",
    "commerce_consumer": r"\bcommerce\b|\bconsumer|\bbusiness\b|\binsurance\b|\blicens",
    "local_government": r"\blocal government\b|\bcounty\b|\bmunicipal|\btownship\b|\bcity\b",
    "judiciary_civil_law": r"\bjudiciar|\bcourt\b|\bjudge\b|\bcivil law\b|\battorney\b",
    "state_government": r"\bstate government\b|\bstate agency\b|\bdepartment\b|\bcommission\b",
}
VOTE_KINDS = {
    "passage": r"\b(repassage|passage|final passage)\b",
    "amendment": r"\bamendment\b",
    "motion": r"\b(motion|recall|re-refer|reconsider)\b",
    "procedural": r"\b(procedural|rules? suspended|lay on the table|adjourn)\b",
}
#: Counted in the body, in this order.
LANGUAGE_PATTERNS = [
    r"\bsec\.\s*\d+",
    r"\bsubd\.\s*\d+",
    r"\bamended\b",
    r"\badding\s+a\s+section\b",
    r"\brepeal(?:ed|ing|s)?\b",
    r"\bappropriat(?:e|ed|es|ing|ion|ions)\b",
    r"\beffective\s+date\b",
    r"\bmeans\b",
    r"\bpenalt(?:y|ies)\b|\bmisdemeanor\b|\bfelony\b",
    r"\btax(?:es|able|ation)?\b",
    r"\bgrant(?:s|ed|ing)?\b",
    r"\bbond(?:s|ing)?\b",
]
ENACTED, WHEREAS = r"(?i)\bBE IT ENACTED BY THE LEGISLATURE\b", r"(?i)(?:^|\n)\s*WHEREAS\b"
# End of fixed values.


def normalized(text: Column | str) -> Column:
    """Lower case; all but a-z, 0-9, white space and hyphens to spaces; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def words(text: Column | str) -> Column:
    """Words of the normal form; none for an empty text."""
    return F.filter(F.split(normalized(text), " "), lambda w: w != "")


def keyword_tokens(text: Column | str) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) >= 4) & ~w.isin(BODY_STOPWORDS))


def title_tokens(title: Column | str) -> Column:
    """In order, with repeats."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " ")
    return F.filter(plain, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(TITLE_STOPWORDS))


def bigrams(tokens: Column) -> Column:
    """Distinct neighbours, joined by an underscore, in order."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.array_distinct(F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>")))


def tags(hay: Column, terms: dict[str, list[str]]) -> Column:
    """Names, sorted, of which a term stands in hay (a normal form), even inside a word."""
    found = lambda own: reduce(or_, (hay.contains(t) for t in own))
    hits = [F.when(found(own), name) for name, own in sorted(terms.items())]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def fiscal_direction(hay: Column) -> Column:
    """Of a normal form."""
    more = hay.contains("appropriat") | hay.rlike(EXPANSIONARY)
    less = hay.rlike(CONTRACTIONARY)
    return F.when(more & less, "mixed").when(more, "expansionary").when(less, "contractionary").otherwise("unknown")


def first_class(text: Column | str, patterns: dict[str, str], default: str = "other") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit(default)
    for name, p in reversed(patterns.items()):
        out = F.when(text.rlike(f"(?i){p}"), name).otherwise(out)
    return out


def section_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\bSec\.\s*\d+|\bSection\s+\d+"))


def line_count(text: Column | str) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""))


def preamble(text: Column, most: int = 8000) -> Column:
    """What stands before the enacting clause or the first WHEREAS, most characters at most."""
    places = [F.regexp_instr(text, F.lit(p)) for p in (ENACTED, WHEREAS)]
    first = F.least(*(F.when(p > 0, p) for p in places))
    head = F.substr(F.substr(text, F.lit(1), F.coalesce(first - 1, F.length(text)).cast("int")), F.lit(1), F.lit(most))
    return F.regexp_replace(head, r"^\s+|\s+$", "")


def body_tokens(text: Column, most: int, enacted: str = ENACTED, whereas: str = WHEREAS) -> Column:
    """Words of 4 to 24 letters from the enacting clause on, else from the first WHEREAS, else of the whole text, most characters at most; tags and entities left out."""
    # The only two letters beside A-Z whose lower case is in a-z; Java makes two characters of the first.
    text = F.translate(text, "\u0130\u212a", "ik")
    enacted, whereas = (F.regexp_instr(text, F.lit(p)) for p in (enacted, whereas))
    start = F.when(enacted > 0, enacted).when(whereas > 0, whereas).otherwise(1)
    body = F.lower(F.substr(text, start, F.lit(most)))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"&[a-z0-9#]+;", " "), r"[^a-z]+", " ")
    return F.filter(F.split(plain, " "), lambda w: F.length(w).between(4, 24))


def language_counts(text: Column) -> Column:
    """log1p of the counts of LANGUAGE_PATTERNS in lower case."""
    return F.array(*(F.log1p(F.regexp_count(F.lower(text), F.lit(p)).cast("double")) for p in LANGUAGE_PATTERNS))


#: Letters of the Latin blocks without their marks, by decomposition; worked out once from the Unicode tables that come with Python.
MARKED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFKD", c)[0].isascii() and unicodedata.normalize("NFKD", c) != c and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", c)[1:]))
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in MARKED)


def plain_ascii(text: Column) -> Column:
    """Lower case, Latin letters without their marks, combining marks dropped."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{M}+", ""), MARKED, PLAIN))


def person_key(name: Column) -> Column:
    """first|last of a name's parts in plain lower case."""
    parts = F.filter(F.split(F.regexp_replace(plain_ascii(name), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.get(parts, F.lit(0)), F.lit("|"), F.get(parts, F.size(parts) - 1)))


def surname_forms(name: Column) -> Column:
    """The last one, two and three parts of a name."""
    parts = F.filter(F.split(F.regexp_replace(plain_ascii(name), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(3))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), " "))


def trailing_number(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)$", 1), F.lit("")).try_cast("long")
