"""What evidence may be used for, and what is wrong with proofs of when it was public, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256 = r"^[a-f0-9]{64}$"
#: Kinds of finance records, of which the last is known by its spender, and what proves a website's text.
FINANCE = ("candidate_contribution_record", "candidate_expenditure_record", "independent_expenditure_record")
EXTRACTION, INDEX_PROOF, ARCHIVE_PROOF = "senate-864-literal-website-observed-asof-v1", "original_site_html_cdx_index_in_existing_research", "archived_original_html_plus_cdx_research_ledger"


def instant(text: Column) -> Column:
    """A timestamp; null if text is none."""
    return F.try_to_timestamp(text)


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def like(text: Column, pattern: str) -> Column:
    return yes(text.rlike(pattern))


def availability_errors(row: Column) -> Column:
    """Reasons why a proof of availability doesn't hold, in order; an empty array if it does.

    row: a struct of texts proof, available_at, canonical_url, archive_url, captured_at, published_at, filing_at and content_sha256.  An empty text counts as missing.
    """
    f = {n: F.nullif(row[n], F.lit("")) for n in ("proof", "available_at", "canonical_url", "archive_url", "captured_at", "published_at", "filing_at", "content_sha256")}
    available = instant(f["available_at"])

    def clock(proof: Column, field: str, name: str, missing: str, wrong: Column, what: str) -> Column:
        """The one thing that is wrong with a clock that a proof needs."""
        at = instant(f[field])
        return F.when(yes(proof), F.when(f[field].isNull(), missing).when(at.isNull(), f"{name} must be a valid timestamp").when(yes(wrong), what))

    captured, published, filing = (instant(f[n]) for n in ("captured_at", "published_at", "filing_at"))
    archive, official, page, filed = (f["proof"] == p for p in ("independent_archive_capture", "official_publication_timestamp", "publisher_page_metadata", "regulatory_filing_or_disclosure_timestamp"))
    errors = [
        F.when(~like(f["canonical_url"], r"(?i)^https://"), "canonicalUrl must be https"),
        F.when(~like(f["content_sha256"], "(?i)" + SHA256), "contentSha256 must be sha256"),
        F.when(available.isNull(), "availableAt must be a valid timestamp"),
        F.when(yes(archive) & ~like(f["archive_url"], r"(?i)^https://"), "archive capture requires https archiveUrl"),
        clock(archive, "captured_at", "capturedAt", "archive capture requires capturedAt", captured != available, "archive availableAt must equal capturedAt"),
        clock(official, "published_at", "publishedAt", "official publication requires publishedAt", available < published, "official publication availableAt cannot precede publishedAt"),
        clock(page, "published_at", "publishedAt", "publisher metadata requires publishedAt", available < published, "publisher metadata availableAt cannot precede publishedAt"),
        clock(filed, "filing_at", "filingAt", "regulatory disclosure requires filingAt", available < filing, "regulatory availableAt cannot precede filingAt"),
    ]
    return F.filter(F.array(*errors), lambda x: x.isNotNull())


def available_before(row: Column, cutoff: Column) -> Column:
    return (F.size(availability_errors(row)) == 0) & yes(instant(row["available_at"]) < cutoff)


def evidence_use(row: Column, cutoff: Column) -> Column:
    """A struct of allowed_use, available_at and reason (null where a use is allowed), fail closed: identity of the source first, then what its kind must prove, then when it was seen.

    row: a struct of texts source_hash, subtype, filer, spender, row_key, year, available_on (a day, if it is certified), extraction, excerpt, index_proof, archive_proof, observed_at, captured_at, published_at,
    cdx_sha1 and fetched_at, and booleans website, actionable and eligible.  cutoff: a timestamp; a day counts only if it is before the cutoff's.
    """
    filer = F.when(row["subtype"] == FINANCE[2], row["spender"]).otherwise(row["filer"])
    finance = yes(row["subtype"].isin(*FINANCE))
    identified = like(filer, r"^[0-9]{3,8}$") & like(row["row_key"], SHA256) & like(row["year"], r"^20\d\d$")
    day = F.to_date(F.try_to_timestamp(row["available_on"]))
    observed = instant(row["observed_at"])
    literal = (
        yes(row["extraction"] == EXTRACTION) & yes(row["excerpt"] != "") & yes(~row["actionable"]) & yes(row["eligible"]) & yes(row["index_proof"] == INDEX_PROOF) & yes(row["archive_proof"] == ARCHIVE_PROOF)
        & yes(row["captured_at"] == row["observed_at"]) & yes(instant(row["published_at"]) == observed) & like(row["cdx_sha1"], r"^[A-Z2-7]{32}$") & yes(observed < cutoff)
    )

    def told(use: str, at: Column | None, reason: str | None) -> Column:
        return F.struct(F.lit(use).alias("allowed_use"), (F.lit(None).cast("string") if at is None else at).alias("available_at"), F.lit(reason).cast("string").alias("reason"))

    return (
        F.when(~like(row["source_hash"], SHA256), told("context", None, "INVALID_SOURCE_IDENTITY"))
        .when(finance & ~identified, told("context", None, "MISSING_CANONICAL_TRANSACTION_IDENTITY"))
        .when(finance & yes(day < F.to_date(cutoff)), told("historical_finance_research", day.cast("string"), None))
        .when(finance, told("context", None, "FINANCE_EXACT_ROW_PUBLICATION_UNPROVED"))
        .when(yes(row["website"]) & literal, told("website_text_research", row["observed_at"], None))
        .when(yes(row["website"]), told("context", None, "WEBSITE_LITERAL_SOURCE_OR_CLOCK_HOLD"))
        .when(yes(instant(row["fetched_at"]) < cutoff), told("context", row["fetched_at"], "CONTEXT_ONLY_NO_DIRECTIONAL_ADMISSION"))
        .otherwise(told("context", None, "OBSERVED_AFTER_CUTOFF"))
    )
