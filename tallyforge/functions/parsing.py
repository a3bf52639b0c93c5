"""Columns that take structure out of text: tagged blocks, journals, minutes, feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(tag: str) -> str:
    return rf"(?is)<(?:[\w.-]+:)?{tag}\b[^>]*>(.*?)</(?:[\w.-]+:)?{tag}>"


def blocks(text: Column, tag: str) -> Column:
    """What stands inside each element of a name, with or without a namespace prefix."""
    return F.regexp_extract_all(text, F.lit(element(tag)), F.lit(1))


def unescaped(text: Column) -> Column:
    """CDATA taken out, entities resolved, tags dropped, white space squeezed."""
    out = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tag(block: Column, name: str) -> Column:
    """The first element of a name; null where there is none or it is empty.

    An array of one binds what was found, which is so looked for once and taken apart only if it holds anything to resolve.
    """
    plain = F.transform(F.array(F.regexp_extract(block, element(name), 1)), lambda x: F.when(x.rlike(r"[<&\s]"), unescaped(x)).otherwise(x))
    return F.get(F.filter(plain, lambda x: x != ""), F.lit(0))


def https(url: Column) -> Column:
    """An absolute address with https; null if it is none."""
    return F.when(url.rlike(r"^https?://\S+$"), F.regexp_replace(url, "^http:", "https:"))


#: Words of actions that say how a bill fared.
FAILED = r"\bbill was not passed\b|\bthird reading (?:failed|not passed)\b|\bfailed (?:final )?passage\b|\bfailed to pass\b"
PASSED = r"\bbill was (?:re)?passed\b|\bthird reading (?:was )?(?:passed|repassed)\b|\b(?:house|senate) concurred and repassed bill\b"
DENIED = r"\b(?:not|never) passed\b"


def passage(description: Column) -> Column:
    """Whether the words of an action say that a bill passed (true), failed (false) or neither (null)."""
    text = F.lower(description)
    return F.when(text.rlike(FAILED), False).when(~text.rlike(DENIED) & text.rlike(PASSED), True)


def bill_numbers(text: Column) -> Column:
    """Identifiers such as HF12, whatever dots and blanks they were written with."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b[HS]\.?\s*F\.?\s*(?:No\.?\s*)?\d+"), F.lit(0))
    return F.transform(found, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lit("F"), F.regexp_extract(x, r"0*(\d+)$", 1)))


def containing(value: Column, wanted: dict[str, str]) -> Column:
    """Whether a JSON object holds all the given text fields (containment of a flat object)."""
    held = F.lit(True)
    for name, text in wanted.items():
        held = held & F.get_json_object(value, f"$.{name}").eqNullSafe(F.lit(text))
    return held


def all_keys(value: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")))) == 0


def json_list(value: Column, schema: str) -> Column:
    """The rows of a JSON array; none if it is of another type."""
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, f"array<{schema}>")).otherwise(F.array().cast(f"array<{schema}>"))
