"""Similarity of feature sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the parts of the similarity, and floors by relationship.
WEIGHTS = {"policy": 0.24, "actions": 0.18, "entities": 0.10, "keywords": 0.20, "title": 0.16, "size": 0.12}
FLOORS = {"same-bill": 0.98, "official-companion": 0.98, "reintroduced": 0.94, "companion-text": 0.94, "identical-text": 0.90}


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def size_similarity(a: Column, b: Column) -> Column:
    """The smaller over the larger; 1 for two zeros, 0 for one."""
    return F.when((a == 0) & (b == 0), 1.0).when((a <= 0) | (b <= 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def weighted_similarity(a: str, b: str) -> Column:
    """Of structs a and b with the fields of WEIGHTS (size a number, the others arrays) and hash."""
    field = lambda s, f: F.col(f"{s}.{f}")
    parts = [w * (size_similarity if name == "size" else jaccard)(field(a, name), field(b, name)) for name, w in WEIGHTS.items()]
    return F.when(field(a, "hash") == field(b, "hash"), 1.0).otherwise(sum(parts[1:], parts[0]))


def relationship(a: str, b: str) -> Column:
    """From structs with bill, session, identifier, companion and hash; null where there is none."""
    f = lambda s, n: F.col(f"{s}.{n}")
    companions = (f(a, "companion") == f(b, "identifier")) | (f(b, "companion") == f(a, "identifier"))
    same_text = f(a, "hash") == f(b, "hash")
    return (
        F.when(f(a, "bill") == f(b, "bill"), "same-bill")
        .when((f(a, "session") == f(b, "session")) & F.coalesce(companions, F.lit(False)), "official-companion")
        .when(same_text & (f(a, "session") != f(b, "session")), "reintroduced")
        .when(same_text & (F.left(f(a, "identifier"), F.lit(2)) != F.left(f(b, "identifier"), F.lit(2))), "companion-text")
        .when(same_text, "identical-text")
    )


def floor_of(relation: Column) -> Column:
    out = F.lit(0.0)
    for name, value in FLOORS.items():
        out = F.when(relation == name, value).otherwise(out)
    return out


#: Parts of a design that count alike, and the share of the design beside the rest.
DESIGN_PARTS, DESIGN_SHARE = ("topic", "license_model", "mobile_allowed", "retail_allowed", "racetrack_role", "college_policy"), 0.3


def with_design(similarity: Column, a: Column, b: Column) -> Column:
    """similarity blended with the share of design parts that agree (nulls agree) where both bills, structs of policy.design, have a design; equal texts (similarity 1) stay 1."""
    agree = sum((a[p].eqNullSafe(b[p]).cast("int") for p in DESIGN_PARTS[1:]), a[DESIGN_PARTS[0]].eqNullSafe(b[DESIGN_PARTS[0]]).cast("int")) / len(DESIGN_PARTS)
    return F.when(a.isNull() | b.isNull() | (similarity == 1), similarity).otherwise((1 - DESIGN_SHARE) * similarity + DESIGN_SHARE * agree)
