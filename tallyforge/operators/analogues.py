"""The best earlier analogues of stated targets among all candidates, exactly: blocks of candidates meet groups of targets, both of bounded size, and each is compared whole in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import FLOORS, WEIGHTS

#: Candidates in a block, and targets in a group.
BLOCK_ROWS, GROUP_ROWS = 4096, 1024
#: Scores in a block are sorted out with so much to spare, since Spark's powers may end in other digits than numpy's.
SPARE = 1e-6
RELATIONS = list(FLOORS)
FIELDS = ["bill", "session", "identifier", "companion", "day", "hash", "policy", "actions", "entities", "keywords", "title", "size"]


def compact(f: str, terms: dict[str, list[str]]) -> Column:
    """A bill's struct with tags as bits and words as one text; size -1 where it is null."""
    bits = lambda name: sum((F.when(F.array_contains(F.col(f"{f}.{name}"), t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(terms[name])), F.lit(0).cast("long"))
    made = {n: bits(n) for n in terms} | {n: F.coalesce(F.array_join(f"{f}.{n}", " "), F.lit("")) for n in ("keywords", "title")} | {"bill": F.col(f"{f}.bill").cast("long"), "size": F.coalesce(F.col(f"{f}.size").cast("long"), F.lit(-1))}
    return F.struct(*(made.get(n, F.col(f"{f}.{n}")).alias(n) for n in FIELDS))


def coded(values: list) -> tuple[np.ndarray, dict]:
    """A number for each distinct value, and the values' own; -1 for null."""
    own: dict = {}
    return np.array([-1 if v is None else own.setdefault(v, len(own)) for v in values], np.int64), own


class Words:
    """For each word the rows that hold it; a row holds a word once."""

    def __init__(self, texts: list[str]):
        each = [t.split() for t in texts]
        self.size = np.array([len(w) for w in each], np.int64)
        codes, self.own = coded([w for own in each for w in own])
        self.rows = np.repeat(np.arange(len(each)), self.size)[np.argsort(codes, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.own)))])

    def jaccard(self, text: str, upto: int) -> np.ndarray:
        """With the first rows; 1 for two empty sets."""
        words = text.split()
        met = [self.own[w] for w in words if w in self.own]
        shared = np.bincount(np.concatenate([self.rows[self.ends[i] : self.ends[i + 1]] for i in met]), minlength=len(self.size))[:upto] if met else np.zeros(upto, np.int64)
        return ratio(shared, self.size[:upto] + len(words) - shared)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; 1 where b is 0."""
    return np.divide(a, b, out=np.ones(len(a)), where=b > 0)


class Candidates:
    """A block of bills in order of day."""

    def __init__(self, fields: dict[str, np.ndarray]):
        by = np.argsort(np.asarray(fields["day"], np.int64), kind="stable")
        got = {n: np.asarray(v)[by] for n, v in fields.items()}
        self.bill, self.day, self.size = (got[n].astype(np.int64) for n in ("bill", "day", "size"))
        self.tags = {n: got[n].astype(np.int64) for n in ("policy", "actions", "entities")}
        self.words = {n: Words(list(got[n])) for n in ("keywords", "title")}
        self.session, self.sessions = coded(list(got["session"]))
        self.hash, self.hashes = coded(list(got["hash"]))
        self.identifier, self.identifiers = coded(list(got["identifier"]))
        self.companion, self.companions = coded(list(got["companion"]))
        self.chamber = [None if v is None else v[:2] for v in got["identifier"]]

    def relation(self, t: dict, upto: int) -> np.ndarray:
        """Places in RELATIONS of the first rows' relations to t; -1 for none."""
        out = np.full(upto, -1)
        session, text = self.sessions.get(t["session"], -2), self.hashes.get(t["hash"], -2)
        for i in np.flatnonzero(self.hash[:upto] == text):
            if t["session"] is not None and self.session[i] not in (-1, session):
                out[i] = RELATIONS.index("reintroduced")
            elif None not in (self.chamber[i], t["identifier"]) and self.chamber[i] != t["identifier"][:2]:
                out[i] = RELATIONS.index("companion-text")
            else:
                out[i] = RELATIONS.index("identical-text")
        same = (self.identifier[:upto] == self.identifiers.get(t["companion"], -2)) | (self.companion[:upto] == self.companions.get(t["identifier"], -2))
        out[same & (self.session[:upto] == session)] = RELATIONS.index("official-companion")
        return out

    def similarity(self, t: dict, upto: int) -> np.ndarray:
        """As weighted_similarity, the sum in the same order."""
        size = np.maximum(self.size[:upto], 0)
        parts = {n: ratio(np.bitwise_count(v[:upto] & t[n]).astype(np.int64), np.bitwise_count(v[:upto] | t[n])) for n, v in self.tags.items()} | {n: w.jaccard(t[n], upto) for n, w in self.words.items()}
        parts["size"] = ratio(np.minimum(size, t["size"]), np.maximum(size, t["size"]))
        out = np.zeros(upto)
        for name, weight in WEIGHTS.items():
            out = out + weight * parts[name]
        out[(self.size[:upto] < 0) | (t["size"] < 0)] = np.nan
        out[self.hash[:upto] == self.hashes.get(t["hash"], -2)] = 1.0
        return out

    def best(self, t: dict, most: int, least: float, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, relations and similarities of the earlier bills that may be among t's best."""
        upto = int(np.searchsorted(self.day, t["day"]))
        if not upto:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        relation, similarity = self.relation(t, upto), self.similarity(t, upto)
        rows = np.flatnonzero(((relation >= 0) | (similarity >= least)) & (self.bill[:upto] != t["bill"]))
        floors = np.array([*FLOORS.values(), 0.0])
        score = np.fmax(similarity[rows], floors[relation[rows]]) * (0.75 + 0.25 * 2.0 ** (-(t["day"] - self.day[rows]) / half))
        if len(rows) > most:
            rows = rows[score >= np.partition(score, -most)[-most] - SPARE]
        return rows, relation[rows], similarity[rows]


def analogue_pairs(targets: DataFrame, candidates: DataFrame, most: int, least: float, half: float, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """target, target_day, candidate, day, relation and similarity: a superset of each target's `most` best analogues of earlier days that are related or similar by `least`.  Both hold a struct f by compact.

    Every group of targets meets every block of candidates by an equality join on the block; of a block only what may be among the best stays.
    """
    blocks, groups = max(1, -(-candidates.count() // block_rows)), max(1, -(-targets.count() // group_rows))

    def gathered(rows: DataFrame, key: Column, name: str, lead: str) -> DataFrame:
        g = rows.groupBy(key.cast("int").alias(name)).agg(F.collect_list("f").alias("rows"))
        return g.select(name, *(F.col(f"rows.{n}").alias(lead + n) for n in FIELDS))

    dealt = gathered(candidates, F.pmod(F.xxhash64("f.bill"), F.lit(blocks)), "block", "c_")
    grouped = gathered(targets, F.pmod(F.xxhash64("f.bill", F.lit(1)), F.lit(groups)), "group", "t_").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                block = Candidates({n: getattr(r, f"c_{n}") for n in FIELDS})
                for values in zip(*(getattr(r, f"t_{n}") for n in FIELDS), strict=True):
                    t = dict(zip(FIELDS, values, strict=True))
                    rows, relation, similarity = block.best(t, most, least, half)
                    if len(rows):
                        yield pd.DataFrame({"target": t["bill"], "target_day": t["day"], "candidate": block.bill[rows], "day": block.day[rows], "relation": [RELATIONS[i] if i >= 0 else None for i in relation], "similarity": similarity})

    return grouped.join(dealt, "block").mapInPandas(run, "target long, target_day int, candidate long, day int, relation string, similarity double")
