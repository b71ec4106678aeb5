"""Language of a text in two steps: its family first, then one-versus-one linear support vector machines inside the family."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import hash_sample
from tidemark.llm.tokens import WordTable, bare, grams, sum_by

# Families of closely related languages; one that is in none of them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "no", "sv", "is"),
    "romance": ("fr", "es", "pt", "it", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "sl", "cs", "sk", "pl"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "ur"),
}
BUCKETS = 4096
SIZES = range(1, 5)
SAMPLE_ROWS = 2400
UNKNOWN = "und"


@dataclass
class Machine:
    """A linear decision between two sides: above 0 is `yes`."""

    weights: np.ndarray
    bias: float
    yes: str
    no: str


@dataclass
class LanguageModel:
    """families: one machine per family against the rest; pairs: machines for each pair of languages of a family."""

    members: dict[str, list[str]]
    families: list[Machine]
    pairs: dict[str, list[Machine]]


def _profile(words: list[str]) -> np.ndarray:
    """Share of each n-gram bucket among the n-grams of the words."""
    _, found = grams(words, SIZES, BUCKETS)
    counts = np.bincount(found, minlength=BUCKETS).astype(np.float32)
    return counts / max(1.0, counts.sum())


def _support_vectors(x: np.ndarray, y: np.ndarray, yes: str, no: str, cost: float = 100.0, steps: int = 100) -> Machine:
    """Squared-hinge linear machine, both sides weighing the same, by accelerated gradient steps."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * np.float32(cost)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead, ahead_b = w.copy(), b
    steep, along = 1.0, np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        along = x.T @ (weight * (x @ along))
        steep = float(np.linalg.norm(along)) or 1.0
        along = along / steep
    step = 1.0 / (1.0 + 2.4 * (steep + cost))
    for k in range(steps):
        gap = np.maximum(0.0, 1.0 - y * (x @ ahead + ahead_b)) * weight * y
        new, new_b = ahead - step * (ahead - 2 * x.T @ gap), ahead_b + step * 2 * gap.sum()
        push = k / (k + 3)
        ahead, ahead_b, w, b = new + push * (new - w), new_b + push * (new_b - b), new, new_b
    return Machine(w, float(b), yes, no)


def fit(profiles: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """Machines from n-gram profiles and their languages."""
    home = {lang: family for family, all_of in families.items() for lang in all_of}
    members: dict[str, list[str]] = defaultdict(list)
    for lang in sorted(set(langs)):
        members[home.get(lang, lang)].append(lang)
    langs_at, family_at = np.array(langs, object), np.array([home.get(x, x) for x in langs], object)
    # Each bucket in units of its spread over the sample, so that rare n-grams count as well; folded back into the weights.
    scale = 1.0 / (profiles.std(axis=0) + 1e-5) / np.sqrt(profiles.shape[1]) if len(profiles) else np.ones(profiles.shape[1])
    x = (profiles * scale).astype(np.float32)

    def machine(rows: np.ndarray, yes: np.ndarray, names: tuple[str, str]) -> Machine:
        m = _support_vectors(x[rows], np.where(yes[rows], 1.0, -1.0), *names)
        m.weights = m.weights * scale
        return m

    every = np.ones(len(langs_at), bool)
    first = [machine(every, family_at == f, (f, "")) for f in members] if len(members) > 1 else []
    pairs = {}
    for family, inside in members.items():
        pairs[family] = [machine((langs_at == a) | (langs_at == b), langs_at == a, (a, b)) for a, b in combinations(inside, 2)]
    return LanguageModel(dict(members), first, pairs)


def decide(model: LanguageModel, margins: np.ndarray) -> tuple[str, float]:
    """(language, score) from one margin per machine, families first, then the pairs in their order."""
    names = list(model.members)
    if not names:
        return UNKNOWN, 0.0
    sure = lambda m: float(1.0 / (1.0 + np.exp(-2.0 * np.clip(m, -30, 30))))
    score, at = 1.0, len(model.families)
    family = names[0]
    if model.families:
        best = int(np.argmax(margins[:at]))
        family, score = names[best], sure(margins[best])
    for name in names:
        machines = model.pairs[name]
        if name == family:
            inside = model.members[name]
            votes, total = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
            for m, margin in zip(machines, margins[at : at + len(machines)], strict=True):
                votes[m.yes if margin > 0 else m.no] += 1
                total[m.yes] += margin
                total[m.no] -= margin
            lang = max(inside, key=lambda x: (votes[x], total[x]))
            return lang, score * (sure(total[lang] / max(1, len(inside) - 1)) if machines else 1.0)
        at += len(machines)
    raise AssertionError("a family without members")


def _scorer(model: LanguageModel):
    machines = [*model.families, *(m for f in model.members for m in model.pairs[f])]
    weights = np.stack([m.weights for m in machines], axis=1) if machines else np.zeros((BUCKETS, 0))
    bias = np.array([m.bias for m in machines])

    def worth(words: list[str]) -> np.ndarray:
        """Per word the sums over its n-grams for each machine, their number, and whether it has a letter."""
        cleaned = [bare(w) for w in words]
        owner, found = grams(cleaned, SIZES, BUCKETS)
        sums = sum_by(owner, weights[found], len(words))
        letters = [any(c.isalpha() for c in w) for w in words]
        return np.column_stack([sums, np.bincount(owner, minlength=len(words)), letters])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = WordTable(worth)
        for texts in batches:
            out = []
            for text in texts:
                words = text.split() if text else []
                total = table.rows[places].sum(axis=0) if len(places := table.places(words)) else None
                if total is None or not total[-1]:
                    out.append((UNKNOWN, 0.0))
                else:
                    out.append(decide(model, total[:-2] / total[-2] + bias))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return score


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether a row is kept out of learning, by its id; one without an id is not held out, but never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """A model from at most `rows` labelled documents (text, lang) that `docs` offers, as many of each language (one at least; of more
    languages than `rows`, those with the most ids).

    The sample is the documents with the smallest hashes of their ids, so it doesn't depend on partitioning. Whole texts
    are turned into profiles of fixed width inside tasks; only those reach the driver.
    """
    able = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = able.select("doc_id", "lang").distinct()  # hash_sample thins by ids, so ids count, not rows
    counts = dict(ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect())
    if not counts:
        return LanguageModel({}, [], {})
    chosen = hash_sample(able, "lang", dict.fromkeys(counts, max(1, rows // len(counts))), counts)
    texts = able.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_profile([bare(w) for w in t.split()]).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "profile": made})

    # Of rows that repeat an id and language, one counts.
    made = texts.mapInPandas(profiles, "doc_id long, lang string, profile binary")
    got = made.groupBy("doc_id", "lang").agg(F.min("profile").alias("profile")).collect()
    got = sorted(got, key=lambda r: (r["lang"], r["doc_id"], r["profile"]))
    return fit(np.stack([np.frombuffer(r["profile"], np.float32) for r in got]), [r["lang"] for r in got], families)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row: the language of the whole text; `und` with score 0 if the text is null, has
    no letter, or nothing was learned. Rows that repeat give repeated results; other columns are not read."""
    scorer = F.pandas_udf(_scorer(model), "lang_pred string, score double")
    found = docs.select("doc_id", scorer(F.col("text")).alias("found"))
    return found.select("doc_id", F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))


def identify(docs: DataFrame, parts: int = 4, which: int = 2, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows not held out, applied to all."""
    out = held_out(F.col("doc_id"), parts, which)
    model = learn(docs.select("doc_id", "text", "lang").filter(~out), rows)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
