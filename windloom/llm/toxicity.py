"""Toxicity: a weighted lexicon, learned from labelled rows, matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts and digits or signs used as letters to plain Latin letters.
Entries are whole words or beginnings of words. A word counts once, with its heaviest entry; matches inside
an exception phrase don't count. The summed weight is normalised by length through a logistic curve on the
log weight and log length, fitted on the same labelled rows. Null and empty texts have weight and length
zero and get the curve's value there, so every row has a score. Only texts enter a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import fold, map_batches, stored

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# Harmless phrases that hold an entry of common lexicons.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "no pun intended")

FOLD_LETTERS = {ord(k): v for k, v in HOMOGLYPHS.items()}
_MARKS = re.compile("[\u0300-\u036f\u200b-\u200d\u2060\ufeff]+")
FOLD_ASCII = {ord(k): v for k, v in SUBSTITUTES.items()}
_BREAK = re.compile(r"[\W_]+")

#: Prefix lengths that may become entries, beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows used for fitting, at most: toxic, other.
MAX_TOXIC, MAX_OTHER = 10_000, 20_000


def folded(text: str | None) -> str:
    """' w1 w2 ... ' of folded words (a lone space if there is none)."""
    if not text:
        return " "
    low = text.lower()
    if not low.isascii():  # accents and combining marks go, full-width signs become plain ones, before digits and look-alikes are folded
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low.translate(FOLD_LETTERS)))
    plain = _BREAK.sub(" ", low.translate(FOLD_ASCII)).strip()
    return f" {plain} " if plain else " "


@dataclass
class Lexicon:
    """Entries (' word ' or ' beginning') with weights, exception phrases and the curve's coefficients."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 3.0, -0.3)
    automaton: object = field(default=None, repr=False)

    def build(self):
        a = ahocorasick.Automaton()
        for entry, w in self.entries.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            a.add_word(p := folded(phrase), (len(p), None))
        if len(a):
            a.make_automaton()
        self.automaton = a
        return self

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Summed weight, matched words, words."""
        if self.automaton is None:
            self.build()
        plain = folded(text)
        n = plain.count(" ") - 1
        if n <= 0 or not len(self.automaton):
            return 0.0, 0, max(n, 0)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, w) in self.automaton.iter(plain):
            start = end - length + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()), len(best), n

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(weight) + c * math.log1p(words)))))


def features(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words}
    for k in PREFIXES:
        out.update(f" {w[:k]}" for w in words if len(w) > k)
    return out


def labelled(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> DataFrame:
    """A bounded set of labelled texts outside the held-out fold, the ids of least hash of either label."""
    ids = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 2)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).withColumn("o", F.xxhash64("doc_id"))
    chosen = ids.where("toxic = 1").orderBy("o", "doc_id").limit(max_toxic).union(ids.where("toxic <> 1").orderBy("o", "doc_id").limit(max_other))
    chosen = stored(chosen.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most max_toxic + max_other rows


def _entries(toxic: dict[str, tuple[int, int, int]], other: dict[str, tuple[int, int]], n1: tuple[int, int], n0: tuple[int, int], half: int | None, least: int, log_odds: float) -> dict[str, float]:
    """Weights from one half of the sample or (None) from all of it."""
    pick = (lambda x: x[-1]) if half is None else (lambda x: x[half])
    size = sum if half is None else (lambda n: n[half])
    out = {}
    for f, groups in toxic.items():
        seen = other.get(f, (0, 0))
        n = sum(seen) if half is None else seen[half]
        if pick(groups) >= least:
            w = math.log((pick(groups) + 0.5) / (size(n1) + 1)) - math.log((n + 0.5) / (size(n0) + 1))
            if w >= log_odds:
                out[f] = w
    return out


def learn(docs: DataFrame, labels: DataFrame, least: int = 5, log_odds: float = 2.0, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Lexicon:
    """Entries that toxic texts hold far more often than others, then the curve.

    Support is counted in different min-hashes of the texts' words, so that a group of copies counts about
    once. The curve is fitted on weights from the other half's entries, as on texts not seen before.
    """
    sample = stored(labelled(docs, labels, max_toxic, max_other).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")))
    spark = sample.sparkSession
    sizes = {(r["toxic"], r["half"]): r["count"] for r in sample.groupBy("toxic", "half").count().collect()}
    n1, n0 = (tuple(sizes.get((t, h), 0) for h in (0, 1)) for t in (1, 0))
    if not sum(n1):
        return Lexicon({})

    def make():
        def run(cols):
            out = {"feature": [], "key": [], "half": []}
            for text, half in zip(cols["text"], cols["half"]):
                words = set(folded(text).split())
                if words:
                    key = min(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"), 7) for w in words)
                    got = features(words)
                    out["feature"] += got
                    out["key"] += [key] * len(got)
                    out["half"] += [half] * len(got)
            return out

        return run

    seen = map_batches(sample.where("toxic = 1").select("text", "half"), make, "feature string, key long, half int")
    by_key = seen.groupBy("feature", "key").agg(F.max(F.when(F.col("half") == 0, 1).otherwise(0)).alias("h0"), F.max(F.when(F.col("half") == 1, 1).otherwise(0)).alias("h1"))
    fewer = max(3, least - 2)
    support = by_key.groupBy("feature").agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1"), F.count("*").alias("groups")).where((F.col("groups") >= least) | (F.greatest("h0", "h1") >= fewer))
    toxic = {r["feature"]: (r["h0"], r["h1"], r["groups"]) for r in support.collect()}  # bounded by the sample
    sent = spark.sparkContext.broadcast(frozenset(toxic))

    def make_other():
        wanted = sent.value

        def run(cols):
            counts: Counter = Counter()
            for text, half in zip(cols["text"], cols["half"]):
                counts.update((f, half) for f in features(set(folded(text).split())) & wanted)
            return {"feature": [f for f, _ in counts], "half": [h for _, h in counts], "n": list(counts.values())}

        return run

    told = map_batches(sample.where("toxic = 0").select("text", "half"), make_other, "feature string, half int, n long").groupBy("feature").agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)))
    other = {r["feature"]: (r["n0"], r["n1"]) for r in told.collect()}
    entries = _entries(toxic, other, n1, n0, None, least, log_odds)
    parts = [_entries(toxic, other, n1, n0, h, fewer, log_odds) for h in (0, 1)]
    return Lexicon(entries, curve=_curve(sample, parts))


def _curve(sample: DataFrame, parts: list[dict[str, float]]) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on log weight and log length, by Newton's method; each half is weighed by the other's entries."""
    rows = [r for h in (0, 1) for r in weighed(sample.where(F.col("half") == h), Lexicon(parts[1 - h]), ["toxic"]).select("weight", "n_words", "toxic").collect()]  # at most max_toxic + max_other rows of three numbers
    x = np.array([[1.0, math.log1p(r[0]), math.log1p(r[1])] for r in rows])
    y = np.array([r[2] for r in rows], dtype=float)
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(3), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def weighed(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The kept columns, weight, n_matches, n_words and score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions, lexicon.curve))

    def make():
        lex = Lexicon(*sent.value).build()

        def run(cols):
            got = [lex.weigh(t) for t in cols["text"]]
            return {c: cols[c] for c in keep} | {"weight": [g[0] for g in got], "n_matches": [g[1] for g in got], "n_words": [g[2] for g in got], "score": [lex.score(g[0], g[2]) for g in got]}

        return run

    kinds = dict(docs.dtypes)
    return map_batches(docs.select(*keep, "text"), make, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "weight double", "n_matches long", "n_words long", "score double"]))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from the threshold up); one row per row of docs."""
    return weighed(docs, lexicon, ["doc_id"]).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions, lexicon.curve))
    names = docs.columns

    def make():
        lex = Lexicon(*sent.value).build()

        def run(cols):
            keep = []
            for t in cols["text"]:
                w, _, n = lex.weigh(t)
                keep.append(lex.score(w, n) < threshold)
            return {n: [v for v, k in zip(cols[n], keep) if k] for n in names}

        return run

    return map_batches(docs, make, docs.schema)
