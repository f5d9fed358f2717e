"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of the letter. A trigram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a document bundles (adds) its
trigrams' vectors; a language's prototype bundles the unit vectors of its documents. A text gets the language
whose prototype, less the mean of all prototypes, has the greatest cosine with it; ties go to the first in
alphabetical order. Texts without a letter (null, empty) are 'und' with score 0.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import held_out, map_batches

#: Dimensions of all vectors.
DIM = 512
#: Trigram vectors that a task keeps; those beyond are made each time.
KEPT = 16_384
_NOT_LETTERS = re.compile(r"[\W\d_]+")


class Encoder:
    """Letters' and trigrams' vectors; the first KEPT trigrams that a task meets are kept in a table."""

    def __init__(self, dim: int = DIM, kept: int = KEPT):
        self.dim, self.kept = dim, kept
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((kept, dim), dtype=np.float32)

    def letter(self, c: int) -> np.ndarray:
        got = self.letters.get(c)
        if got is None:
            raw = b"".join(xxhash.xxh64_digest(chr(c).encode("utf-8", "surrogatepass"), seed) for seed in range(self.dim // 64))
            got = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.float32) * 2 - 1
            if len(self.letters) < 4096:
                self.letters[c] = got
        return got

    def bind(self, g: int) -> np.ndarray:
        """A trigram's vector: its letters' (21 bits each), rotated by their places and multiplied."""
        return np.roll(self.letter(g >> 42), 2) * np.roll(self.letter((g >> 21) & 0x1FFFFF), 1) * self.letter(g & 0x1FFFFF)

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Trigrams of letters (spaces between words) and their counts; None without a letter."""
        plain = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
        if not plain:
            return None
        codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        grams.sort()
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[first], np.diff(first, append=len(grams)).astype(np.float32)

    def add(self, grams: np.ndarray, counts: np.ndarray, known: np.ndarray, rest: np.ndarray) -> None:
        """Bundle: weights of the table's rows go to ``known``, other trigrams' vectors to ``rest``."""
        rows = self.rows
        at = [rows.get(g, -1) for g in grams.tolist()]
        if -1 in at:
            for k, (g, r) in enumerate(zip(grams.tolist(), at)):
                if r < 0:
                    if len(rows) < self.kept:
                        at[k] = rows[g] = len(rows)
                        self.table[at[k]] = self.bind(g)
                    else:
                        rest += counts[k] * self.bind(g)
            at, counts = np.array(at), counts.copy()
            counts, at = counts[at >= 0], at[at >= 0]
        np.add.at(known, at, counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' unit vectors (zero without a letter), and which have a letter."""
        out, has = np.zeros((len(texts), self.dim), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        known = np.zeros(self.kept, dtype=np.float32)
        for i, text in enumerate(texts):
            got = self.grams(text)
            if got is not None:
                has[i] = True
                self.add(*got, known, out[i])
                used = np.flatnonzero(known)
                out[i] += known[used] @ self.table[used]
                known[used] = 0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), has


def prototypes(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Learned from every row with a language outside the held-out fold, each text with weight one.

    Bundling is linear: a task adds up the trigrams' weights of a language and sends one vector for it.
    """

    def run(batches):
        import pyarrow as pa

        enc, known, rest = Encoder(dim), {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = enc.grams(text)
                if got is not None:
                    if lang not in known:
                        known[lang], rest[lang] = np.zeros(enc.kept, dtype=np.float32), np.zeros(dim, dtype=np.float32)
                    enc.add(got[0], got[1] / got[1].sum(), known[lang], rest[lang])
        sums = [(rest[k] + known[k][: len(enc.rows)] @ enc.table[: len(enc.rows)]).tolist() for k in known]
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(known), pa.string()), "v": pa.array(sums, pa.list_(pa.float32()))})

    parts = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text").mapInArrow(run, "lang string, v array<float>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # languages x dim numbers
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array([e["x"] for e in r["v"]])
        out[r["lang"]] = v / (np.linalg.norm(v) or 1.0)
    return out


def identify(docs: DataFrame, learned: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: half of one plus the cosine); one row per row of docs."""
    names = list(learned)
    p = np.array([learned[k] for k in names]) if names else np.zeros((0, dim))
    if len(names) > 1:
        p = p - p.mean(axis=0)
    p = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)).astype(np.float32) if names else p

    def make():
        enc = Encoder(dim)

        def run(cols):
            if not names:
                return {"doc_id": cols["doc_id"], "lang_pred": ["und"] * len(cols["text"]), "score": [0.0] * len(cols["text"])}
            v, has = enc.encode(cols["text"])
            cos = v @ p.T
            best = cos.argmax(axis=1)
            top = np.clip((1 + cos[np.arange(len(cos)), best].astype(float)) / 2, 0, 1)
            return {"doc_id": cols["doc_id"], "lang_pred": [names[k] if h else "und" for k, h in zip(best, has)], "score": np.where(has, top, 0.0).tolist()}

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double")
