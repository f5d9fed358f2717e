"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. For patterns of one length m, a table maps every block
of B consecutive words to the least distance from an occurrence of that block to a pattern's end; a block in
no pattern allows a jump of m - B + 1 words. Where the shift is zero, the bucket of that suffix block is
compared word by word, after a look at the pattern's first block. Windows of fewer than ``size`` words (short items) have
tables of their own length, so that they don't shorten the jumps of the rest.

Null and empty texts have no words and no hits; repeated items and windows count once per item_id. Windows of items
without an id hit words too; such items can't be listed and aren't counted. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import map_batches, stored

#: Words: runs of ASCII digits, lower-case letters and anything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Benchmark text sent to executors at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 32 << 20


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return WORD.findall(text.lower())
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class WuManber:
    """Patterns of one length: shift table, suffix buckets, first-block filter."""

    def __init__(self, patterns: dict[tuple[str, ...], int], length: int):
        self.m, self.b = length, min(2, length)
        self.jump = self.m - self.b + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple[tuple[str, ...], int]]]] = defaultdict(lambda: defaultdict(list))
        for p, ident in patterns.items():
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.jump), self.m - end)
            self.bucket[p[self.m - self.b :]][p[: self.b]].append((p, ident))

    def search(self, words: list[str]):
        """(start, pattern number) of every occurrence."""
        m, b, jump, n = self.m, self.b, self.jump, len(words)
        shift, i = self.shift.get, self.m
        while i <= n:
            block = (words[i - 2], words[i - 1]) if b == 2 else (words[i - 1],)
            s = shift(block, jump)
            if s:
                i += s
                continue
            start = i - m
            for p, ident in self.bucket[block].get(tuple(words[start : start + b]), ()):
                if tuple(words[start:i]) == p:
                    yield start, ident
            i += 1


class Matcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int = 10):
        by_length: dict[int, dict[tuple[str, ...], int]] = defaultdict(dict)
        self.owners: list[set[int]] = []
        for item, words in items:
            if not words:
                continue
            n = min(size, len(words))
            for i in range(len(words) - n + 1):
                p = tuple(words[i : i + n])
                ident = by_length[n].setdefault(p, len(self.owners))
                if ident == len(self.owners):
                    self.owners.append(set())
                self.owners[ident].add(item)
        self.tables = [WuManber(p, n) for n, p in sorted(by_length.items())]

    def hits(self, words: list[str]) -> tuple[list[list[int]], list[int]]:
        """Merged [start, end) intervals of hit words; the items with occurring windows."""
        found, items = [], set()
        for t in self.tables:
            for start, ident in t.search(words):
                found.append((start, start + t.m))
                items |= self.owners[ident]
        found.sort()
        merged: list[list[int]] = []
        for a, b in found:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return merged, sorted(i for i in items if i is not None)


def _blocks(benchmark: DataFrame, limit: int) -> int:
    """Into how many blocks of about that size the items are dealt."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // limit))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (merged hit intervals in words), items.

    A benchmark over ``block_bytes`` is dealt into blocks that are searched one after another, so that what
    each executor holds is bounded; their intervals are then united.
    """
    n = _blocks(benchmark, block_bytes)
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    keyed = docs.select("doc_id", "text")
    parts = None
    for k in range(n):
        chosen = source if n == 1 else source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        items = [(r.item_id, words_of(r.text)) for r in chosen.collect()]  # at most about block_bytes of text
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def make(sent=sent):
            matcher = Matcher(sent.value, size)

            def run(cols):
                out = {"doc_id": cols["doc_id"], "n_words": [], "spans": [], "items": []}
                for text in cols["text"]:
                    words = words_of(text)
                    spans, found = matcher.hits(words)
                    out["n_words"].append(len(words))
                    out["spans"].append(spans)
                    out["items"].append(found)
                return out

            return run

        if n == 1:
            return map_batches(keyed, make, "doc_id long, n_words long, spans array<array<long>>, items array<long>")

        def make_keyed(make=make):
            inner = make()

            def run(cols):
                return inner(cols) | {"h": cols["h"]}

            return run

        # Equal (id, text) rows give equal hits: they are counted, searched once per block, and put back.
        one = map_batches(keyed.withColumn("h", F.xxhash64("doc_id", "text")), make_keyed, "doc_id long, h long, n_words long, spans array<array<long>>, items array<long>").withColumn("block", F.lit(k))
        one = stored(one)
        sent.unpersist()  # so that one block at a time is held
        parts = one if parts is None else parts.union(one)
    per_block = parts.groupBy("doc_id", "h", "n_words", "block").agg(F.count("*").alias("copies"), F.first("spans").alias("spans"), F.first("items").alias("items"))
    rows = per_block.groupBy("doc_id", "h", "n_words").agg(
        F.first("copies").alias("copies"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merged = F.aggregate(
        "spans", F.array().cast("array<array<long>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s[0] <= F.element_at(F.element_at(acc, -1), -1)),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(F.element_at(acc, -1), -1), s[1]))))).otherwise(F.concat(acc, F.array(s))),
    )
    return rows.select("doc_id", "n_words", merged.alias("spans"), "items", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).drop("one")


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of docs."""
    got = contamination(docs, benchmark, size, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs; all columns stay."""
    names = docs.columns
    n = _blocks(benchmark, block_bytes)
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    kept = docs
    for k in range(n):
        chosen = source if n == 1 else source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, words_of(r.text)) for r in chosen.collect()])

        def make(sent=sent):
            matcher = Matcher(sent.value, size)

            def run(cols):
                keep = [not any(True for t in matcher.tables for _ in t.search(w)) for w in map(words_of, cols["text"])]
                return {n: [v for v, k in zip(cols[n], keep) if k] for n in names}

            return run

        kept = map_batches(kept, make, kept.schema)
        if n > 1:
            kept = stored(kept)
            sent.unpersist()
    return kept


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
