"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance at most 2r have a common point within r of both. Every fingerprint
therefore emits all its variants within r, and fingerprints meeting at a variant are linked. The variants
are shuffled in factored form: a variant is (top bits, low bits), a fingerprint is sent once to every block
of top bits that its ball reaches, and the block writes out the low-bit variants itself and sorts them. No
pair of a bucket is ever expanded: each variant links its owners in a star, each block keeps a spanning
forest, and the forests are joined by the driver where they are small, else by large-star / small-star rounds.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a component.
Rows without an id take part; a component whose rows all lack ids has a null component_id.

``near_duplicates`` links short fingerprints at few bits. ``alike_classes`` is for a similarity of shingle sets: at
0.8 two texts differ in 15 of 100 bits, more than one ball can span, so a fingerprint of 256 bits is cut into eight
keys of 32 bits with a ball each. Texts that meet under a key, differ in few enough of all bits and have sets of fitting
size are compared by their whole shingle sets, and linked if the Jaccard similarity is 0.8 or more. Sets of at most
nine shingles, too small for an estimate, meet by what is left when one shingle is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import map_batches, stored

#: Variants that a block holds at once; beyond it the block splits on its next bit.
VARIANTS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> bytes:
    """Eight big-endian bytes: bit set if set in over half of the shingles' XXH64."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return bytes(8)
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    if len(tokens) <= words:
        return digest(joined, seed)
    hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(ends, ends[words:])])
    total, n = np.zeros(64, dtype=np.int64), len(hashes) // 8
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    for i in range(0, n, 1 << 14):  # bounded memory for very long texts
        total += np.unpackbits(rows[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (signed 64-bit form of the fingerprint)."""

    def make():
        def run(cols):
            return {"doc_id": cols["doc_id"], "fp": [int.from_bytes(fingerprint(t, words), "big", signed=True) for t in cols["text"]]}

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For each budget 0..most: all masks of the lowest ``bits`` bits with at most so many set."""
    one = [1 << b for b in range(bits)]
    out, so_far = [], [0]
    for k in range(most + 1):
        if k:
            so_far = so_far + [sum(c) for c in combinations(one, k)]
        out.append(np.array(so_far, dtype=np.uint64))
    return out


def _stars(fps: np.ndarray, most: int, place: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every owner of a variant linked to its first owner; place: the variant of each owner in own."""
    first = np.full(int(place.max()) + 1, len(fps), dtype=np.int64)
    np.minimum.at(first, place, own)
    a, b = first[place], own
    pairs = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
    near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * most  # the exact check
    return pairs[near, 0], pairs[near, 1]


def _meet(fps: np.ndarray, budget: np.ndarray, bits: int, most: int, limit: int, join=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (indices into fps) of fingerprints whose variants in the lowest ``bits`` bits meet.

    budget: flips left for each. All variants here share the bits above. join(index, place, own) says which owners
    of a variant are linked (index: the fingerprints' places in the outermost call); by default all, in stars.
    """
    masks = _masks(bits, most)
    total = sum(int((budget == k).sum()) * len(masks[k]) for k in range(most + 1))
    if total > limit and bits > 8:
        out, top = [], np.uint64(1) << np.uint64(bits - 1)
        index = np.arange(len(fps))
        for bit in (np.uint64(0), top):
            left = budget - ((fps & top) != bit)
            keep = left >= 0
            inner = None if join is None else (lambda i, place, own, kept=index[keep]: join(kept[i], place, own))
            for a, b in _meet(fps[keep], left[keep], bits - 1, most, limit, inner):
                out.append((index[keep][a], index[keep][b]))
        return out
    low = fps & np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for k in range(most + 1):
        at = np.flatnonzero(budget == k)
        variants.append((low[at, None] ^ masks[k][None, :]).ravel())
        owners.append(np.repeat(at, len(masks[k])))
    v = np.concatenate(variants)
    ordered = np.sort(v)
    met = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(met):
        return []
    met = np.unique(met)
    place = np.minimum(np.searchsorted(met, v), len(met) - 1)
    hit = np.flatnonzero(met[place] == v)
    place, own = place[hit], np.concatenate(owners)[hit]
    return [_stars(fps, most, place, own) if join is None else join(np.arange(len(fps)), place, own)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Fingerprints that a block of top bits is meant to hold; more top bits are taken for more fingerprints.
BLOCK_ROWS = 1 << 19


def _prefix(n: int, half: int, bits: int, least: int) -> int:
    """Top bits of which a block's share of n fingerprints is at most BLOCK_ROWS (of all but 8 bits at most)."""
    for p in range(least, bits - 8, 2):
        if n * len(_masks(p, half)[half]) <= BLOCK_ROWS << p:
            return p
    return bits - 8


def links(fps: DataFrame, radius: int = 4, partitions: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Forest edges (a, b) that connect all distinct fingerprints ``fp`` linked at ``radius`` or less."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is each fingerprint's ball")
    half, spark = radius // 2, fps.sparkSession
    n = fps.count() if n_rows is None else n_rows
    prefix = _prefix(n, half, 64, 8)
    masks = [int(m) for m in _masks(prefix, half)[half]]
    top = F.shiftrightunsigned("fp", 64 - prefix)
    sent = fps.select("fp", F.explode(F.array(*[top.bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("block"))
    partitions = partitions or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy().view(np.uint64))
        head = np.uint64(pdf["block"].iloc[0])
        left = half - np.bitwise_count((fp >> np.uint64(64 - prefix)) ^ head).astype(np.int64)
        edges = _meet(fp, left, 64 - prefix, half, VARIANTS_AT_ONCE)
        if not edges:
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        a, b = (np.concatenate(x) for x in zip(*edges))
        root = roots(len(fp), a, b)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    return sent.repartition(partitions, "block").groupBy("block").applyInPandas(block, "a long, b long").distinct()


#: Edges (16 bytes each) whose components the driver finds itself; more go through rounds of joins.
EDGES_AT_ONCE = 1 << 18


def _components_here(edges: DataFrame) -> DataFrame:
    """What components() gives, found in the driver: no round of joins, each of which leaves a file for every task."""
    got = edges.toArrow()
    ends = np.stack([got["a"].to_numpy(), got["b"].to_numpy()], axis=1).astype(np.int64)
    names, flat = np.unique(ends, return_inverse=True)
    flat = flat.reshape(-1, 2)
    root = roots(len(names), flat[:, 0], flat[:, 1])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return edges.sparkSession.createDataFrame(pa.table({"node": names[moved], "root": names[root[moved]]}), "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of an edge that isn't a root; beyond EDGES_AT_ONCE large-star / small-star rounds."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if e.count() <= EDGES_AT_ONCE:
        return _components_here(e)
    last = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = tuple(now)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = large.join(low, "a").where("b <> lo").select(F.col("b").alias("a"), F.col("lo").alias("b"))
        e = stored(small.union(low.select("a", F.col("lo").alias("b"))).distinct())


#: A key with more than one of so many rows is joined by broadcast; there are fewer such keys than this.
HOT_SHARE = 1000


def joined(rows: DataFrame, by_key: DataFrame, key: list[str], hot) -> DataFrame:
    """Inner join of rows (stored) with by_key (stored, one row a key), which has the flag ``hot`` for at most HOT_SHARE keys.

    Hot keys are broadcast, so that no task gets a hot key's rows; the others are shuffled.
    """
    by_key = by_key.withColumn("__hot", F.coalesce(hot, F.lit(False)))
    top, values = by_key.where("__hot"), [c for c in by_key.columns if c not in (*key, "__hot")]
    if not top.limit(1).count():
        return rows.join(by_key.drop("__hot"), key)
    met = rows.join(F.broadcast(top), key, "left")
    rest = met.where("__hot is null").drop(*values, "__hot").join(by_key.where("not __hot").drop("__hot"), key)
    return met.where("__hot").drop("__hot").unionByName(rest)


def named_by_least(nodes: DataFrame, tree: DataFrame, value: list[str]) -> DataFrame:
    """nodes with least: the smallest struct of the columns ``value`` in each one's component; null in the first column is the largest."""
    nodes = nodes.withColumn("least", F.struct(*value))
    inside = stored(nodes.join(tree.union(tree.select("root", "root").distinct()), "node"))
    order = F.struct(F.col(value[0]).isNull().alias("no"), F.col("least").alias("v"))
    least = stored(inside.groupBy("root").agg(F.min(order).alias("m"), F.count("*").alias("members")).select("root", F.col("m.v").alias("least"), "members"))
    told = joined(inside.drop("least"), least, ["root"], F.col("members") * HOT_SHARE > inside.count()).drop("root", "members")
    alone = nodes.join(inside.select("node"), "node", "left_anti")
    return stored(told.unionByName(alone))


def classes(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for each row of docs(doc_id, text)."""
    fps = stored(fingerprints(docs, words))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    tree = components(links(distinct.select("fp"), radius))
    named = named_by_least(distinct.select(F.col("fp").alias("node"), "first_id", "copies"), tree, ["first_id"])
    named = named.select(F.col("node").alias("fp"), F.col("least.first_id").alias("component_id"), "copies")
    return joined(fps, named, ["fp"], F.col("copies") * HOT_SHARE > fps.count()).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id; one row per row of docs."""
    got = classes(docs, words, radius)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A wide fingerprint is 256 bits, four longs; each half of a long is a key with a ball of radius 2.
WIDE, KEY_BITS, KEY_RADIUS = 256, 32, 4
#: Differing bits up to which texts that met are compared. Shingle sets of similarity 0.8 have a cosine of 2 * 0.8 / 1.8,
#: an angle of 0.151 half turns: 39 differing bits expected, with a standard deviation of 5.7; more than 58 have a
#: probability of 0.001. One key in eight differs in at most 4 bits with a probability of 0.99 or more (0.98 at 12 shingles).
WIDE_RADIUS = 58
#: Jaccard similarity of shingle sets from which texts are near copies.
SIMILAR = 0.8
#: Sets of so many shingles meet by deletions: at 0.8 one of two such sets is the other without one shingle.
#: Pairs with a union of more need eight shingles on both sides, and all such sets have a wide fingerprint.
FEW_SHINGLES, SKETCHED_FROM = 9, 8
#: Candidates with which each text is compared first; texts meant for a cell of the comparison; cells of a crowd at most.
NEAREST, CELL, CELLS = 2, 64, 48


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; a text of fewer words is one shingle, without words it has none."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, _shingles(text, words))), dtype=np.uint64))


def _shingles(text: str | None, words: int) -> set[bytes]:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return set()
    joined = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    return {joined[a : b - 1] for a, b in zip(ends, ends[words:])} if len(tokens) > words else {joined}


def wide_fingerprint(shingles: set[bytes]) -> bytes:
    """32 bytes: a bit is as in most of the distinct shingles' hashes, at a tie as in the least hash; no shingles: zero."""
    if not shingles:
        return bytes(WIDE // 8)
    digests = [xxhash.xxh3_128_digest(x) + xxhash.xxh3_128_digest(x, 1) for x in shingles]
    total, n = np.zeros(WIDE, dtype=np.int64), len(digests)
    for i in range(0, n, 1 << 14):  # bounded memory for very long texts
        rows = np.frombuffer(b"".join(digests[i : i + (1 << 14)]), dtype=np.uint8).reshape(-1, WIDE // 8)
        for j in range(0, len(rows), 255):
            total += np.unpackbits(rows[j : j + 255], axis=1).sum(axis=0, dtype=np.uint8)
    least = np.unpackbits(np.frombuffer(min(digests), dtype=np.uint8))
    return np.packbits(np.where(total * 2 == n, least, total * 2 > n).astype(np.uint8)).tobytes()


def _digest(shingles: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist()


def _row_key(docs: DataFrame) -> DataFrame:
    """docs with h and n, a row's key; equal rows share it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id", "text")).withColumn("n", F.coalesce(F.length("text"), F.lit(-1)).cast("long"))


S = [f"s{i}" for i in range(WIDE // 64)]


def fingerprinted(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, h, n, d0, d1 (digest of the shingle set), size (of it), s0 to s3 (wide fingerprint), less (hashes of the set without one shingle each, if small)."""

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "h": cols["h"], "n": cols["n"], "d0": [], "d1": [], "size": [], "less": []}
            wide = []
            for text in cols["text"]:
                shingles = _shingles(text, words)
                got = np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles)), dtype=np.uint64))
                d0, d1 = _digest(got)
                out["d0"].append(d0)
                out["d1"].append(d1)
                out["size"].append(len(got))
                out["less"].append([dict(zip(("d0", "d1"), _digest(np.delete(got, i)))) for i in range(len(got))] if 5 <= len(got) <= FEW_SHINGLES else [])
                wide.append(wide_fingerprint(shingles) if len(got) >= SKETCHED_FROM else bytes(WIDE // 8))
            wide = np.frombuffer(b"".join(wide), dtype=">i8").reshape(-1, len(S)).astype(np.int64)
            return out | {s: wide[:, i] for i, s in enumerate(S)}

        return run

    return map_batches(_row_key(docs), make, "doc_id long, h long, n long, d0 long, d1 long, size int, less array<struct<d0:long,d1:long>>, " + ", ".join(f"{s} long" for s in S))


def _apart(wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)


def _met(n: int, place: np.ndarray, own: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (a < b) of the n owners once that meets at some variant."""
    order = np.lexsort((own, place))
    place, own = place[order], own[order]
    ends = np.searchsorted(place, place, side="right")
    held, size, step = [], 0, 1
    at = np.flatnonzero(ends - np.arange(len(own)) > step)
    while len(at):
        held.append(own[at] * n + own[at + step])
        size += len(at)
        if size > most:  # a pair meets at many variants
            held = [np.unique(np.concatenate(held))]
            size = 0
        step += 1
        at = at[ends[at] - at > step]
    return np.divmod(np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64), n)


def _members(a: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members (places in order of groups) of the pairs of groups (a, b), about ``most`` at a time; each once where a group is paired with itself."""
    count = size[a] * size[b]
    upto = np.cumsum(count)
    for first in range(0, int(upto[-1]) if len(upto) else 0, most):
        flat = np.arange(first, min(first + most, int(upto[-1])))
        pair = np.searchsorted(upto, flat, side="right")
        x, y = np.divmod(flat - (upto[pair] - count[pair]), size[b[pair]])
        keep = (a[pair] != b[pair]) | (x < y)
        pair, x, y = pair[keep], x[keep], y[keep]
        yield begin[a[pair]] + x, begin[b[pair]] + y


def candidates(distinct: DataFrame, n_rows: int, radius: int = WIDE_RADIUS, least: float = SIMILAR, nearest: int | None = None) -> DataFrame:
    """Each pair of distinct(node, root, size, s0 to s3) once that meets under a key, has different roots and is worth comparing.

    Of the keys under which a pair meets, and the blocks where it does, the first one gives it. With ``nearest`` a block
    gives only so many for each of its nodes, as rows (a: node, b: other, apart). Else distinct has a column cell, and a
    block gives one row for each pair of cells, (low, high, pairs): pairs are packed, as a crowd of texts near each other has many.
    """
    half, prefix = KEY_RADIUS // 2, _prefix(n_rows, KEY_RADIUS // 2, KEY_BITS, 4)
    low = KEY_BITS - prefix
    masks = [int(m) for m in _masks(prefix, half)[half]]
    blocks = []
    for key in range(WIDE // KEY_BITS):
        top = F.shiftrightunsigned(S[key // 2], 64 - prefix) if key % 2 == 0 else F.shiftrightunsigned(S[key // 2], low).bitwiseAND(F.lit((1 << prefix) - 1))
        blocks += [top.bitwiseXOR(F.lit(m).cast("long")) + F.lit(key << prefix).cast("long") for m in masks]
    sent = distinct.select("node", "root", "size", *S, *([] if nearest is not None else ["cell"]), F.explode(F.array(*blocks)).alias("block"))

    def key_of(wide, key):
        return (wide[:, key // 2] >> np.uint64(0 if key % 2 else 32)) & np.uint64((1 << 32) - 1)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        node, root, size, wide = pdf["node"].to_numpy(), pdf["root"].to_numpy(), pdf["size"].to_numpy(), pdf[S].to_numpy().view(np.uint64)
        key, head = divmod(int(pdf["block"].iloc[0]), 1 << prefix)
        fp, head = key_of(wide, key), np.uint64(head)
        # texts of one key are a group; keys meet, not texts
        order = np.lexsort((node, fp))
        node, root, size, wide, fp = node[order], root[order], size[order], wide[order], fp[order]
        keys, begin, members = np.unique(fp, return_index=True, return_counts=True)
        left = half - np.bitwise_count((keys >> np.uint64(low)) ^ head).astype(np.int64)
        edges = _meet(keys, left, low, half, VARIANTS_AT_ONCE, lambda index, place, own: _met(len(index), place, own))
        a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
        a, b = np.divmod(np.unique(np.minimum(a, b) * len(keys) + np.maximum(a, b)), len(keys))
        own = np.flatnonzero(members > 1)
        a, b = np.concatenate([a, own]), np.concatenate([b, own])
        # of the blocks where two keys meet this one gives them: the larger key's own, or the smaller's with its two lowest differing bits turned
        ha, hb = keys[a] >> np.uint64(low), keys[b] >> np.uint64(low)
        x = ha ^ hb
        y = x & (x - np.minimum(x, np.uint64(1)))
        z = y & (y - np.minimum(y, np.uint64(1)))
        here = (np.bitwise_count(keys[a] ^ keys[b]) <= KEY_RADIUS) & (np.where(np.bitwise_count(x) <= half, hb, ha ^ x ^ z) == head)
        a, b = a[here], b[here]
        found = [(np.zeros(0, np.int64),) * 2]
        for p, q in _members(a, b, begin, members):
            fits = (root[p] != root[q]) & (np.minimum(size[p], size[q]) + 1e-9 >= least * np.maximum(size[p], size[q]))
            p, q = p[fits], q[fits]
            for k in range(key):  # an earlier key gives the pair
                f = key_of(wide, k)
                later = np.bitwise_count(f[p] ^ f[q]) > KEY_RADIUS
                p, q = p[later], q[later]
            near = _apart(wide, p, q) <= radius
            found.append((p[near], q[near]))
        p, q = (np.concatenate(v) for v in zip(*found))
        a, b, apart = np.where(node[p] < node[q], p, q), np.where(node[p] < node[q], q, p), _apart(wide, p, q).astype(np.int32)
        if nearest is None:
            cell = pdf["cell"].to_numpy()[order]
            low_, high = np.minimum(cell[a], cell[b]), np.maximum(cell[a], cell[b])
            by = np.lexsort((high, low_))
            a, b, low_, high = a[by], b[by], low_[by], high[by]
            starts = np.flatnonzero(np.r_[True, (low_[1:] != low_[:-1]) | (high[1:] != high[:-1])]) if len(a) else np.zeros(0, np.int64)
            packed = [np.stack([node[a[x:y]], node[b[x:y]]], axis=1).tobytes() for x, y in zip(starts, np.r_[starts[1:], len(a)])]
            return pd.DataFrame({"low": low_[starts], "high": high[starts], "pairs": packed})
        if len(a):
            ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
            near = np.lexsort((pair, apart[pair], ends))
            ends, pair = ends[near], pair[near]
            own = np.arange(len(ends)) - np.searchsorted(ends, ends) < nearest
            ends, pair = ends[own], pair[own]
            a, b, apart = ends, a[pair] + b[pair] - ends, apart[pair]
        return pd.DataFrame({"a": node[a], "b": node[b], "apart": apart})

    partitions = max(96, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "low long, high long, pairs binary" if nearest is None else "a long, b long, apart int"
    return sent.repartition(partitions, "block").groupBy("block").applyInPandas(block, schema)


def _sets(docs: DataFrame, need: DataFrame, words: int, few: int = 200_000) -> DataFrame:
    """node, shingles (bytes) of the nodes in need(node, h, n), from one row's text each."""

    def make():
        def run(cols):
            return {"node": cols["node"], "shingles": [shingle_set(t, words).tobytes() for t in cols["text"]]}

        return run

    small = need.count() <= few  # else both sides are shuffled
    rows = _row_key(docs).join(F.broadcast(need) if small else need, ["h", "n"]).select("node", "text")
    return map_batches(rows, make, "node long, shingles binary").dropDuplicates(["node"])


def cells_of(pairs: DataFrame) -> DataFrame:
    """node, cell: a crowd, the nodes that chains of pairs(a, b) connect, is dealt into cells of about CELL, at most CELLS of them."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    label = stored(nodes.join(components(pairs), "node", "left").select("node", F.coalesce("root", "node").alias("label")))
    counts = stored(label.groupBy("label").agg(F.count("*").alias("members")))
    dealt = joined(label, counts, ["label"], F.col("members") * HOT_SHARE > label.count())
    k = F.least(F.lit(CELLS), F.ceil(F.col("members") / CELL)).cast("long")
    return stored(dealt.select("node", F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(1)), k)).alias("cell")))


def _alike(packed: DataFrame, cells: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs of packed(low, high, pairs) whose sets' Jaccard similarity is at least ``least``.

    A set is sent once to every pair of cells that its cell is in: so in a crowd whose members are all each other's
    candidates it is sent CELLS times at most and not once for each pair, and no pair is a row.
    """
    packed = stored(packed.withColumn("at", F.xxhash64("low", "high")))
    at = packed.select("at", "low", "high").distinct().select("at", F.explode(F.array_distinct(F.array("low", "high"))).alias("cell"))
    rows = at.join(cells, "cell").join(sets, "node").select("at", "node", "shingles", F.lit(None).cast("binary").alias("pairs"))
    rows = rows.union(packed.select("at", F.lit(None).cast("long"), F.lit(None).cast("binary"), "pairs"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["pairs"].isna()
        held = {n: np.frombuffer(x, dtype=np.uint64) for n, x in zip(pdf["node"][told].astype("int64").tolist(), pdf["shingles"][told])}
        out = []
        for raw in pdf["pairs"][~told]:
            for a, b in np.frombuffer(raw, dtype=np.int64).reshape(-1, 2).tolist():
                x, y = held[a], held[b]
                z = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs are merged
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                if both + 1e-9 >= least * (len(x) + len(y) - both):
                    out.append((max(a, b), min(a, b)))
        # of links within a crowd a forest is enough
        if not out:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        names, flat = np.unique(np.array(out), return_inverse=True)
        flat = flat.reshape(-1, 2)
        root = roots(len(names), flat[:, 0], flat[:, 1])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved], "b": names[root[moved]]})

    return rows.groupBy("at").applyInPandas(compare, "a long, b long")


def _packed(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """pairs (a, b; a few for each node) as candidates() packs them."""
    of = lambda side: cells.select(F.col("node").alias(side), F.col("cell").alias(f"c{side}"))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high"), "a", "b")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.ascontiguousarray(pdf[["a", "b"]].to_numpy(dtype=np.int64)).tobytes()
        return pd.DataFrame({"low": pdf["low"].iloc[:1], "high": pdf["high"].iloc[:1], "pairs": [raw]})

    return dealt.groupBy("low", "high").applyInPandas(pack, "low long, high long, pairs binary")


def alike_tree(docs: DataFrame, distinct: DataFrame, words: int = 5, least: float = SIMILAR) -> DataFrame:
    """node, root: components of distinct(node, h, n, d0, d1, size, less, s0 to s3) under a similarity of ``least`` or more.

    Each text is first compared with its nearest candidates; then all pairs are that aren't connected by those links.
    So within a group of near copies few pairs are compared, and no candidate is left out.
    """
    wide = distinct.where(F.col("size") >= SKETCHED_FROM).select("node", F.col("node").alias("root"), "size", *S)
    n = distinct.count()
    first = stored(candidates(wide, n, least=least, nearest=NEAREST))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("apart", "b"))), 1, NEAREST)  # of NEAREST a block, and a node is in some hundred blocks
    met = stored(first.groupBy(F.col("a").alias("node")).agg(nearest.alias("m")))
    pairs = stored(met.select("node", F.explode("m.b").alias("b")).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())
    # one of two small sets is the other without one shingle: the whole digest decides
    smaller = distinct.where(F.col("size").between(4, FEW_SHINGLES - 1)).select(F.col("node").alias("b"), "d0", "d1")
    less = distinct.where(F.size("less") > 0).select(F.col("node").alias("a"), F.explode("less").alias("l")).select("a", "l.d0", "l.d1")
    by_digest = less.join(smaller, ["d0", "d1"]).select("a", "b").distinct()
    need = stored(met.select("node").join(distinct.select("node", "h", "n"), "node"))
    sets, cells = stored(_sets(docs, need, words)), cells_of(pairs.union(first.groupBy("a").agg(F.min("b").alias("b"))))  # two or three edges a node join a crowd
    edges = stored(by_digest.union(_alike(_packed(pairs, cells), cells, sets, least)))
    tree = components(edges)
    open_ = wide.drop("root").join(cells, "node").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stored(_alike(candidates(open_, n, least=least), cells, sets, least))
    return components(edges.union(more)) if more.limit(1).count() else tree


def alike_classes(docs: DataFrame, words: int = 5, least: float = SIMILAR) -> DataFrame:
    """doc_id, h, n (a row's key), component_id (the smallest doc_id reachable), first (doc_id, h, n of that row) for each row of docs(doc_id, text)."""
    all_ = stored(fingerprinted(docs, words))
    rest = ["size", "less", *S]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.struct("doc_id", "h", "n").alias("v")))
    distinct = all_.groupBy("d0", "d1").agg(first.alias("m"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in rest))
    distinct = stored(distinct.select("d0", "d1", "m.v.*", "copies", *rest, F.monotonically_increasing_id().alias("node")))
    tree = alike_tree(docs, distinct, words, least)
    named = named_by_least(distinct.select("node", "d0", "d1", "copies", "doc_id", "h", "n"), tree, ["doc_id", "h", "n"]).select("d0", "d1", "copies", "least")
    got = joined(all_.select("doc_id", "h", "n", "d0", "d1"), named, ["d0", "d1"], F.col("copies") * HOT_SHARE > all_.count())
    return got.select("doc_id", "h", "n", F.col("least.doc_id").alias("component_id"), F.col("least").alias("first"))


def keep_one(docs: DataFrame, words: int = 5, least: float = SIMILAR) -> DataFrame:
    """Of each group of texts with a shingle similarity of ``least`` or more the row with the smallest id, and the rows without an id.

    Rows are told apart by id and text: of an id with two texts only those rows go that are no group's first. Of rows
    repeated with id and text one stays. Null and empty texts are copies of each other. Empty tables give none.
    """
    got = stored(alike_classes(docs.select("doc_id", "text"), words, least).where("doc_id is not null"))
    gone = stored(got.where("struct(doc_id, h, n) <> first").select(F.col("doc_id").alias("__wl_id"), F.col("h").alias("__wl_h")).distinct())
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["__wl_id"]) & (F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == gone["__wl_h"]), "left_anti")
    if got.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept
