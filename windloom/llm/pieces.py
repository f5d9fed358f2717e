"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text has an edge for every piece at every place, and an edge of byte pieces for every
character that is no piece. Forward Viterbi scores are exact heuristics for an A-star search from the end:
each finished path is the next best segmentation. Between two characters that are side by side in no piece
the lattice falls apart into chunks. Each chunk is solved once while a task remembers
it: best path, and how much worse its second path is. The text's N best can change only the N - 1 chunks
whose second paths cost least, so A-star runs over these chunks' lattice, joined.

Scores are log probabilities of pieces. A unigram model has its own. A model of merges has only the ranks of its merges,
which can't be added up: its pieces get the logarithms of a Zipf law over rank, 1 / rank over the harmonic sum, as
merges are learned by frequency. Nothing is fitted to the texts, so an encoding depends on the model and the text only.

Null and empty texts have no pieces and one segmentation of score 0. A text holding the word mark itself
decodes to spaces there; round_trip tells. Of equal scores the segmentation is taken that splits later, always the same;
equal rows get equal rows, empty tables none.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm.common import map_batches

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks remembered in each of two generations.
REMEMBERED = 150_000
#: Below the worst piece: the penalty of a character that is no piece.
UNKNOWN = 10.0


#: Scores are whole multiples of this, so that sums are exact and equally good paths are equal.
UNIT = 2.0**-20


def by_rank(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """The pieces with log probabilities: scores that are all whole numbers of zero or less stand for the order of merges, which is that of ids."""
    scores = [s for _, s, t in pieces if t == "normal"]
    if not scores or any(s > 0 or s != int(s) for s in scores):
        return pieces
    whole, out, rank = math.log(math.fsum(1 / (r + 1) for r in range(len(scores)))), [], 0
    for p, s, t in pieces:
        rank += t == "normal"
        out.append((p, -math.log(rank) - whole if t == "normal" else s, t))
    return out


def load(model: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, log probability, type) of a model file, by id; type is normal, byte, unknown or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "other" if sp.is_control(i) or sp.is_unused(i) else "normal"
    return by_rank([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


class Pieces:
    """A model's pieces, the lattice over them, and a task's memory of chunks.

    No piece spans two characters that stand side by side in no piece, so the lattice is cut between them.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.pieces = [p for p, _, _ in pieces]
        self.score = {p: (round(s / UNIT) * UNIT, i) for i, (p, s, t) in enumerate(pieces) if t == "normal"}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == "byte"}
        self.raw = [bytes((int(p[3:5], 16),)) if t == "byte" else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.unknown_id = next((i for i, (_, _, t) in enumerate(pieces) if t == "unknown"), 0)
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN
        #: Character by character: a dict of what follows; under "" the score and id of the piece ending here.
        self.trie: dict = {}
        for p, got in self.score.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = got
        pairs = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        chars = sorted({c for pair in pairs for c in pair})
        place = {c: k + 1 for k, c in enumerate(chars)}
        self.place = np.zeros(0x110000, dtype=np.uint16)
        for c, k in place.items():
            self.place[ord(c)] = k
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for a, b in pairs:
            self.beside[place[a], place[b]] = True
        self.young: dict[str, tuple[bytes, float, float]] = {}
        self.old: dict[str, tuple[bytes, float, float]] = {}

    def chunks(self, text: str) -> list[str]:
        """The text cut wherever no piece can span."""
        at = self.place[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.beside[at[:-1], at[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def edges(self, text: str) -> list[list[tuple[int, float, int]]]:
        """By start: (end, score, id; -1 for a character that is no piece)."""
        n, out = len(text), []
        for i in range(n):
            here, j, node = [], i, self.trie
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if (got := node.get("")) is not None:
                    here.append((j, got[0], got[1]))
            if not here or here[0][0] != i + 1:
                here.append((i + 1, self.unknown, -1))
            out.append(here)
        return out

    def ids(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path of (start, end, id); characters that are no piece become bytes."""
        out = []
        for a, b, i in path:
            if i >= 0:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[x] for x in text[a:b].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown_id)
        return out

    def solve(self, text: str) -> tuple[bytes, float, float]:
        """Ids (32-bit) and score of the best path; by how much the second best is worse (inf if there is none).

        Forward Viterbi with the two best scores of each place.
        """
        n, trie, unknown = len(text), self.trie, self.unknown
        best, second, came = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            f1, f2, node, j, single = best[i], second[i], trie, i, False
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                got = node.get("")
                if got is None:
                    continue
                if j == i + 1:
                    single = True
                s = got[0]
                x, y = f1 + s, f2 + s
                if x > best[j]:
                    second[j] = y if y > best[j] else best[j]
                    best[j], came[j] = x, (i, j, got[1])
                elif x > second[j]:
                    second[j] = x
            if not single:
                j, x, y = i + 1, f1 + unknown, f2 + unknown
                if x > best[j]:
                    second[j] = y if y > best[j] else best[j]
                    best[j], came[j] = x, (i, j, -1)
                elif x > second[j]:
                    second[j] = x
        path, at = [], n
        while at:
            path.append(came[at])
            at = came[at][0]
        path.reverse()
        return array("i", self.ids(text, path)).tobytes(), best[n], best[n] - second[n]

    def remember(self, text: str) -> tuple[bytes, float, float]:
        got = self.old.pop(text, None) or self.solve(text)
        if len(text) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[text] = got
        return got

    def astar(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text's lattice, best first; backward A-star on forward scores."""
        return [(score, ids[0]) for score, ids in self._joined([text], n)]

    def encode(self, text: str | None) -> tuple[bytes, list[tuple[bytes, float, float]], list[str]]:
        """32-bit ids of the best path; the chunks' solutions; the chunks."""
        if not text:
            return b"", [], []
        chunks = self.chunks(MARK + text.replace(" ", MARK))
        known, other = self.young.get, self.remember
        solved = [known(c) or other(c) for c in chunks]
        return b"".join([s[0] for s in solved]), solved, chunks

    def nbest(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text: score and ids."""
        _, solved, chunks = self.encode(text)
        if not solved:
            return [(0.0, [])]
        at, paths, rest = self._loosest(solved, chunks, n)
        out = []
        for score, alternatives in paths:
            full: list[int] = []
            for i, s in enumerate(solved):
                full += alternatives[at.index(i)] if i in at else array("i", s[0]).tolist()
            out.append((rest + score, full))
        return out

    def nbest_scores(self, solved, chunks, n: int) -> list[float]:
        if not solved:
            return [0.0]
        _, paths, rest = self._loosest(solved, chunks, n)
        return [rest + s for s, _ in paths]

    def _loosest(self, solved, chunks, n):
        """The chunks that the n best can change, the n best over them (score, ids by chunk), the others' score."""
        worse = np.array([s[2] for s in solved])
        at = np.argpartition(worse, n - 2)[: n - 1] if 1 < n <= len(worse) else np.arange(len(worse) if n > 1 else 0)
        at = sorted(at[worse[at] < math.inf].tolist())
        rest = math.fsum([s[1] for s in solved]) - math.fsum([solved[i][1] for i in at])
        return at, list(self._joined([chunks[i] for i in at], n)) if at else [(0.0, [])], rest

    def _joined(self, parts: list[str], n: int):
        """A-star over the lattices of some chunks set end to end; ids by chunk."""
        cuts, edges, base = [], [], 0
        for p in parts:
            edges += [[(base + j, s, k) for j, s, k in here] for here in self.edges(p)]
            base += len(p)
            cuts.append(base)
        text = "".join(parts)
        forward, into = [0.0] + [-math.inf] * base, [[] for _ in range(base + 1)]
        for i, here in enumerate(edges):
            for j, s, p in here:
                into[j].append((i, s, p))
                forward[j] = max(forward[j], forward[i] + s)
        heap, made, found = [(-forward[base], 0, base, 0.0, None)], 0, 0
        while heap and found < n:
            cost, _, at, g, path = heapq.heappop(heap)
            if at == 0:
                steps = [[] for _ in parts]
                k = 0
                while path:
                    edge, path = path
                    while edge[0] >= cuts[k]:
                        k += 1
                    steps[k].append(edge)
                found += 1
                yield -cost, [self.ids(text, s) for s in steps]
                continue
            for i, s, p in into[at]:
                made += 1
                heapq.heappush(heap, (-(g + s + forward[i]), -made, i, g + s, ((i, at, p), path)))  # of equal ones the latest, which is nearest the start

    def decode(self, ids: bytes | list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in (array("i", ids) if isinstance(ids, bytes) else ids)]).decode("utf-8", "replace").removeprefix(" ")


def digest(ids: bytes) -> str:
    return hashlib.sha256(ids).hexdigest()


def _sent(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(load(model))  # as long as the vocabulary


_HELD: dict[str, Pieces] = {}


def held(model: str, sent) -> Pieces:
    """The model's pieces with their memory of chunks, kept while the Python process runs one task after another."""
    if model not in _HELD:
        _HELD.clear()
        _HELD[model] = Pieces(sent.value)
    return _HELD[model]


def encodings(docs: DataFrame, model: str = MODEL, n: int = 4) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as 32-bit integers), scores (n best, best first), round_trip."""
    sent = _sent(docs.sparkSession, model)

    def make():
        p = held(model, sent)

        def run(cols):
            out = {"doc_id": cols["doc_id"], "n_pieces": [], "ids_sha256": [], "scores": [], "round_trip": []}
            for text in cols["text"]:
                ids, solved, chunks = p.encode(text)
                out["n_pieces"].append(len(ids) // 4)
                out["ids_sha256"].append(digest(ids))
                out["scores"].append(p.nbest_scores(solved, chunks, n))
                out["round_trip"].append(p.decode(ids) == (text or ""))
            return out

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_pieces long, ids_sha256 string, scores array<double>, round_trip boolean")


def tokenised(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs without its text, with n_pieces and ids (best segmentation)."""
    sent = _sent(docs.sparkSession, model)
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {dict(docs.dtypes)[c]}" for c in kept), "n_pieces long, ids array<int>"])

    def make():
        p = held(model, sent)

        def run(cols):
            ids = [p.encode(t)[0] for t in cols["text"]]
            return {c: cols[c] for c in kept} | {"n_pieces": [len(i) // 4 for i in ids], "ids": [np.frombuffer(i, np.int32) for i in ids]}

        return run

    return map_batches(docs.select(*kept, "text"), make, schema)
