"""Personal data: base patterns, then bootstrapped contextual extraction.

Base matches are seed entities. Each seed, and each other token with a mark of some shape, meets lexical patterns:
the one and two words before it, those after it, and one on both sides. Spark scores the graph of patterns and instances in rounds:
for a pattern speak its distinct seeds and the instances believed in the round before, against it the other
tokens it meets that cannot be of the kind, and one more; unknown tokens of fitting shape say nothing. An unknown
token of fitting shape is believed as much as its best pattern, and then supports its other patterns. Tokens
believed at the end are further spans. Null texts count as empty; equal rows get equal spans; empty tables give none.
Whole neighbouring words count, however long: one beyond WORD_LENGTH stands for itself by its hash.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import map_batches, sha256, spans_text, stored

KINDS = ("email", "ip", "card", "phone")
# The base kinds' patterns; the email's local part is found by going left from the sign.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a word beyond which a pattern holds its hash.
WORD_LENGTH = 40
#: Distinct seeds and believed instances that a pattern needs; score from which patterns and instances are believed; rounds.
SUPPORT, BELIEVED, ROUNDS = 3, 0.8, 3

#: What a token of any shape holds.
_MARKED = re.compile(r"(?:[0-9@]|[\[(]at[\])]|[A-Fa-f]:[A-Fa-f:])\S*")
_SHAPES = {
    "email": re.compile(r"[\w.+-]+(?:@|\[at\]|\(at\))[\w.\[\]()-]+"),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{0,4}|[0-9]{1,3}(?:[,_-][0-9]{1,3}){3}"),
    "card": re.compile(r"(?:[0-9][./_-]?){12,19}"),
    "phone": re.compile(r"\(?[0-9](?:[()./-]*[0-9]){6,14}"),
}
_EDGE = " \t\"'()[]<>{},.;:!?"
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Contexts:
    """A text's words, for looking up the neighbours of places in it."""

    def __init__(self, text: str):
        self.text = text
        self.places = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.places]

    def word(self, k: int, low: int, high: int) -> str:
        """The k-th word's part between low and high, folded; "" where there is none or only signs."""
        if not 0 <= k < len(self.places):
            return ""
        a, b = max(self.places[k][0], low), min(self.places[k][1], high)
        word = self.text[a:b] if a < b else ""
        word = word.strip(_EDGE).lower()
        return word if len(word) <= WORD_LENGTH else f"#{xxhash.xxh64_hexdigest(word.encode('utf-8', 'surrogatepass'))}"

    def patterns(self, start: int, end: int) -> list[str]:
        n = len(self.text)
        k = bisect_right(self.starts, start) - 1
        mine = 0 <= k < len(self.places) and self.places[k][0] < start and self.word(k, 0, start)  # what stands before the place in its own word is a neighbour
        before = k if mine else k - 1
        last = bisect_right(self.starts, end - 1) - 1
        after = last if last >= 0 and self.word(last, end, n) else last + 1
        a, a2 = self.word(before, 0, start), self.word(before - 1, 0, start)
        b, b2 = self.word(after, end, n), self.word(after + 1, end, n)
        found = [(a, f"{a} _"), (a and a2, f"{a2} {a} _"), (b, f"_ {b}"), (b and b2, f"_ {b} {b2}"), (a and b, f"{a} _ {b}")]
        return [p for there, p in found if there]


def _context(text: str, start: int, end: int) -> list[str]:
    return Contexts(text).patterns(start, end)


def tokens(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Marked tokens that touch no base span, once for each kind whose shape fits, or once with kind ""."""
    out, floor, busy, at = [], 0, sorted((a, b) for _, a, b in taken), 0
    for m in _MARKED.finditer(text):
        start, end = m.start(), m.end()
        while start > floor and not text[start - 1].isspace():
            start -= 1
        floor = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        if start == end or at < len(busy) and busy[at][0] < end:
            continue
        fits = [kind for kind, shape in _SHAPES.items() if shape.fullmatch(text, start, end)]
        out += [(kind, start, end) for kind in fits or ("",)]
    return out


SCHEMA = "doc_id long, h long, n long, base array<struct<kind:string,start:int,stop:int>>, base_sha256 string, met array<struct<kind:string,start:int,stop:int,value:long,known:boolean,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """Per row: its key, base spans and what meets patterns (seeds and unknown tokens)."""

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "h": cols["h"], "n": cols["n"], "base": [], "base_sha256": [], "met": []}
            for text in cols["text"]:
                text = text or ""
                base = base_spans(text)
                met, more = [], tokens(text, base)
                around = Contexts(text) if base or more else None
                for known, spans in ((True, base), (False, more)):
                    for kind, a, b in spans:
                        met.append({"kind": kind, "start": a, "stop": b, "value": xxhash.xxh64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")) - (1 << 63), "known": known, "patterns": around.patterns(a, b)})
                out["base"].append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
                out["base_sha256"].append(sha256(spans_text(base, KINDS)))
                out["met"].append(met)
            return out

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id", "text")).withColumn("n", F.coalesce(F.length("text"), F.lit(-1)).cast("long"))
    return map_batches(rows, make, SCHEMA)


def believed(scanned: DataFrame, support: int = SUPPORT, least: float = BELIEVED, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, belief of the unknown instances that the rounds come to believe."""
    edges = scanned.select(F.explode("met").alias("m")).select("m.kind", "m.value", "m.known", F.explode("m.patterns").alias("pattern"))
    edges = stored(edges.groupBy("kind", "pattern", "value").agg(F.max("known").alias("known")))
    of_kind = edges.where("kind <> ''").groupBy("kind", "pattern").agg(F.count_if("known").alias("seeds"), F.count("*").alias("fitting")).where(F.col("fitting") >= support)
    every = edges.groupBy("pattern", "value").agg(F.lit(1).alias("one")).groupBy("pattern").agg(F.count("*").alias("every"))
    patterns = stored(of_kind.join(every, "pattern").select("kind", "pattern", "seeds", (F.col("every") - F.col("fitting")).alias("against")))
    met = stored(edges.where("not known and kind <> ''").select("kind", "pattern", "value").join(patterns.select("kind", "pattern"), ["kind", "pattern"], "left_semi"))
    belief = None
    for _ in range(rounds):
        now = patterns.withColumns({"more": F.lit(0), "gained": F.lit(0.0)})
        if belief is not None:
            got = met.join(belief, ["kind", "value"]).groupBy("kind", "pattern").agg(F.count("*").alias("more"), F.sum("belief").alias("gained"))
            now = patterns.join(got, ["kind", "pattern"], "left").fillna(0, ["more", "gained"])
        speaks = F.col("seeds") + F.col("gained")
        scored = now.where(F.col("seeds") + F.col("more") >= support).withColumn("score", speaks / (speaks + F.col("against") + 1)).where(F.col("score") >= least)
        belief = stored(met.join(scored.select("kind", "pattern", "score"), ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("score").alias("belief")))
    return belief


def discovered(scanned: DataFrame, **how) -> DataFrame:
    """h, n (a row's key) and the further spans of such rows."""
    tokens_met = scanned.select("h", "n", F.explode(F.filter("met", lambda m: ~m["known"])).alias("m")).select("h", "n", "m.kind", "m.value", "m.start", "m.stop").distinct()
    return tokens_met.join(believed(scanned, **how), ["kind", "value"]).groupBy("h", "n").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))


def _text_of(spans):
    order = F.when(spans["kind"] == KINDS[0], 0).when(spans["kind"] == KINDS[1], 1).when(spans["kind"] == KINDS[2], 2).otherwise(3)
    return F.struct(spans["start"].alias("start"), order.alias("order"), spans["stop"].alias("stop"), spans["kind"].alias("kind"))


def extract(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans, their digest, and all spans as text."""
    scanned = stored(scan(docs))
    rows = scanned.join(discovered(scanned, **how), ["h", "n"], "left")
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,stop:int>>"))), _text_of))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return rows.select("doc_id", *counts, "base_sha256", text.alias("spans"))


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Spans replaced by [KIND]; of overlapping ones the first gives the name."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = end = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, few: int = 200_000, **how) -> DataFrame:
    """docs with all spans masked in text, and n_chars (if there) counted anew; all columns and rows stay."""
    scanned = stored(scan(docs.select("doc_id", "text")))
    more = stored(discovered(scanned, **how).toDF("__wl_h", "__wl_n", "__wl_more"))
    rows = docs.withColumn("__wl_key", F.struct(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("h"), F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n")))
    small = more.count() <= few  # else both sides are shuffled
    rows = rows.join(F.broadcast(more) if small else more, (F.col("__wl_key.h") == F.col("__wl_h")) & (F.col("__wl_key.n") == F.col("__wl_n")), "left").select(*docs.columns, "__wl_more")
    names = docs.columns

    def make():
        def run(cols):
            texts = []
            for text, extra in zip(cols["text"], cols["__wl_more"]):
                texts.append(mask(text, base_spans(text) + [(s["kind"], s["start"], s["stop"]) for s in extra or ()]))
            out = {c: cols[c] for c in names} | {"text": texts}
            if "n_chars" in out:
                out["n_chars"] = [n if t is None else len(t) for n, t in zip(cols["n_chars"], texts)]
            return out

        return run

    return map_batches(rows, make, docs.schema)
