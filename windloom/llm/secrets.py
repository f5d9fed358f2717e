"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text; their hashes are counted by distinct repositories and distinct owners.
A value that several owners hold is a widely copied example; a value of fewer owners that looks random is a
live-looking credential. Beside patterns of known secrets every long random-looking token is a wide candidate: it
becomes a span only if its ownership makes it live, since on its looks alone it may as well be a checksum that many copy.

Null texts count as empty, empty tables give none. Repeated rows count as one repository. Columns of other names don't
matter. All patterns take time in proportion to the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import map_batches, sha256, spans_text, stored

# The base kinds' patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
# Kinds that the method adds.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
PREFIXED = re.compile(r"(?:ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_)[A-Za-z0-9_-]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}+={0,2}")
KINDS = (*BASE, "pem", "jwt", "prefixed", "wide")
_SEGMENT = re.compile(r"[A-Za-z0-9_-]++")
# A key's body where no END line closes it: base64 lines, the first of 16 characters or more; breaks may be escaped.
_BREAK = re.compile(r"(?:\s|\\[nrt])+")
_BODY = re.compile(r"(?:\s|\\[nrt])*[A-Za-z0-9+/=]{16,}+(?:(?:\s|\\[nrt])+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nrt])+[A-Za-z0-9+/]*={1,2})?")
#: Distinct owners from which a value is an example.
SHARED_BY = 3
#: Bits a character, and different characters, from which a value looks random; bits a character of a wide candidate.
ENTROPY, DIFFERENT, WIDE_ENTROPY = 2.5, 8, 3.7


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def pem_keys(text: str) -> list[tuple[int, int, str]]:
    """Start, stop and value of each private key: from BEGIN to its END line, else with the base64 that follows.

    The value is the body without breaks, so that a key is the same however it is wrapped; the header where there is none.
    """
    begins, out = [m for m in PEM.finditer(text) if m[1].endswith("PRIVATE KEY")], []
    for m, after in zip(begins, [*(b.start() for b in begins[1:]), len(text)]):
        end = f"-----END {m[1]}-----"
        at = text.find(end, m.end(), after)
        if at >= 0:
            stop, body = at + len(end), text[m.end() : at]
        else:
            follows = _BODY.match(text, m.end(), after)
            stop, body = follows.end() if follows else m.end(), follows[0] if follows else ""
        out.append((m.start(), stop, _BREAK.sub("", body) or m[0]))
    return out


def web_tokens(text: str) -> list[tuple[int, int]]:
    """Start and stop of header.body.signature, header and body beginning with eyJ and of 11 characters at least.

    Each dotted segment is looked at once, from the dot before a body.
    """
    out, done, at = [], 0, text.find(".eyJ")
    while at >= 0:
        body = _SEGMENT.match(text, at + 1)
        begin = at
        while begin > done and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "_-"):
            begin -= 1
        head = text.find("eyJ", begin, max(begin, at - 8))
        sign = _SEGMENT.match(text, body.end() + 1) if text[body.end() : body.end() + 1] == "." else None
        if head >= 0 and body.end() - body.start() >= 11 and sign:
            out.append((head, sign.end()))
            done = sign.end()
        else:
            done = at
        at = text.find(".eyJ", max(at + 1, done))
    return out


def wide(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Random-looking tokens with letters of both cases or digits, outside the spans found before."""
    out, busy, k = [], sorted((a, b) for _, a, b, _ in taken), 0
    for m in TOKEN.finditer(text):
        while k < len(busy) and busy[k][1] <= m.start():
            k += 1
        if k < len(busy) and busy[k][0] < m.end():
            continue
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= WIDE_ENTROPY:
            out.append(("wide", m.start(), m.end(), value))
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and all spans and wide candidates with the secret value."""
    text = text or ""
    base, every = [], []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                base.append(("assign", m.start(), m.end()))
                every.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                base.append(("access", m.start(), m.end()))
                every.append(("access", m.start(), m.end(), m[0]))
    for m in HEX.finditer(text):
        base.append(("hex", m.start(), m.end()))
        every.append(("hex", m.start(), m.end(), m[0]))
    every += [("pem", *key) for key in pem_keys(text)] if "-----BEGIN " in text else []
    every += [("jwt", a, b, text[a:b]) for a, b in web_tokens(text)]
    every += [("prefixed", m.start(), m.end(), m[0]) for m in PREFIXED.finditer(text)]
    return base, every + wide(text, every)


SCHEMA = "doc_id long, owner string, repo long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<value:long,random:boolean,kind:string,start:int,stop:int>>"


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """Per row of docs: counts, span texts, and the hashed candidates with their places."""

    def make():
        def run(cols):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
            for text in cols["text"]:
                base, every = find(text)
                n = Counter(k for k, _, _ in base)
                out["n_assign"].append(n["assign"])
                out["n_access"].append(n["access"])
                out["n_hex"].append(n["hex"])
                out["base_sha256"].append(sha256(spans_text(base, KINDS)))
                out["found"].append([{"value": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63), "random": k in ("pem", "wide") or entropy(v) >= ENTROPY and len(set(v)) >= DIFFERENT, "kind": k, "start": a, "stop": b} for k, a, b, v in every])
            return {"doc_id": cols["doc_id"], "owner": cols["owner"], "repo": cols["repo"]} | out

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.xxhash64(F.col(repo)).alias("repo"), "text")
    return map_batches(rows, make, SCHEMA)


def ownership(scanned: DataFrame) -> DataFrame:
    """value, n_repos, n_owners: each distinct first, so that a widely copied value is summed in parts."""
    held = scanned.select("owner", "repo", F.explode("found.value").alias("value")).groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n_repos"))
    return by_owner.groupBy("value").agg(F.sum("n_repos").alias("n_repos"), F.count("owner").alias("n_owners"))


def findings(scanned: DataFrame, shared_by: int = SHARED_BY, salts: int = 16) -> DataFrame:
    """doc_id, kind, start, stop, value, n_repos, n_owners, verdict (example, live, dull) of every candidate.

    A copied value's rows meet its counts under ``salts`` keys, so that no task gets them all.
    """
    rows = scanned.select("doc_id", "row", F.explode("found").alias("f")).select("doc_id", "row", "f.*").withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)))
    counts = ownership(scanned).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    verdict = F.when(F.col("n_owners") >= shared_by, "example").when(F.col("random"), "live").otherwise("dull")
    return rows.join(counts, ["value", "salt"]).drop("salt").withColumn("verdict", verdict)


def report(docs: DataFrame, owner: str = "source", repo: str = "doc_id", shared_by: int = SHARED_BY) -> DataFrame:
    """One row per row of docs: base counts and digest, all spans (wide candidates only where live), how many are live or examples."""
    scanned = stored(scan(docs, owner, repo).withColumn("row", F.monotonically_increasing_id()))
    place = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "stop", "kind")
    told = findings(scanned, shared_by).groupBy("row").agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if((F.col("verdict") == "example") & (F.col("kind") != "wide")).alias("n_example"),
        F.array_sort(F.collect_list(F.when((F.col("kind") != "wide") | (F.col("verdict") == "live"), place))).alias("spans"),  # of one text
    )
    text = F.array_join(F.transform(F.col("spans"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    none = F.lit(0).cast("long")
    rows = scanned.drop("found").join(told, "row", "left")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_example", none).alias("n_example"))
