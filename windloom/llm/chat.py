"""Chat formatting with minimum-cost role repair.

Legal: an optional system turn, then user and assistant turns in alternation, ending with the assistant. For
each turn a program over the automaton's states chooses its role and whether it joins the turn before (merge)
or follows it, with empty turns put in where the automaton needs them. A run of turns is a min-plus matrix
over the four states, and matrices compose; so a conversation that range partitioning deals to several
tasks is solved exactly: each task sends the matrices of its first and last conversation only, the states at
the cuts follow from their product, and each task then traces back its own turns. Nothing gathers a whole conversation.

Turns are ordered by (turn, role, text), nulls first. Null texts count as empty, null or unknown roles may
take any role cheaply, rows without conv_id form one conversation. Of equally cheap repairs a hash of the rows decides.
Repeated rows are turns of their own; empty tables give none. Marks of turns inside a text are escaped, so that no text
can open or close a turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: joining the turn before (with and without text), another role, a role for an unknown one, an empty turn.
MERGE, MERGE_EMPTY, RELABEL, NAME, INSERT = 2, 1, 5, 1, 3
FAR = 1 << 40
_MARK = re.compile(r"<(\\*)\|")


def _between() -> list[list[list[int] | None]]:
    """The roles to put in on the shortest way from one state to another (None: no way)."""
    out = [[None] * 4 for _ in range(4)]
    for s in range(4):
        todo = [(q, []) for q in FOLLOWS[s]]
        while todo:
            q, way = todo.pop(0)
            if out[s][q] is None:
                out[s][q] = way
                todo += [(n, way + [q]) for n in FOLLOWS[q]]
    return out


BETWEEN = _between()
END = [0 if s in (START, ASSISTANT) else INSERT * (len(BETWEEN[s][ASSISTANT]) + 1) for s in range(4)]


def role_of(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), START)


def step(role: int, empty: bool) -> np.ndarray:
    """cost[s, q] of a turn taking role q after state s."""
    cost = np.full((4, 4), FAR, dtype=np.int64)
    for q in (SYSTEM, USER, ASSISTANT):
        own = 0 if role == q else NAME if role == START else RELABEL
        for s in range(4):
            ways = [MERGE_EMPTY if empty else MERGE] if s == q else []
            if BETWEEN[s][q] is not None:
                ways.append(INSERT * len(BETWEEN[s][q]))
            if ways:
                cost[s, q] = own + min(ways)
    return cost


STEPS = {(r, e): step(r, e) for r in range(4) for e in (False, True)}


#: One unit of cost, in which ties are broken by sums of small numbers.
UNIT = 1 << 64
IDENTITY = [[0 if s == q else FAR * UNIT for q in range(4)] for s in range(4)]


def ties(turn: int | None, role: str | None, text: str | None) -> tuple[int, ...]:
    """A small number for each role that a row may take: of equally cheap repairs the one with the least sum is taken, however the rows are dealt."""
    key = f"{turn}|{role}|{text}".encode("utf-8", "surrogatepass")
    return tuple(xxhash.xxh32_intdigest(key, q) for q in range(4))


def compose(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(min(a[s][k] + b[k][q] for k in range(4)), FAR * UNIT) for q in range(4)] for s in range(4)]


def product(turns: list[tuple[int, bool]], broken: list[tuple[int, ...]]) -> list[list[int]]:
    m = IDENTITY
    for t, tie in zip(turns, broken):
        m = compose(m, [[int(STEPS[t][s, q]) * UNIT + tie[q] for q in range(4)] for s in range(4)])
    return m


def solve(turns: list[tuple[int, bool]], entry: int = START, leave: int | None = None, broken: list[tuple[int, ...]] | None = None) -> list[int]:
    """The role of each turn on the cheapest way from ``entry`` (to ``leave``, or to a legal end)."""
    cost, back = [FAR * UNIT] * 4, []
    cost[entry] = 0
    for k, t in enumerate(turns):
        m, new, came, tie = STEPS[t], [FAR * UNIT] * 4, [0] * 4, broken[k] if broken else (0, 0, 0, 0)
        for q in range(1, 4):
            for s in range(4):
                c = cost[s] + int(m[s, q]) * UNIT + tie[q]
                if c < new[q]:
                    new[q], came[q] = c, s
        cost = new
        back.append(came)
    if leave is None:
        leave = min(range(4), key=lambda s: (cost[s] + END[s] * UNIT, s))
    path = [leave]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1][1:]


OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def render(turns: list[tuple[int, bool]], texts: list[str], path: list[int], entry: int, last: bool) -> list[dict]:
    """For each turn its action, cost, empty turns put in before (or at the end), and its piece of the chat.

    The pieces of a conversation, joined in order, are its rendering.
    """
    out, s = [], entry
    for i, (turn, text, q) in enumerate(zip(turns, texts, path)):
        way = BETWEEN[s][q]
        merge_cost = (MERGE_EMPTY if turn[1] else MERGE) if s == q else None
        merged = merge_cost is not None and (way is None or merge_cost <= INSERT * len(way))
        named = 0 if turn[0] == q else NAME if turn[0] == START else RELABEL
        put = [] if merged else way
        piece = "\n" * bool(text) + text if merged else CLOSE * (s != START) + "".join(OPEN.format(ROLES[r]) + CLOSE for r in put) + OPEN.format(ROLES[q]) + text
        cost = named + (merge_cost if merged else INSERT * len(put))
        n = len(put)
        if last and i == len(turns) - 1:
            tail = [] if q == ASSISTANT else BETWEEN[q][ASSISTANT] + [ASSISTANT]
            piece += CLOSE + "".join(OPEN.format(ROLES[r]) + CLOSE for r in tail)
            cost += END[q]
            n += len(tail)
        out.append({"new_role": ROLES[q], "action": "+".join((["merge"] if merged else []) + (["relabel"] if named else [])) or "keep", "inserted": n, "cost": cost, "rendered": piece})
        s = q
    return out


def escaped(text: str | None) -> str:
    """The text with a backslash inside each "<|", and one more where there are some already."""
    return _MARK.sub(r"<\\\1|", text or "")


def _segments(batches: Iterator[pa.RecordBatch]):
    """(conv_id, rows) of each run of one conversation in a sorted partition."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and r[0] != now:
                yield now, rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield now, rows


def _turns(seg: list[tuple]) -> tuple[list[tuple[int, bool]], list[tuple[int, ...]]]:
    return [(role_of(r[2]), not r[3]) for r in seg], [ties(*r[1:]) for r in seg]


def repair(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, pos (from 0), turn, role, new_role, action, inserted, cost, rendered; one row per turn."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    rows = stored(rows.repartitionByRange(n, *keys[:2]).sortWithinPartitions(*keys))

    def ends(batches):
        part = TaskContext.get().partitionId()
        kept, i = [], -1
        for i, (conv, seg) in enumerate(_segments(batches)):
            kept = kept[:1] + [(conv, seg, i)]
        cost = [[str(c) for row in product(*_turns(seg)) for c in row] for _, seg, _ in kept]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(kept), pa.int32()), "seq": pa.array([k[2] for k in kept], pa.int64()), "conv_id": pa.array([k[0] for k in kept], pa.int64()),
            "n": pa.array([len(k[1]) for k in kept], pa.int64()), "cost": pa.array(cost, pa.list_(pa.string())),
        })

    cuts = rows.mapInArrow(ends, "part int, seq long, conv_id long, n long, cost array<string>").collect()  # two rows a partition at most
    by_conv: dict = {}
    for c in sorted(cuts, key=lambda c: (c["part"], c["seq"])):
        by_conv.setdefault(c["conv_id"], []).append((c["part"], c["n"], [[int(x) for x in c["cost"][4 * k : 4 * k + 4]] for k in range(4)]))
    known: dict = {}
    for conv, segs in by_conv.items():
        if len(segs) == 1:
            continue
        forward = [IDENTITY[START]]
        for _, _, m in segs:
            forward.append([min(forward[-1][k] + m[k][q] for k in range(4)) for q in range(4)])
        s = min(range(4), key=lambda k: (forward[-1][k] + END[k] * UNIT, k))
        offset = sum(g[1] for g in segs)
        for i in range(len(segs) - 1, -1, -1):
            part, n_turns, m = segs[i]
            before = min(range(4), key=lambda k: (forward[i][k] + m[k][s], k))
            offset -= n_turns
            known[(part, conv)] = (before, s, offset, i == len(segs) - 1)
            s = before
    sent = spark.sparkContext.broadcast(known)

    def solved(batches):
        part, at = TaskContext.get().partitionId(), sent.value
        for conv, seg in _segments(batches):
            entry, leave, offset, last = at.get((part, conv), (START, None, 0, True))
            turns, broken = _turns(seg)
            told = render(turns, [escaped(r[3]) for r in seg], solve(turns, entry, leave, broken), entry, last)
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([r[0] for r in seg], pa.int64()), "pos": pa.array(range(offset, offset + len(seg)), pa.int64()), "turn": pa.array([r[1] for r in seg], pa.int64()), "role": pa.array([r[2] for r in seg], pa.string()),
                "new_role": pa.array([t["new_role"] for t in told], pa.string()), "action": pa.array([t["action"] for t in told], pa.string()), "inserted": pa.array([t["inserted"] for t in told], pa.int64()),
                "cost": pa.array([t["cost"] for t in told], pa.int64()), "rendered": pa.array([t["rendered"] for t in told], pa.string()),
            })

    return rows.mapInArrow(solved, "conv_id long, pos long, turn long, role string, new_role string, action string, inserted long, cost long, rendered string")
