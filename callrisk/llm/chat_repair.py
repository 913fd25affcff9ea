"""Repair of conversation structure at the least edit cost.

A repaired conversation has the roles (system? (user assistant)+)?.  Its lattice has a node for every number
of rows taken and state of that pattern; edges are the edits: Keep (K, cost 0), Rerole to user or assistant
(R, 2), Delete (D, 3; the only edit of a blank or duplicate row), Insert an empty user or assistant row
(I, 2); a truncated row that stays adds 1.  ``solve`` runs Dijkstra from both ends: the forward and the
reverse heap meet, both go on until their least keys together exceed the best cost, so that every crossing
of that cost is known, and the least concatenated audit (string of edit letters) among the crossings wins.
Forward labels are compared by walking back to their common ancestor, reverse labels by their first letter.

Two passes over rows dealt by conversation and sorted by turn.  The first streams one code and two hashes a
row and solves each conversation; the second streams the texts beside the audits and gives the repaired
rows, so a very long conversation costs a task a few bytes a row, never its texts.

Defined results: null role and text are one space, null ids and turns in the damage key too; a null id is a
conversation of its own; null turns come first; rows of equal turn are ordered by role, then text; texts are
handled whole; a role counts by its first character; identical rows are compared by two 64-bit hashes; a gap
count beyond 2^63 - 1 is given as that number; a conversation without rows after damage has zeros and an
empty audit; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import bound_batches
from .tasks import written

BLANKS = " \t\n\x0b\x0c\r"
#: Role initials of the codes 0, 1, 2; all others are 3.  A row's code is initial + 4 * status.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, OPEN, GONE = range(3)
#: Pattern states: nothing yet, after system, after user, after assistant; the role that may follow.
FOLLOWS = (USER, USER, ASSISTANT, USER)
STATE_AFTER = (1, 2, 3)
ACCEPTING = (0, 3)
KEEP, REROLE, DELETE, INSERT, OPEN_KEPT = 0, 2, 3, 2, 1
LONG = (1 << 63) - 1
#: Conversations of up to this many rows are remembered by their codes, at most MEMO of them a worker.
MEMO_ROWS, MEMO = 40, 50_000


def kept_state(state: int, initial: int) -> int | None:
    """State after keeping a row of this initial, None where the pattern forbids it."""
    if initial == SYSTEM:
        return 1 if state == 0 else None
    return STATE_AFTER[initial] if initial == FOLLOWS[state] else None


#: (state, code) -> edits (letter, next state, cost) that take the row; state -> state after an insertion.
ROW_EDITS: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
INSERTED = [STATE_AFTER[FOLLOWS[q]] for q in range(4)]
for _q in range(4):
    for _code in range(12):
        _initial, _status = _code % 4, _code // 4
        _edits = [("D", _q, DELETE)]
        if _status != GONE:
            _extra = OPEN_KEPT if _status == OPEN else 0
            if kept_state(_q, _initial) is not None:
                _edits.append(("K", kept_state(_q, _initial), KEEP + _extra))
            _edits.append(("R", INSERTED[_q], REROLE + _extra))
        ROW_EDITS[_q, _code] = _edits
ROW_EDITS_BACK = {(q, code): [(letter, p, cost) for p in range(4) for letter, to, cost in ROW_EDITS[p, code] if to == q]
                  for q in range(4) for code in range(12)}
INSERTED_BACK = [[p for p in range(4) if INSERTED[p] == q] for q in range(4)]


class Search:
    """One direction of the search: settled distances, and of each label the neighbour, letter and length."""

    def __init__(self, starts: list[int], far: int):
        self.far = far                                  # 0: from the first row on, n: from the end back
        self.distance = {v: 0 for v in starts}
        self.label = {v: (None, "", 0) for v in starts}
        self.settled: set[int] = set()
        self.heap = [(0, 0, v) for v in starts]
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def reach(self, node: int, by: int, letter: str, cost: int, before) -> None:
        known = self.distance.get(node)
        if known is None or cost < known:
            heapq.heappush(self.heap, (cost, abs(self.far - node // 4), node))
        elif cost > known or not before((by, letter), self.label[node][:2]):
            return
        self.distance[node] = cost
        self.label[node] = (by, letter, self.label[by][2] + 1)

    def earlier(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        """Whether the audit that ends with label ``a`` is less: the earliest difference decides."""
        (u, x), (v, y) = a, b
        less = x < y if self.label[u][2] == self.label[v][2] else self.label[u][2] < self.label[v][2]
        while self.label[u][2] > self.label[v][2]:
            u, x, _ = self.label[u]
        while self.label[v][2] > self.label[u][2]:
            v, y, _ = self.label[v]
        if x != y:
            less = x < y
        while u != v:
            (u, x, _), (v, y, _) = self.label[u], self.label[v]
            if x != y:
                less = x < y
        return less

    def word(self, node: int) -> list[str]:
        out = []
        while self.label[node][0] is not None:
            node, letter, _ = self.label[node]
            out.append(letter)
        return out


def solve(codes: bytes) -> tuple[int, str]:
    """Least cost and, among the edits of that cost, the least audit."""
    n = len(codes)
    ahead, back = Search([0], 0), Search([4 * n + q for q in ACCEPTING], n)
    best = 0 if not n else float("inf")

    def forward(v: int):
        i, q = divmod(v, 4)
        yield "I", v - q + INSERTED[q], INSERT
        if i < n:
            for letter, to, cost in ROW_EDITS[q, codes[i]]:
                yield letter, 4 * (i + 1) + to, cost

    def reverse(v: int):
        i, q = divmod(v, 4)
        for p in INSERTED_BACK[q]:
            yield "I", 4 * i + p, INSERT
        if i:
            for letter, p, cost in ROW_EDITS_BACK[q, codes[i - 1]]:
                yield letter, 4 * (i - 1) + p, cost

    while (x := ahead.top()) + (y := back.top()) <= best:
        mine, other, edges = (ahead, back, forward) if x <= y else (back, ahead, reverse)
        _, _, v = heapq.heappop(mine.heap)
        mine.settled.add(v)
        before = mine.earlier if mine is ahead else lambda a, b: a[1] < b[1]
        best = min(best, mine.distance[v] + other.distance.get(v, float("inf")))
        for letter, to, cost in edges(v):
            if to not in mine.settled:
                mine.reach(to, v, letter, mine.distance[v] + cost, before)
            best = min(best, mine.distance[v] + cost + other.distance.get(to, float("inf")))
    least = None
    for u in ahead.settled:  # the last node of a path that the forward search settled, and the edge after it
        crossings = [(letter, to) for letter, to, cost in forward(u) if to not in ahead.settled and to in back.settled
                     and ahead.distance[u] + cost + back.distance[to] == best]
        if u // 4 == n and u % 4 in ACCEPTING and ahead.distance[u] == best:
            crossings.append(("", None))
        for letter, to in crossings:
            audit = "".join(ahead.word(u)[::-1]) + letter + ("".join(back.word(to)) if to is not None else "")
            least = audit if least is None else min(least, audit)
    return int(best), least


_SOLVED: dict[bytes, tuple[int, str]] = {}


def solved(codes: bytes) -> tuple[int, str]:
    """``solve``, remembering short conversations: few patterns make up most of them."""
    if len(codes) > MEMO_ROWS:
        return solve(codes)
    if codes not in _SOLVED:
        if len(_SOLVED) >= MEMO:
            _SOLVED.clear()
        _SOLVED[codes] = solve(codes)
    return _SOLVED[codes]


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, dropped) after the damage of crc32(id:turn) mod 20: 0 drops the row (it stays
    here, marked), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets its role to user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
                     space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")) \
        .otherwise(F.col("text"))
    return rows.select("id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") == 0).alias("dropped"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")) \
        .drop("copy")


def initial_code(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def runs(column: pa.Array):
    """(value as a one-element array, first row, end row) of each run of equal ids of a batch."""
    encoded = pc.run_end_encode(column, run_end_type=pa.int32())
    start = 0
    for k, end in enumerate(encoded.run_ends.to_pylist()):
        yield encoded.values.slice(k, 1), start, end
        start = end


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _with_id(kind: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("id", kind), *T._parse_datatype_string(rest).fields])


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as ``damaged`` gives them): counts, least cost and audit.

    Counts are of the rows that are not dropped: gaps in the turns, rows by their first fault, and
    neighbours whose initials are not su, ua or au.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    coded = rows.select(
        "id", "turn", "role", "text", "dropped", initial_code(F.col("role")).cast("long").alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    dealt = coded.repartition("id").sortWithinPartitions(
        F.asc_nulls_first("id"), F.asc_nulls_first("turn"), "role", "text").drop("role", "text")
    schema = _with_id(rows.schema["id"].dataType, PLAN)
    names = ("initial", "blank", "open", "h1", "h2")

    def planned(key: pa.Array, parts: list[pa.RecordBatch]) -> list:
        table = pa.Table.from_batches(parts)
        table = table.filter(pc.invert(table.column("dropped")))
        turns = pc.drop_null(table.column("turn")).combine_chunks().to_numpy(zero_copy_only=False)
        initial, blank, open_, h1, h2 = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names)
        again = np.zeros(len(initial), bool)
        order = np.lexsort((h2, h1))
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        again &= ~blank
        gone = blank | again
        open_ = open_ & ~gone
        pair = initial[:-1] * 4 + initial[1:]
        legal = np.isin(pair, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
        cost, audit = solved((initial + 4 * (OPEN * open_ + GONE * gone)).astype(np.uint8).tobytes())
        return [key, min(gaps, LONG), int(blank.sum()), int(again.sum()), int(open_.sum()), int((~legal).sum()), cost, audit]

    def run(batches):
        key, parts = None, []
        for batch in batches:
            done = []
            for value, a, b in runs(batch.column(0)):
                if parts and not value.equals(key):
                    done.append(planned(key, parts))
                    parts = []
                key = value
                parts.append(batch.slice(a, b - a))
            if done:
                yield made(done)
        if parts:
            yield made([planned(key, parts)])

    def made(done):
        columns = list(zip(*done))
        fields = [(f, pa.string() if f == "audit" else pa.int64()) for f in schema.names[1:]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(columns[0]),
                                           *[pa.array(c, k) for c, (_, k) in zip(columns[1:], fields)]], names=schema.names)

    return dealt.mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, place, edit, role, text): the rows of every repaired conversation, back to back and in order
    inside their partition.  ``found``: the plans of ``rows``."""
    bound_batches(rows.sparkSession)
    kept = rows.where("NOT dropped").select(
        "id", F.lit(1).alias("part"), "turn", "role", "text", initial_code(F.col("role")).cast("long").alias("initial"))
    audits = found.select("id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.col("audit").alias("text"), F.lit(0).cast("long").alias("initial"))
    dealt = audits.unionAll(kept).repartition("id").sortWithinPartitions(
        F.asc_nulls_first("id"), "part", F.asc_nulls_first("turn"), "role", "text")
    schema = _with_id(rows.schema["id"].dataType, "place long, edit string, role string, text string")

    def run(batches):
        audit, at, state, place = "", 0, 0, 0
        for batch in batches:
            ids, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "role", "text", "initial")]
            for k, (part, role, text, initial) in enumerate(zip(*columns)):
                if part == 0:
                    audit, at, state, place = text, 0, 0, 0
                    edit = None
                else:
                    edit = audit[at]
                    at += 1
                if edit == "K":
                    state = kept_state(state, initial)
                elif edit == "R":
                    role, state = ("user" if FOLLOWS[state] == USER else "assistant"), INSERTED[state]
                if edit in ("K", "R"):
                    ids.append(k)
                    out.append((place, edit, role, text))
                    place += 1
                while at < len(audit) and audit[at] == "I":
                    ids.append(k)
                    out.append((place, "I", "user" if FOLLOWS[state] == USER else "assistant", ""))
                    state, at, place = INSERTED[state], at + 1, place + 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids)), *[pa.array(c, k) for c, k in zip(
                        zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string()))]], names=schema.names)

    return dealt.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """(id, repaired_sha256) of the role:text lines of each conversation that has rows; ``rows`` as
    ``repaired`` gives them, hashed as they stream by."""
    schema = _with_id(rows.schema["id"].dataType, "repaired_sha256 string")

    def run(batches):
        import hashlib

        key, state = None, None
        for batch in batches:
            keys, out = [], []
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for value, a, b in runs(batch.column(0)):
                if state is not None and value.equals(key):
                    state.update(b"\n")
                else:
                    if state is not None:
                        keys.append(key)
                        out.append(state.hexdigest())
                    key, state = value, hashlib.sha256()
                state.update("\n".join(f"{r}:{t}" for r, t in zip(roles[a:b], texts[a:b])).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(out)], names=schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([key, pa.array([state.hexdigest()])], names=schema.names)

    return rows.mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (written to the shared folder) and repaired rows of ``rows``, as ``damaged`` gives them."""
    found = written(plans(rows), "chat-plans")
    return found, repaired(rows, found)
