"""Repair of the turn structure of conversations by a Viterbi search whose survivors coalesce.

A repaired conversation is empty or an optional system turn and then user and assistant in turn, at least once. Each
row is kept, given another role or deleted, and empty turns may be inserted; the cheapest edits win, and among equally
cheap ones the least string of their initials. Four states say what stands so far: nothing, a system turn alone, a user
turn last, an assistant turn last. Each state holds one survivor, the best way to reach it, as a path in a tree of
backpointers whose nodes count who refers to them. Losing paths are cut off up to the next fork. Once all survivors
share an ancestor, what leads to it is settled: its edits leave, and their rows with them. So a task holds the rows
between the last settled edit and the present one, however long the conversation is.

Equal costs are settled by the complete strings since the common ancestor. Initials and rows alone make up the cost and
insertions are not free, so of two equally cheap strings over the same rows neither begins the other, and what is
appended later never turns their order: one survivor for each state is enough.

Conversations are dealt by conv_id and sorted within a task by Spark, which spills; the digest of a conversation needs
its rows in one sequence, so one conversation is what one task must read, but not what it must hold. Which rows repeat
an earlier one is found before, by hashes of role and text, and told to the task beside the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_batches, parallelism, pieces


class Costs(NamedTuple):
    """What edits cost; an insertion must cost something. `truncated` is added for a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a turn with this initial leads to.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role that a turn may be given or inserted with, and the state after it.
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
INSERTIONS = (NOTHING, SYSTEM, ASSISTANT, USER)

_SPACE = b" \t\n\x0b\x0c\r"
KEPT, BLANK, DUPLICATE, TRUNCATED = range(4)


class Node:
    """An edit at the end of a path. `row` is what it leaves in the conversation: (turn, role, text), or None."""

    __slots__ = ("parent", "edit", "row", "depth", "children", "held")

    def __init__(self, parent: Node | None, edit: str, row: tuple | None) -> None:
        self.parent, self.edit, self.row, self.children, self.held = parent, edit, row, [], False
        self.depth = parent.depth + 1 if parent else 0


def earlier(a: Node, b: Node) -> bool:
    """Whether the edits up to a come before those up to b, compared since their last common ancestor."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


class Repair:
    """The search over one conversation; settled edits go to `emit` as (edit, row), in order."""

    def __init__(self, costs: Costs, emit: Callable[[str, tuple | None], None]) -> None:
        if costs.insert <= 0 or min(costs) < 0:
            raise ValueError("an insertion must cost something and no edit less than nothing")
        self.costs, self.emit = costs, emit
        self.root = Node(None, "", None)
        self.root.held = True
        self.best: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self._insert(self.best)
        self._hold(self.best)

    def push(self, fault: int, initial: str, row: tuple) -> None:
        """The next row: its fault, the initial of its role, and (turn, role, text)."""
        costs, before = self.costs, self.best
        after: list[tuple[int, Node] | None] = [None] * 4
        extra = costs.truncated if fault == TRUNCATED else 0
        stays = fault not in (BLANK, DUPLICATE)
        for state in range(4):
            if before[state] is None:
                continue
            cost, node = before[state]
            self._offer(after, state, cost + costs.delete, node, "D", None)
            if stays:
                kept = NEXT[state].get(initial)
                if kept is not None:
                    self._offer(after, kept, cost + extra, node, "K", row)
                role, given = GIVEN[state]
                self._offer(after, given, cost + extra + costs.rerole, node, "R", (row[0], role, row[2]))
        self._insert(after)
        self._prune(after)
        self._hold(after)
        self._settle()

    def finish(self) -> int:
        """Settles what is left and gives the cost."""
        ends = [x for x in (self.best[NOTHING], self.best[ASSISTANT]) if x]
        cost, node = ends[0]
        if len(ends) == 2 and self._better(ends[1], ends[0]):
            cost, node = ends[1]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit, node.row)
        return cost

    @staticmethod
    def _better(a: tuple[int, Node], b: tuple[int, Node]) -> bool:
        return a[0] < b[0] or a[0] == b[0] and earlier(a[1], b[1])

    def _offer(self, states: list, state: int, cost: int, parent: Node, edit: str, row: tuple | None) -> bool:
        there = states[state]
        if there and there[0] < cost:
            return False
        candidate = (cost, Node(parent, edit, row))
        if there and not self._better(candidate, there):
            return False
        states[state] = candidate
        return True

    def _insert(self, states: list) -> None:
        changed = True
        while changed:
            changed = False
            for state in INSERTIONS:
                if states[state]:
                    cost, node = states[state]
                    role, given = GIVEN[state]
                    changed |= self._offer(states, given, cost + self.costs.insert, node, "I", (None, role, b""))

    def _prune(self, states: list) -> None:
        """Drops survivors that can't win: whatever follows a system turn alone may also follow an assistant turn, that
        also nothing, and nothing's one advantage, to keep a system turn, saves a deletion at most."""
        for less, more in ((SYSTEM, ASSISTANT), (SYSTEM, NOTHING), (ASSISTANT, NOTHING)):
            if states[less] and states[more] and self._better(states[more], states[less]):
                states[less] = None
        nothing, assistant = states[NOTHING], states[ASSISTANT]
        if nothing and assistant and assistant[0] + self.costs.delete < nothing[0]:
            states[NOTHING] = None

    def _hold(self, states: list) -> None:
        """Makes `states` the survivors: their new nodes join the tree, what no survivor comes from leaves it."""
        old = [x[1] for x in self.best if x]
        for x in states:
            if x:
                self._attach(x[1])
        for node in old:
            node.held = False
        for x in states:
            if x:
                x[1].held = True
        for node in old:
            while node is not self.root and not node.held and not node.children and node.parent:
                parent, node.parent = node.parent, None
                parent.children.remove(node)
                node = parent
        self.best = states

    @staticmethod
    def _attach(node: Node) -> None:
        while node.parent is not None and node not in node.parent.children:
            node.parent.children.append(node)
            node = node.parent

    def _settle(self) -> None:
        while not self.root.held and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.emit(self.root.edit, self.root.row)

    def unsettled(self) -> int:
        """Nodes in the tree."""
        todo, n = [self.root], 0
        while todo:
            n += 1
            todo += todo.pop().children
        return n - 1


class Conversation:
    """Faults and repair of one conversation, row by row in order."""

    def __init__(self, conv_id: Any, costs: Costs, leave: Callable[[str, tuple | None], None] | None = None) -> None:
        self.conv_id, self.leave = conv_id, leave
        self.audit = bytearray()
        self.digest, self.lines = hashlib.sha256(), 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns = 0, 0
        self.first = self.last = None
        self.initial: str | None = None
        self.repair = Repair(costs, self.settled)

    def settled(self, edit: str, row: tuple | None) -> None:
        if self.leave:
            self.leave(edit, row)
            return
        self.audit += edit.encode()
        if row:
            self.digest.update((b"\n" if self.lines else b"") + row[1].encode() + b":" + row[2])
            self.lines += 1

    def push(self, turn: int | None, role: str, text: bytes, seen: bool) -> None:
        end = text.rstrip(_SPACE)
        fault = BLANK if not end else DUPLICATE if seen else KEPT if end[-1:] in b".!?" else TRUNCATED
        self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.repair.push(fault, initial, (turn, role, text))

    def result(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, self.audit.decode(), self.digest.hexdigest())


#: What a row of the exchange is, in the order within a turn: a conversation that is to be reported on, the hash of a row
#: seen in an earlier turn, a row.
NAMED, SEEN, ROW = range(3)


def in_order(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """conv_id, turn, kind, role, text, h1, h2, one conversation after another and in order within it."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    key = ["conv_id", "h1", "h2"]
    turn = F.struct("turn")
    repeated = rows.groupBy(*key).agg(F.min(turn).alias("first"), F.max(turn).alias("end")).where("first != end").drop("end")
    repeated = repeated.toDF("c", "k1", "k2", "first")
    seen = rows.select("turn", *key).distinct().join(
        repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    ).where(turn > F.col("first"))
    none = F.lit(None).cast("string")
    parts = rows.select("conv_id", "turn", F.lit(ROW).alias("kind"), "role", "text", "h1", "h2").unionByName(
        seen.select("conv_id", "turn", F.lit(SEEN).alias("kind"), none.alias("role"), none.alias("text"), "h1", "h2")
    )
    if ids is not None:
        zero, no_turn = F.lit(0).cast("long"), F.lit(None).cast("long")
        parts = parts.unionByName(ids.select("conv_id").distinct().select(
            "conv_id", no_turn.alias("turn"), F.lit(NAMED).alias("kind"), none.alias("role"), none.alias("text"), zero.alias("h1"), zero.alias("h2")
        ))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "kind", "role", "text"]
    return parts.repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def sweep(batches: Iterator[pa.RecordBatch], begin: Callable[[Any], Conversation]) -> Iterator[tuple[Conversation, bool]]:
    """Each conversation of a task's rows, as begun by `begin`, with all its rows pushed, and True; at the end of each
    batch the present one with the rows so far, and False."""
    now, turn, marks, previous = None, None, set(), None
    for batch in pieces(batches, "text"):
        ids, turns, kinds, roles, texts, h1, h2 = (batch.column(i) for i in range(7))
        columns = (c.to_pylist() for c in (ids, turns, kinds, roles, texts.cast(pa.binary()), h1, h2))
        for conv_id, t, kind, role, text, a, b in zip(*columns, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now, True
                now, turn, marks, previous = begin(conv_id), t, set(), None
            if t != turn:
                turn, marks, previous = t, set(), None
            if kind == SEEN:
                marks.add((a, b))
            elif kind == ROW:
                now.push(t, role, text, (a, b) in marks or previous == (role, text))
                previous = (role, text)
        if now is not None:
            yield now, False
    if now is not None:
        yield now, True


def audit(rows: DataFrame, ids: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text) and of `ids` (conv_id).

    gaps are turns missing between the first and the last; blank, duplicate and truncated count rows by their first
    fault; illegal counts neighbours whose roles don't follow each other; cost and audit are those of the repair, audit
    as initials of Keep, Rerole, Delete, Insert; repaired_sha256 is of the repaired "role:text" lines.

    A null conv_id is a conversation of its own; a null turn comes first and counts for no gap; null roles and texts are
    one space. Rows with the same turn are ordered by role, then text. A conversation without rows has zeros, an empty
    audit and the hash of nothing. Other columns don't matter; empty tables give an empty result.
    """
    kind = rows.schema["conv_id"].dataType
    schema = (
        f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string"
    )
    arrow = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()),
                       ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for conversation, complete in sweep(batches, lambda conv_id: Conversation(conv_id, costs)):
            if complete:
                done.append(conversation.result())
            if len(done) == 4096:
                yield batch_of(done, arrow)
        yield batch_of(done, arrow)

    return map_batches(in_order(rows, ids), work, schema)


def repaired(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn (null where inserted), edit (K, R or I), role and text.

    Rows leave a task as soon as their edits are settled. Nulls, ties and empty tables are as in audit().
    """
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, place long, turn long, edit string, role string, text string"
    arrow = pa.schema([("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()),
                       ("role", pa.string()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple] = []

        def begin(conv_id: Any) -> Conversation:
            places = count()

            def leave(edit: str, row: tuple | None) -> None:
                if row:
                    left.append((conv_id, next(places), row[0], edit, row[1], row[2].decode()))

            return Conversation(conv_id, costs, leave)

        for conversation, complete in sweep(batches, begin):
            if complete:
                conversation.repair.finish()
            if not complete or len(left) > 4096:
                yield batch_of(left, arrow)
        yield batch_of(left, arrow)

    return map_batches(in_order(rows, None), work, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The rows as a batch; the list is emptied."""
    columns = list(zip(*rows)) or [()] * len(schema)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults sown by the checksum of conversation and turn: dropped and repeated rows, emptied
    texts, missing ends of sentences, wrong roles. Nulls become one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(k == 4, "user").otherwise(text_of("role"))
    times = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    # an array of as many places as the row occurs: none for a dropped one
    places = F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), times)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(places).alias("copy")).drop("copy")


def _sql() -> str:
    """The damage, the faults and the cheapest edits in plain SQL.

    A state's best way is one string, its cost in twelve digits and then the edits, so the least string is the cheapest
    way and among equals the first; the states of all conversations advance by one row in each recursion.
    """

    def then(state: str, cost: str, edit: str) -> str:
        return f"lpad((({state})[1:12]::BIGINT + {cost})::VARCHAR, 12, '0') || ({state})[13:] || '{edit}'"

    def stays(state: str, initial: str) -> str:
        keep = f"CASE WHEN fault IN (0, 3) AND ini = '{initial}' THEN {then(state, 'extra', 'K')} END"
        rerole = f"CASE WHEN fault IN (0, 3) THEN {then(state, 'extra + 1', 'R')} END"
        return keep if initial == "s" else f"{keep}, {rerole}"

    user = ", ".join(stays(x, "u") for x in "nsa")
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
      FROM conversations),
k AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS k FROM b, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS ini,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM o),
r AS (SELECT *, CASE WHEN ending = '' THEN 1 WHEN nth > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             CASE WHEN ending NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM q),
v AS (SELECT conv_id, 0::BIGINT AS i, '000000000000' AS n, NULL::VARCHAR AS s, '000000000005I' AS u, '000000000010II' AS a
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, i, n, s, u, least(a, {then('u', '5', 'I')}) AS a FROM (
        SELECT conv_id, i, n, s, least(u, {then('n', '5', 'I')}, {then('s', '5', 'I')}, {then('a', '5', 'I')}) AS u, a FROM (
          SELECT r.conv_id, r.i, {then('n', '2', 'D')} AS n,
                 least({then('s', '2', 'D')}, {stays('n', 's')}) AS s,
                 least({then('u', '2', 'D')}, {user}) AS u,
                 least({then('a', '2', 'D')}, {stays('u', 'a')}) AS a
          FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1))),
best AS (SELECT conv_id, least(n, a) AS way FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
e AS (SELECT conv_id, unnest(string_split(way[13:], '')) AS edit, generate_subscripts(string_split(way[13:], ''), 1) AS pos FROM best WHERE length(way) > 12),
p AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM e),
l AS (SELECT p.conv_id, p.pos, p.edit, r.role, CASE WHEN p.edit = 'I' THEN '' ELSE r.text END AS text, r.ini,
             row_number() OVER (PARTITION BY p.conv_id ORDER BY p.pos) AS place
      FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.edit <> 'D'),
m AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM l),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                        || ':' || text, chr(10) ORDER BY place)) AS hash FROM m GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
             count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
             count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way[1:12]::BIGINT AS cost, way[13:] AS audit,
       coalesce(hash, sha256('')) AS repaired_sha256
FROM best LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM best.conv_id
"""


SQL = _sql()
