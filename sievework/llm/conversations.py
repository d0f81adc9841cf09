"""Conversation structure repair: the cheapest edits that give every conversation the order of turns it should have.

A sound conversation is nothing at all, or an optional system row and then user and assistant rows in turn, ending with the
assistant.  Rows are kept, given the other role, deleted, or empty rows are inserted, at a cost each; the cheapest sequence of edits is
the shortest path through a trellis of four states, ties broken by the edits' initials.

The search is a Viterbi pass over the rows in order.  The surviving paths of the states form a tree of backpointers; every node
counts its children, so a dropped survivor takes its branch along, and as soon as all survivors hang below one child of the
root that child's edit is final: it is emitted and forgotten.  Memory so holds the unresolved suffixes only, not the
conversation.  Equally cheap paths into a state are compared over their complete suffixes since they parted.

Spark sorts the rows inside each partition of conversations, a conversation streams through its task row by row, and what needs all
rows of a conversation at once (which texts were said before) is an aggregate over hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of the edits, and the states (what the rows before it were).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_BLANK = r"[\x20\x09-\x0D]"
# From each state: the role that an inserted or reroled row takes, and the state behind it.
_NEXT = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}


@dataclass(eq=False, slots=True)
class Node:
    """One edit on a surviving path; the payload is the repaired row, None for a deletion."""

    parent: Node | None
    letter: str
    row: tuple | None
    depth: int
    children: set[Node] = field(default_factory=set)


class Survivors:
    """The cheapest paths of one conversation, fed row by row; ``step`` and ``end`` return the edits that are now final.

    An edit is (initial, role, text, the row's own extras); ``most`` is the largest number of edits that were open at once.
    """

    def __init__(self) -> None:
        self.root = Node(None, "", None, 0)
        self.best: dict[int, tuple[int, Node]] = {EMPTY: (0, self.root)}
        self._insert()
        self.most = 0

    @staticmethod
    def _before(a: Node, b: Node) -> bool:
        """Whether path a comes first in ASCII order, from the complete letters since the paths parted."""
        x, y = [], []
        while a is not b:
            if a.depth >= b.depth:
                x.append(a.letter)
                a = a.parent
            else:
                y.append(b.letter)
                b = b.parent
        return x[::-1] < y[::-1]

    def _offer(self, best: dict, state: int, cost: int, node: Node) -> None:
        known = best.get(state)
        if known is None or cost < known[0] or cost == known[0] and self._before(node, known[1]):
            best[state] = (cost, node)

    def _insert(self) -> None:
        """Inserted rows between two given ones: two are enough to reach any state."""
        for _ in range(2):
            for state, (cost, node) in list(self.best.items()):
                role, behind = _NEXT[state]
                if behind not in self.best or cost + INSERT <= self.best[behind][0]:
                    self._offer(self.best, behind, cost + INSERT, Node(node, "I", (role, "", None), node.depth + 1))

    def step(self, role: str, text: str, extra: object = None, must_go: bool = False, truncated: bool = False) -> list[tuple]:
        before = list(self.best.items())
        self.best = best = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, node) in before:
            self._offer(best, state, cost + DELETE, Node(node, "D", None, node.depth + 1))
            if must_go:
                continue
            if (behind := _KEPT.get((state, role[:1]))) is not None:
                self._offer(best, behind, cost + KEEP + more, Node(node, "K", (role, text, extra), node.depth + 1))
            other, behind = _NEXT[state]
            self._offer(best, behind, cost + REROLE + more, Node(node, "R", (other, text, extra), node.depth + 1))
        self._insert()
        self._prune()
        return self._settled([n for _, (_, n) in before])

    def _prune(self) -> None:
        """Drop states that another one beats whatever follows.

        Nothing so far, and a whole exchange, can go on like a system row; nothing so far can go on and end like a whole exchange; and
        the latter follows the former by deleting one more row, a system row that the former would keep.
        """
        empty, system, whole = (self.best[s][0] if s in self.best else None for s in (EMPTY, SYSTEM, ASSISTANT))
        if system is not None and any(c is not None and c < system for c in (empty, whole)):
            del self.best[SYSTEM]
        if empty is not None and whole is not None:
            if empty < whole:
                del self.best[ASSISTANT]
            elif whole + DELETE < empty:
                del self.best[EMPTY]

    def _settled(self, before: list[Node]) -> list[tuple]:
        """Hang the survivors' new nodes into the tree, drop the branches without a survivor, emit what all share."""
        alive = {n for _, n in self.best.values()}
        for tip in alive:
            while tip.parent is not None and tip not in tip.parent.children:
                tip.parent.children.add(tip)
                tip = tip.parent
        for tip in before:
            while not tip.children and tip not in alive and tip.parent is not None:
                parent, tip.parent = tip.parent, None
                parent.children.discard(tip)
                tip = parent
        out = []
        while len(self.root.children) == 1 and self.root not in alive:
            child = self.root.children.pop()
            child.parent, self.root = None, child
            out.append(self._edit(child))
        self.most = max(self.most, max(n.depth for n in alive) - self.root.depth)
        return out

    @staticmethod
    def _edit(node: Node) -> tuple:
        return (node.letter, *(node.row or (None, None, None)))

    def end(self) -> tuple[int, list[tuple]]:
        """Cost of the cheapest path that ends well, and its edits that were still open."""
        ends = [self.best[s] for s in (EMPTY, ASSISTANT) if s in self.best]
        cost, node = ends[0]
        for other, tip in ends[1:]:
            if other < cost or other == cost and self._before(tip, node):
                cost, node = other, tip
        rest = []
        while node is not self.root:
            rest.append(self._edit(node))
            node = node.parent
        return cost, rest[::-1]


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``original``, with faults laid by a checksum of ``conv_id:turn``; nulls of any column read as one space.

    Of twenty checksums one drops the row (kept here with ``original`` only, so that no conversation is lost), one empties the text, one takes its full stops, one
    repeats the row, one makes it the user's.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(name), F.lit(20))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("_kind") != 0))
    return rows.withColumn("_kind", kind).select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("present")
    )


def _said(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``again`` (its role and text occur at an earlier turn), in order inside one partition per conversation."""
    rows = rows.withColumn("_said", F.when(F.col("present"), _said(F.col("role"), F.col("text"))))
    turns = rows.where("present").groupBy("conv_id", "_said").agg(
        F.min("turn").alias("_least"), F.max("turn").alias("_most"), F.max(F.col("turn").isNull()).alias("_null")
    )
    again = turns.where("_least < _most OR (_null AND _least IS NOT NULL)").select(
        F.col("conv_id").alias("_conv"), F.col("_said").alias("_same"), F.when(~F.col("_null"), F.col("_least")).alias("_first"), F.lit(True).alias("_met")
    )
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same")), "left")
    told = met.select(
        "conv_id", "turn", "role", "text", "present", F.coalesce(F.col("_met") & ~F.col("turn").eqNullSafe(F.col("_first")), F.lit(False)).alias("again")
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "present")]
    return told.repartition("conv_id").sortWithinPartitions(*order)


class _Conversation:
    """Counts and edits of the conversation that is passing through."""

    def __init__(self, key: object):
        self.key = key
        self.paths = Survivors()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.least = self.most = self.last = None
        self.audit: list[str] = []
        self.digest, self.parts = hashlib.sha256(), 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> list[tuple]:
        if turn is not None and (self.last is None or turn != self.last[0]):
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        seen = again or self.last == (turn, role, text)
        if self.last is not None and self.last[1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last = (turn, role, text)
        said = text.strip(" \t\n\x0b\x0c\r")
        blank = not said
        duplicate = not blank and seen
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        return self._emit(self.paths.step(role, text, turn, blank or duplicate, truncated))

    def _emit(self, edits: list[tuple]) -> list[tuple]:
        for letter, role, text, _ in edits:
            self.audit.append(letter)
            if role is not None:
                self.digest.update(f"\n{role}:{text}".encode("utf-8", "surrogatepass")[0 if self.parts else 1 :])
                self.parts += 1
        return edits

    def end(self) -> list[tuple]:
        self.cost, rest = self.paths.end()
        return self._emit(rest)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, list[tuple], bool]]:
    """Each conversation with the edits that became final, and whether it is over."""
    now = None
    for batch in batches:
        for key, turn, role, text, present, again in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or key != now.key:
                if now is not None:
                    yield now, now.end(), True
                now = _Conversation(key)
            if present:
                yield now, now.add(turn, role, text, again), False
    if now is not None:
        yield now, now.end(), True


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield _batch(some, schema)
            some = []
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _checked(conversations: DataFrame) -> DataFrame:
    """The columns the search reads; other columns are left aside, so their names cannot clash."""
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, present.alias("present"))


def summaries(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its gaps, faults, the cost of its repair, the edits' initials and the digest of the repaired rows.

    Rows are taken by turn, nulls first; rows of one turn by role and text.  A row is blank without a visible character, a duplicate if its
    role and text came earlier, truncated if its last visible character does not end a sentence; its first fault counts.
    Null roles and texts read as one space; rows with a null id are one conversation; a conversation whose rows are all marked
    as not ``present`` has zeros, no edits and the digest of nothing; repeated rows are duplicates; an empty table gives no
    rows; a text of any length is one row and is read whole.

    A conversation of any length passes through one task as a stream, since its digest is one chain over all its rows; that task holds
    the edits not yet final and one letter per row.
    """
    rows = _sorted_rows(_checked(conversations))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} bigint' for c in SUMMARY)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field(0).type, *[pa.int64()] * len(SUMMARY), pa.string(), pa.string()]
        names = ["conv_id", *SUMMARY, "audit", "repaired_sha256"]
        over = (now.row() for now, _, ended in _stream(_again(first, batches)) if ended)
        yield from _batches(over, pa.schema(list(zip(names, types))))

    return rows.mapInArrow(run, schema)


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def repaired(conversations: DataFrame) -> DataFrame:
    """The edits themselves: ``conv_id``, ``place`` (from 0, in order), ``edit`` (K, R, D or I), the source's ``turn``, ``role`` and ``text`` after repair.

    Deleted rows have neither role nor text, inserted ones no turn.  Edits are written as they become final.  Odd rows as in ``summaries``.
    """
    rows = _sorted_rows(_checked(conversations))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for now, edits, _ in _stream(batches):
            first = len(now.audit) - len(edits)
            for place, (letter, role, text, turn) in enumerate(edits, first):
                yield now.key, place, letter, turn, role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fields = [("conv_id", first.schema.field(0).type), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        yield from _batches(each(_again(first, batches)), pa.schema(fields))

    return rows.mapInArrow(run, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string")
