"""Conversation structure repair with a suffix-shared automaton of signatures.

A turn's signature is one symbol: the initial of its role, whether its text is truncated, or that
it must go (blank, or a duplicate). Signatures are read from the end: a node of the automaton is a
suffix, interned by (symbol, node of the rest), so conversations share the nodes of equal endings.
Each node holds, for each state of the role grammar ``(s?(ua)+)?``, the cost to reach the end, the
audit (initials of the cheapest edits, ties to the least string) and the state in which the block ends;
they are computed when the node is made. From one state no two edits of different roles share an initial, so
the least audit follows from the least initial at each step, and roles follow from the audit.

Scale: turns are split by ranges of (conversation, turn, role, text, number), so a conversation
of any size is spread over tasks, and cut into blocks of at most ``BLOCK_ROWS`` turns or ``BLOCK_BYTES``.
A conversation of one block is answered by its signature: distinct signatures, ordered by their
reversed form, are solved once for the whole table and joined back, the frequent ones by broadcast.
Others are finished block by block: names of their turns find duplicates across ranges, a backward
pass carries the grammar's costs from block to block, a forward pass carries state and digest. Both
passes stream; nothing of a conversation's length is ever held but its audit, which is one value of
the result. Only the digest is sequential by definition.

Defined results: null roles and texts are one blank; a null conversation is one; null turns come
first and do not count for gaps; turns of equal number are taken by role, then text, then repeats; an empty role has
no initial and fits no state; a conversation whose turns are all dropped has counts of 0, an empty audit and the digest of
the empty text; very long texts and conversations are handled whole; an empty table stays empty; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import hot_join, stored, width

BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
OUT_ROWS = 200  # records handed back to the engine at a time
NODE_CHARS = 32 << 20  # audits a task's automaton holds before it starts afresh
PREFIX = 256  # characters of a text that order turns of equal number and role
# The grammar. States: nothing yet, after s, after u, after a; initials that lead on.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = ("u", "u", "a", "u")  # the role that a state lets in by insertion or change of role
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # fixed values: costs
FAR = 1 << 60
MUST_GO = "X"
BLANKS = " \t\n\x0b\x0c\r"

BLOCK = pa.schema([("key", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("alone", pa.bool_()), ("codes", pa.string()),
                   ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()),
                   ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                   ("first", pa.string()), ("last", pa.string()), ("names", pa.list_(pa.binary()))])
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
TOLD = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
SOLVED = pa.schema([("codes", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
SWEPT = pa.schema([("key", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("cost", pa.int64()),
                   ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])


class Node:
    """Per grammar state: cost to the end, audit, state at the end of the block."""

    __slots__ = ("cost", "audit", "exit")

    def __init__(self, cost: list[int], audit: list[str], exit_: list[int]):
        self.cost, self.audit, self.exit = cost, audit, exit_


class Automaton:
    """Nodes of the suffixes seen, interned."""

    def __init__(self):
        self.nodes: dict[tuple, Node] = {}
        self.chars = 0

    def end(self, costs: tuple[int, ...] | None) -> Node:
        """The end of a conversation, or of a block before which the rest costs ``costs``."""
        if (node := self.nodes.get(("end", costs))) is None:
            if costs is None:
                node = self.inserted([0, FAR, FAR, 0], ["", "", "", ""], [0, 1, 2, 3])
            else:
                node = Node(list(costs), [""] * 4, [0, 1, 2, 3])
            self.nodes["end", costs] = node
        return node

    @staticmethod
    def inserted(cost: list[int], audit: list[str], exit_: list[int]) -> Node:
        """Adds insertions before what follows; where equal, the lesser initial wins."""
        best = list(cost)
        for _ in range(3):
            best = [min(c, INSERT + best[NEXT[q][TURN[q]]]) for q, c in enumerate(best)]
        node = Node(best, [""] * 4, [0] * 4)
        waiting = []
        for q in range(4):
            if best[q] == cost[q] and (INSERT + best[NEXT[q][TURN[q]]] > best[q] or audit[q][:1] < "I"):
                node.audit[q], node.exit[q] = audit[q], exit_[q]
            else:
                waiting.append(q)
        while waiting:  # what an insertion leads to is known before it
            for q in list(waiting):
                if (to := NEXT[q][TURN[q]]) not in waiting:
                    node.audit[q], node.exit[q] = "I" + node.audit[to], node.exit[to]
                    waiting.remove(q)
        return node

    def before(self, symbol: str, rest: Node) -> Node:
        """The node of ``symbol`` followed by ``rest``."""
        cost, audit, exit_ = [], [], []
        role, extra = symbol.lower(), 0 if symbol.islower() else TRUNCATED
        for q in range(4):
            options = [(DELETE + rest.cost[q], "D", q)]
            if symbol != MUST_GO:
                if (to := NEXT[q].get(role)) is not None:
                    options.append((extra + rest.cost[to], "K", to))
                to = NEXT[q][TURN[q]]
                options.append((REROLE + extra + rest.cost[to], "R", to))
            least, edit, to = min(options)
            cost.append(least)
            audit.append(edit + rest.audit[to])
            exit_.append(rest.exit[to])
        return self.inserted(cost, audit, exit_)

    def solve(self, codes: str, costs: tuple[int, ...] | None = None) -> Node:
        if self.chars > NODE_CHARS:
            self.nodes.clear()
            self.chars = 0
        node = self.end(costs)
        for symbol in reversed(codes):
            key = (symbol, id(node))
            if (known := self.nodes.get(key)) is None:
                known = self.nodes[key] = self.before(symbol, node)
                self.chars += sum(map(len, known.audit)) + 400
            node = known
        return node


def fault(text: str) -> str:
    """What a text lacks by itself: ``blank``, ``truncated`` or nothing."""
    kept = text.rstrip(BLANKS)
    return "blank" if not kept else "" if kept[-1] in ".!?" else "truncated"


def symbol_of(role: str, truncated: bool) -> str:
    role = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return role.upper() if truncated else role


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], int]:
    """Lines ``role:text`` that the edits leave of a block, and the state after it."""
    lines, at = [], 0
    for edit in audit:
        if edit == "K":
            lines.append(f"{roles[at]}:{texts[at]}")
            state = NEXT[state][roles[at][:1]]
        elif edit != "D":
            role = TURN[state]
            lines.append(f"{ROLES[role]}:{texts[at] if edit == 'R' else ''}")
            state = NEXT[state][role]
        at += edit != "I"
    return lines, state


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


class Cutter:
    """Cuts the sorted turns of one range into blocks."""

    def __init__(self, part: int):
        self.part, self.key, self.blk, self.first_key = part, None, 0, True

    def fresh(self) -> None:
        self.codes, self.roles, self.texts, self.names, self.size = [], [], [], [], 0
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.first = None

    def begin(self, key: str) -> None:
        self.key, self.seen, self.turn, self.last, self.blocks = key, set(), None, None, 0
        self.fresh()

    def close(self, more: bool) -> tuple:
        """``more``: the conversation may have other blocks."""
        many = more or self.first_key or self.blocks > 0
        c = self.count
        row = (self.key, self.part, self.blk, not many, "".join(self.codes), self.roles, self.texts, c["blank"], c["duplicate"], c["truncated"],
               c["illegal"], c["turns"], self.low, self.high, self.first, self.last, self.names if many else None)
        self.blk += 1
        self.blocks += 1
        self.fresh()
        return row

    def add(self, turn: int | None, role: str, text: str) -> None:
        name = blake2b(f"{role}\0{text}".encode(), digest_size=16).digest()
        wrong = fault(text)
        if wrong != "blank" and name in self.seen:
            wrong = "duplicate"
        if wrong:
            self.count[wrong] += 1
        gone = wrong in ("blank", "duplicate")
        self.codes.append(MUST_GO if gone else symbol_of(role, wrong == "truncated"))
        self.names.append(None if gone else name)
        self.seen.add(name)
        if self.last is not None:
            self.count["illegal"] += self.last + role[:1] not in LEGAL
        if self.first is None:
            self.first = role[:1]
        self.last = role[:1]
        if turn is not None:
            self.count["turns"] += turn != self.turn
            self.turn, self.low, self.high = turn, turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (key, turn, role, text, present) to blocks."""
    cutter, out = Cutter(TaskContext.get().partitionId()), []
    for batch in batches:
        for key, turn, role, text, present in zip(*[c.to_pylist() for c in batch.columns]):
            if key != cutter.key:
                if cutter.key is not None:
                    out.append(cutter.close(False))
                    cutter.first_key = False
                cutter.begin(key)
            elif len(cutter.codes) >= BLOCK_ROWS or cutter.size >= BLOCK_BYTES:
                out.append(cutter.close(True))
            if present:
                cutter.add(turn, role, text)
            if len(out) >= OUT_ROWS or cutter.size >= BLOCK_BYTES:
                yield batch_of(BLOCK, out)
                out = []
    if cutter.key is not None:
        out.append(cutter.close(True))
    yield batch_of(BLOCK, out)


def blocks(rows: DataFrame) -> DataFrame:
    """Turns (key, turn, role, text, present) in ranges, cut into blocks, written."""
    start, digest = F.substring("text", 1, PREFIX), F.xxhash64("text")
    order = ["key", F.col("turn").asc_nulls_first(), "role", "start", "digest", "number"]
    tagged = rows.withColumns({"start": start, "digest": digest, "number": F.monotonically_increasing_id()})
    split = tagged.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(split.select("key", "turn", "role", "text", "present").mapInArrow(cut, from_arrow_schema(BLOCK)), "turns")


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        codes = batch.column(0).to_pylist()
        nodes = [automaton.solve(c) for c in codes]
        yield batch_of(SOLVED, [(c, n.cost[0], n.audit[0]) for c, n in zip(codes, nodes)])


def solved(single: DataFrame) -> DataFrame:
    """``codes, times, cost, audit`` of each distinct signature; equal endings meet in one task."""
    distinct = single.groupBy("codes").agg(F.count("*").alias("times"))
    ends = F.reverse("codes")
    ordered = distinct.select("codes", ends.alias("ends")).repartitionByRange(width(single.sparkSession), "ends").sortWithinPartitions("ends")
    return stored(ordered.select("codes").mapInArrow(solve, from_arrow_schema(SOLVED)).join(distinct, "codes"), "signatures")


def gaps_of(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that are whole conversations, with cost and audit, to results."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            lines, _ = repaired(r["roles"], r["texts"], r["audit"], 0)
            out.append((r["key"], gaps_of(r["low"], r["high"], r["turns"]), r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"],
                        r["audit"], sha256("\n".join(lines).encode()).hexdigest()))
        yield batch_of(TOLD, out)


def undoubled(parts: DataFrame) -> DataFrame:
    """Blocks whose turns that occur in an earlier range are marked as duplicates. Within a range
    they are known, so a name comes at most once per range."""
    place = ["part", "blk", "pos"]
    names = parts.select("key", "part", "blk", F.posexplode("names").alias("pos", "name")).filter("name IS NOT NULL")
    first = names.groupBy("key", "name").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = names.join(first, ["key", "name"]).filter(F.struct(*place) > F.col("first"))
    late = late.groupBy("key", "part", "blk").agg(F.collect_set("pos").alias("late"))  # at most BLOCK_ROWS
    marked = parts.join(late, ["key", "part", "blk"], "left").withColumn("late", F.coalesce("late", F.array().cast("array<int>")))
    symbols = F.split("codes", "")
    here = lambda i: F.array_contains("late", i)
    return marked.withColumns({
        "codes": F.when(F.size("late") == 0, F.col("codes")).otherwise(F.array_join(F.transform(symbols, lambda c, i: F.when(here(i), F.lit(MUST_GO)).otherwise(c)), "")),
        "truncated": F.col("truncated") - F.size(F.filter(symbols, lambda c, i: here(i) & (c == F.upper(c)) & (c != "") & (c != MUST_GO))),
        "duplicate": F.col("duplicate") + F.size("late")}).drop("late", "names")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, part, blk, codes), each conversation's last one first: what each costs from here to
    its end, and its audit and last state for every state it may begin in."""
    automaton, before, carried, total = Automaton(), None, None, 0
    for batch in batches:
        out = []
        for key, part, blk, codes in zip(*[c.to_pylist() for c in batch.columns]):
            if key != before:
                before, carried, total = key, None, 0
            node = automaton.solve(codes, carried)
            out.append((key, part, blk, total + node.cost[0], node.audit, node.exit))
            least = min(node.cost)
            total += least
            carried = tuple(c - least for c in node.cost)  # only differences matter: few distinct ends
        yield batch_of(SWEPT, out)


class Joined:
    """One conversation's result so far, its blocks added in order."""

    def __init__(self, key: str, cost: int):
        self.key, self.state, self.digest, self.begun, self.audit = key, 0, sha256(), False, []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last = self.part = None
        self.cost = cost

    def add(self, r: dict) -> None:
        for name in self.count:
            self.count[name] += r[name]
        if r["part"] != self.part:  # counted by ranges that do not know each other
            self.count["illegal"] += None not in (self.last, r["first"]) and self.last + r["first"] not in LEGAL
            self.count["turns"] -= r["low"] is not None and r["low"] == self.high
        self.part = r["part"]
        self.last = self.last if r["last"] is None else r["last"]
        self.low = r["low"] if self.low is None else self.low
        self.high = self.high if r["high"] is None else r["high"]
        audit = r["audits"][self.state]
        lines, state = repaired(r["roles"], r["texts"], audit, self.state)
        if lines:
            self.digest.update(("\n" * self.begun + "\n".join(lines)).encode())
            self.begun = True
        self.state = state
        self.audit.append(audit)

    def row(self) -> tuple:
        c = self.count
        return (self.key, gaps_of(self.low, self.high, c["turns"]), c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost,
                "".join(self.audit), self.digest.hexdigest())


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, with their sweep, to one result a conversation."""
    current, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if current is None or r["key"] != current.key:
                if current is not None:
                    out.append(current.row())
                current = Joined(r["key"], r["cost"])
            current.add(r)
        yield batch_of(TOLD, out)
        out = []
    yield batch_of(TOLD, [current.row()] if current else [])


def of_many_blocks(parts: DataFrame) -> DataFrame:
    """Results of conversations that may have several blocks; every task streams sorted blocks."""
    parts = stored(undoubled(parts), "turns-long")
    wide = width(parts.sparkSession)
    back = parts.select("key", "part", "blk", "codes").repartition(wide, "key").sortWithinPartitions("key", F.desc("part"), F.desc("blk"))
    swept = stored(back.mapInArrow(sweep, from_arrow_schema(SWEPT)), "turns-swept")
    both = parts.join(swept, ["key", "part", "blk"]).repartition(wide, "key").sortWithinPartitions("key", "part", "blk")
    return both.mapInArrow(gather, from_arrow_schema(TOLD))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row per conversation: ``conv`` and ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Rows where the boolean column ``present`` is false only name their conversation."""
    kind = rows.schema[conv].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    cut_up = blocks(rows.select(key.alias("key"), F.col(turn).cast("long").alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"), here.alias("present")))
    single = cut_up.filter("alone")
    answered = hot_join(single, solved(single), ["codes"], "times")
    told = answered.select("key", "roles", "texts", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit").mapInArrow(tell, from_arrow_schema(TOLD))
    told = told.unionAll(of_many_blocks(cut_up.filter("NOT alone")))
    back = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias(conv)
    return told.select(back, *COUNTS, "audit", "repaired_sha256")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, present``: rows damaged as the digest of their key says, for measuring
    repairs. A dropped row stays with ``present`` false."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")), F.lit(20))
    words = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(part(text), ".!?", "")).otherwise(part(text))
    who = F.when(kind == 4, F.lit("user")).otherwise(part(role))
    hurt = rows.select(F.col(conv), F.col(turn), who.alias(role), words.alias(text), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return hurt.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_time")
