"""Conversation repair against exhaustive search and a plain reading of the contract."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketlens.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """First fault of each (turn, role, text)."""
    seen, told = set(), []
    for _, role, text in rows:
        kept = text.rstrip(C.BLANKS)
        told.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return told


def cheapest(rows):
    """Least (cost, audit, lines) by search over prefixes of edits: nothing but the grammar is known.
    Words of the grammar's prefixes are tried in order of cost, then audit."""
    wrong = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.match(initials):
            return cost, audit, "\n".join(lines)
        state = (at, initials[-2:], bool(initials))
        if state in done:
            continue
        done.add(state)
        follow = lambda i: any(GRAMMAR.match(initials + i + rest) for rest in ("", "a", "ua"))
        moves = [("I", r[0], 2, f"{r}:", 0) for r in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            moves.append(("D", "", 3, None, 1))
            if wrong[at] not in ("blank", "duplicate"):
                more = wrong[at] == "truncated"
                moves += [("R", r[0], 2 + more, f"{r}:{text}", 1) for r in ("user", "assistant")]
                if role[:1]:
                    moves.append(("K", role[:1], more, f"{role}:{text}", 1))
        for edit, i, c, line, step in moves:
            if not i or follow(i):
                heapq.heappush(heap, (cost + c, audit + edit, at + step, initials + i, lines + ((line,) if line is not None else ())))


def brute(rows):
    """rows of one conversation (turn, role, text) to the contract's row."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    wrong = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, text = cheapest(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def random_rows(draw, n):
    text = lambda: draw.choice(["", " \n", "Yes.", "No!", "cut off", "cut", "Sure? ", "Why?", "é."])
    role = lambda: draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    return [(draw.choice([None, i, i, i, i + 1]), role(), draw.choice([text(), text(), None])) for i in range(n)]


def test_all_short_signatures_are_cheapest():
    automaton = C.Automaton()
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for size in range(5):
        for codes in itertools.product("XsuaoSUAO", repeat=size):
            rows = [(i, role.get(c.lower(), "user"), "" if c == "X" else f"text {i}" + "." * c.islower()) for i, c in enumerate(codes)]
            node = automaton.solve("".join(codes))
            cost, audit, text = cheapest(rows)
            assert (node.cost[0], node.audit[0]) == (cost, audit), codes
            assert "\n".join(C.repaired([r[1] for r in rows], [r[2] for r in rows], audit, 0)[0]) == text


def test_equal_endings_share_nodes():
    automaton = C.Automaton()
    automaton.solve("ua" * 50)
    size = len(automaton.nodes)
    automaton.solve("ua" * 40)
    automaton.solve("sua" + "ua" * 49)
    assert len(automaton.nodes) <= size + 2


@pytest.mark.parametrize("block", [512, 1, 3])
def test_conversations_are_as_defined(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    draw = random.Random(block)
    by_id = {k: random_rows(draw, draw.randint(1, 9)) for k in range(120)} | {None: random_rows(draw, 5), 500: random_rows(draw, 90)}
    rows = [(k, *r, "x") for k, v in by_id.items() for r in v]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").repartition(5)
    told = C.repair(frame)
    assert told.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(told) == {k: brute(v) for k, v in by_id.items()}


def test_one_conversation_over_all_ranges(spark):
    draw = random.Random(9)
    rows = [(7, i // 2, draw.choice(["user", "assistant", "system"]), draw.choice([f"Text {i}.", f"text {i}", "Again.", "again", ""])) for i in range(3000)]
    rows += [(k, 0, "user", "Hi.") for k in range(20)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)
    parts = C.blocks(frame.select(F.concat(F.lit("="), "conv_id").alias("key"), F.col("turn").cast("long"), "role", "text", F.lit(True).alias("present")))
    assert parts.filter("key = '=7'").select("part").distinct().count() >= 6
    told = got(C.repair(frame))
    assert told[7] == brute([r[1:] for r in rows if r[0] == 7])
    assert told[3] == brute([(0, "user", "Hi.")])


def test_a_hot_signature_is_broadcast(spark, monkeypatch):
    from basketlens.llm import common
    monkeypatch.setattr(common, "HOT", 4)
    rows = [(k, t, r, f"{k} {t}.") for k in range(60) for t, r in enumerate(["user", "assistant"])] + [(99, 0, "system", "A."), (98, 0, "tool", "A.")]
    told = got(C.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))
    assert {told[str(k)][5:7] for k in range(60)} == {(0, "KK")}
    assert told["99"][5:7] == (3, "D") and told["98"][5:7] == (3, "D")


def test_damage_and_dropped_conversations(spark, folder):
    rows = [(k, t, r, x) for k in range(60) for t, r, x in [(0, "system", "Be brief."), (1, "user", "Why? Now!"), (2, "assistant", "So.")]]
    rows += [(None, None, None, None), (61, 0, None, "x"), (61, None, "user", None)]
    hurt = {}
    for k, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        r, x = "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        hurt.setdefault(k, []).extend([(t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = got(C.repair(C.damage(frame), present="present"))
    assert told == {k: brute(v) if v else (0,) * 6 + ("", EMPTY) for k, v in hurt.items()}
    gone = C.repair(frame.withColumn("present", F.lit(False)), present="present")
    assert set(got(gone).values()) == {(0,) * 6 + ("", EMPTY)} and gone.count() == 62
    assert C.repair(frame.limit(0)).count() == 0 and C.repair(C.damage(frame.limit(0)), present="present").count() == 0


def test_long_texts_and_repeated_rows(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long + "?"), (1, 1, "assistant", long)] + [(2, 0, "user", "Same.")] * 900
    told = got(C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert told[1] == brute(r[1:] for r in rows[:2])
    assert told[2] == brute(r[1:] for r in rows[2:]) and told[2][2] == 899
