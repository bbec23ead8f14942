"""Conversation repair: the search against all edits by Dijkstra, whole reports against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from flowlens.llm.conversation_repair import (INF, TAIL, TAIL_EDITS, damage, edited_pieces, exit_costs, least_costs,
                                              repair_report, repaired_turns, search)

STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """Least (cost, edits) over (initial, fault) turns, and the roles they give."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, q, given = heapq.heappop(heap)
        if i == len(turns) and q in ("", "a"):
            return cost, edits, given
        if (i, q) in done:
            continue
        done.add((i, q))
        heapq.heappush(heap, (cost + 3, edits + "I", i, NEXT[q], given + ((None, NEXT[q]),)))
        if i < len(turns):
            c, f = turns[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, q, given))
            if f not in "bd":
                cut = 3 if f == "t" else 0
                if c == "" or c in STEP[q]:
                    to = q if c == "" else STEP[q][c]
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, to, given + ((i, None),)))
                heapq.heappush(heap, (cost + cut + 3, edits + "R", i + 1, NEXT[q], given + ((i, NEXT[q]),)))


def report(convs, rows):
    """Plain-Python report over ``rows(conv_id, turn, role, text)``, copies written out."""
    out = []
    for conv in {r[0] for r in convs}:
        mine = sorted((r[1:] for r in rows if r[0] == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}\0{r[2]}".encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "-")
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        turns = [t for t, _, _ in mine if t is not None]
        cost, edits, given = cheapest(list(zip([c if c in "sua" else "x" for c in initials], faults)))
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[role] if role else mine[i][1]}:{'' if i is None else mine[i][2]}" for i, role in given]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(faults.count(f) for f in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def damaged(convs):
    out = []
    for conv, turn, role, text in convs:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_cheapest_then_least_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.randrange(0, 14)
        initials = "".join(rng.choice("suaxe" if seed % 2 else "uuaas") for _ in range(n))
        faults = "".join(rng.choice("-----tbd") for _ in range(n))
        cost, edits, end = search(initials, faults, 0, least_costs(initials, faults, TAIL))
        want = cheapest([("" if c == "e" else c, f) for c, f in zip(initials, faults)])
        assert (cost, edits + TAIL_EDITS[end]) == want[:2]


def test_costs_between_places_are_those_of_the_cheapest_paths():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 8)
        initials = "".join(rng.choice("suaxe") for _ in range(n))
        faults = "".join(rng.choice("---tbd") for _ in range(n))
        got = exit_costs(initials, faults)
        for entry in range(4):
            for at_end in range(4):
                # an exact table of remaining costs, turn by turn from the end
                rest = [0 if q == at_end else INF for q in range(4)]
                for c, f in reversed(list(zip(initials, faults))):
                    new = []
                    for q in range(4):
                        best = 4 + rest[q]
                        if f not in "bd":
                            cut, nxt = 3 * (f == "t"), (2, 2, 3, 2)[q]
                            best = min(best, 3 + cut + rest[nxt])
                            to = q if c == "e" else {"": 0, "s": 1, "u": 2, "a": 3}.get(
                                STEP[["", "s", "u", "a"][q]].get(c, "?"))
                            best = min(best, cut + rest[to] if to is not None else INF)
                        new.append(best)
                    for _ in range(3):
                        new = [min(new[q], 3 + new[(2, 2, 3, 2)[q]]) for q in range(4)]
                    rest = new
                assert (got[4 * entry + at_end] if got[4 * entry + at_end] is not None else INF) == min(rest[entry], INF)


ROLES = ["user", "assistant", "system", "tool", "", None, "User", "unknown"]
TEXTS = ["Yes.", "no", "Fine!", "", " \n", None, "why?", "é…", "long " * 2000 + "."]


def made_up(rng, rows):
    out = []
    for i in range(rows):
        conv = 0 if rng.random() < 0.34 else rng.randrange(1, 30)
        role = ("user", "assistant")[i % 2] if rng.random() < 0.7 else rng.choice(ROLES)
        text = f"turn {i}." if rng.random() < 0.6 else rng.choice(TEXTS)
        out.append((conv, rng.choice([i, i, i, i // 3, None]), role, text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows],
                                 "conv_id long, turn long, role string, text string, edits string, piece long")


@pytest.mark.parametrize("piece", [64, 5])
def test_reports_on_damaged_conversations(spark, piece):
    rows = made_up(random.Random(7), 600)
    rows += rows[:40] + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (77, None, None, None)]
    got = repair_report(frame(spark, rows), damage(frame(spark, rows)), piece)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == report(rows, damaged(rows))


def test_one_conversation_holds_all_rows(spark):
    rng = random.Random(11)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"a{i}", f"b{i}."])) for i in range(3000)]
    got = repair_report(frame(spark, rows), frame(spark, rows).drop("piece", "edits"), 16)
    assert list(map(tuple, got.collect())) == report(rows, rows)


def test_repaired_turns_are_a_chat(spark):
    rows = made_up(random.Random(13), 300)
    turns = repaired_turns(edited_pieces(frame(spark, rows), 8)).orderBy("conv_id", "piece", "place").collect()
    convs = {}
    for r in turns:
        convs.setdefault(r["conv_id"], []).append(r)
    assert convs
    for kept in convs.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in kept))
        assert all(r["text"] == "" for r in kept if r["edit"] == "I")


def test_all_rows_dropped_and_empty_table(spark):
    key = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(key, 0, "user", "gone.")]
    empty = hashlib.sha256().hexdigest()
    got = repair_report(frame(spark, rows), damage(frame(spark, rows))).collect()
    assert list(map(tuple, got)) == [(key, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair_report(frame(spark, []), damage(frame(spark, []))).collect() == []
