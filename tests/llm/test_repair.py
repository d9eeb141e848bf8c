"""Repairs against a search through all edits, and against a plain chain for long conversations."""

import hashlib
import random
import re
from zlib import crc32

import pytest

from tallyloom.llm import repair
from tallyloom.llm.queries import QUERIES, damaged

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, cost string, piece int"


def plain_faults(rows):
    """'blank', 'duplicate', 'truncated' or None of each (role, text)."""
    made = []
    for i, (role, text) in enumerate(rows):
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        made.append("blank" if not said else "duplicate" if (role, text) in rows[:i] else "truncated" if said[-1] not in ".!?" else None)
    return made


def every_repair(rows, faults):
    """All edits with their costs, audits and results, by trying everything: few rows only."""

    def go(i, start):
        for n in range(3) if start else (0,):
            for added in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]) if n == 0 else ():
                pre = [(5, "I", (r, "")) for r in added]
                if i == len(rows):
                    yield pre
                    continue
                role, text = rows[i]
                ways = [(2, "D", None)]
                if faults[i] not in ("blank", "duplicate"):
                    extra = 5 * (faults[i] == "truncated")
                    ways += [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]
                for way in ways:
                    for rest in go(i + 1, True):
                        yield [*pre, way, *rest]

    for edits in go(0, True):
        kept = [e[2] for e in edits if e[2]]
        if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in kept)):
            yield sum(e[0] for e in edits), "".join(e[1] for e in edits), "\n".join(f"{r}:{t}" for r, t in kept)


def plain_chain(rows, faults):
    """The cheapest (cost, audit, text) by carrying, for each last initial, all cheapest audits' least; backward, so that ties are decided by the whole audit."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", []), "a": (0, "", []), "u": (5, "I", [("assistant", "")]), "s": (10, "II", [("user", ""), ("assistant", "")])}
    for (role, text), fault in zip(reversed(rows), reversed(faults)):
        here = {}
        for state in nexts:
            choices = [(ways[state][0] + 2, "D" + ways[state][1], ways[state][2])]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] and role[:1] in nexts[state]:
                    c, a, k = ways[role[:1]]
                    choices.append((c + extra, "K" + a, [(role, text), *k]))
                for to in nexts[state].replace("s", ""):
                    c, a, k = ways[to]
                    choices.append((c + 1 + extra, "R" + a, [(names[to], text), *k]))
            here[state] = min(choices, key=lambda x: x[:2])
        for _ in range(3):
            for state in nexts:
                for to in nexts[state].replace("s", ""):
                    c, a, k = here[to]
                    here[state] = min(here[state], (c + 5, "I" + a, [(names[to], ""), *k]), key=lambda x: x[:2])
        ways = here
    cost, audit, kept = ways[""]
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)


def plain_row(conv, rows, solve=plain_chain):
    """``rows``: (turn, role, text) after the damage, in any order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    said = [(r, t) for _, r, t in order]
    faults = plain_faults(said)
    turns = [n for n, _, _ in order if n is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
    cost, audit, text = solve(said, faults)
    return (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)


def plain(rows, damage=False):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(plain_damage(conv, turn, role, text) if damage else [(turn, " " if role is None else role, " " if text is None else text)])
    return sorted((plain_row(c, r) for c, r in convs.items()), key=lambda r: (r[0] is not None, r[0] or 0))


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_chain_equals_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b.", "c", "d!", " "])) for _ in range(rng.randint(0, 3))]
        faults = plain_faults(rows)
        assert plain_chain(rows, faults) == min(every_repair(rows, faults), key=lambda x: x[:2])


def test_costs_equal_plain_chain():
    rng, costs = random.Random(6), repair.Costs()
    for _ in range(500):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"{i if rng.random() < 0.8 else 0}" + rng.choice(["", ".", ". "])) for i in range(rng.randint(0, 40))]
        rows = [(r, t if rng.random() < 0.9 else " ") for r, t in rows]
        faults = plain_faults(rows)
        codes = bytes(repair.code({"blank": 2, "duplicate": 2, "truncated": 1, None: 0}[f], r[:1]) for (r, _), f in zip(rows, faults))
        vectors, total = costs.vectors(codes, costs.last())
        letters, state = costs.trace(codes, vectors, repair.NOTHING)
        letters.append(costs.end(state))
        made = repair.apply(letters, [{"role": r, "text": t} for r, t in rows], repair.NOTHING)
        assert (total + vectors[0][repair.NOTHING], "".join(letters), "\n".join(f"{t['role']}:{t['text']}" for t in made)) == plain_chain(rows, faults)


def talk(rng, conv, n):
    roles = ["user", "assistant"]
    rows = []
    for i in range(n):
        role = roles[i % 2] if rng.random() < 0.85 else rng.choice(["system", "user", "assistant", "tool", None])
        text = rng.choice([f"text {i}.", f"text {rng.randint(0, 30)}!", f"cut {i}", "", None, "\t\n"]) if rng.random() < 0.5 else f"Said {i}?"
        rows.append((conv, i if rng.random() < 0.9 else None if rng.random() < 0.2 else i + rng.randint(0, 3), role, text))
    return rows


@pytest.mark.parametrize("most", [1, 3, 7, 4096])
def test_slices_give_what_the_whole_gives(spark, most):
    rng = random.Random(most)
    rows = [r for c, n in enumerate([300, 1, 0, 2, 41, 90, 5, 7, 8, 200]) for r in talk(rng, c, n)] + talk(rng, None, 25)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = repair.summary(repair.repair(docs, slice_rows=most))
    assert by_id(got.collect()) == plain(rows)


def test_costs_that_never_converge(spark):
    """Perfect turns, whose last one is in doubt to the first row: fix-up passes go through all slices."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(64)]
    got = repair.summary(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), slice_rows=4))
    assert by_id(got.collect()) == plain(rows)


def test_repaired_rows_are_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "cut"), (1, 3, "user", "So?")]
    (got,) = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(t) for t in got.turns] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "So?")] and (got.audit, got.cost) == ("KRDR", 4)


def test_op12_equals_plain(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(QUERIES["op12_conversation_repair"](spark, folder).collect()) == plain(rows, damage=True)


def test_damage_of_odd_rows(spark):
    rng = random.Random(9)
    rows = [r for c in range(40) for r in talk(rng, c, rng.randint(1, 6))] + [(c, None, "user", "Alone.") for c in range(100, 160)] + [(7, 3, "user", "long. " * 300_000)] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert by_id(repair.summary(repair.repair(damaged(frame), here="here")).collect()) == plain(rows, damage=True)
    assert repair.summary(repair.repair(frame.limit(0))).collect() == []
