import hashlib
import itertools
import random
import zlib

import pytest

from tidewatch.llm import queries, turn_repair
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def after_damage(rows):
    """conv_id -> its rows after the damage, by turn, role and digest; dropped rows leave their conversation behind."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest())
    return {conv: sorted(held, key=order) for conv, held in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By widening from left to right over what has been said so far; an independent, quadratic search."""
    def fits(said):
        rest = said[1:] if said[:1] == "s" else said
        return rest == ("ua" * len(rest))[: len(rest)]

    def closed(states):
        todo = list(states)
        while todo:
            said = todo.pop()
            for more in "ua":
                # what was said matters by its last sign, its first, and whether it began
                new, cost = said + more, (states[said][0] + 3, states[said][1] + "I", states[said][2] + [(more, "")])
                short = brief(new)
                if fits(new) and (short not in states or cost[:2] < states[short][:2]):
                    states[short] = cost
                    todo.append(short)
        return states

    def brief(said):
        head, rest = ("s", said[1:]) if said[:1] == "s" else ("", said)
        return head + ("ua"[: 2 - len(rest) % 2] if rest else "")

    states = closed({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for said, (cost, audit, lines) in states.items():
            options = [(said, cost + 4, audit + "D", lines)]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if fits(said + role[:1]) and role[:1] in ("s", "u", "a") and (role[0] != "s" or not said):
                    options.append((said + role[0], cost + more, audit + "K", [*lines, (role, text)]))
                for sign in "ua":
                    if fits(said + sign):
                        options.append((said + sign, cost + 3 + more, audit + "R", [*lines, (sign, text)]))
            for said2, cost2, audit2, lines2 in options:
                said2 = brief(said2)
                if said2 not in new or (cost2, audit2) < new[said2][:2]:
                    new[said2] = (cost2, audit2, lines2)
        states = closed(new)
    ends = [v for said, v in states.items() if not said or said[-1] == "a"]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    return cost, audit, [({"u": "user", "a": "assistant"}.get(r, r), t) for r, t in lines]


def expected(rows):
    out = {}
    for conv, held in after_damage(rows).items():
        turns = [t for t, *_ in held if t is not None]
        found = faults(held)
        signs = [r[:1] for _, r, _ in held]
        cost, audit, lines = cheapest(held)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("b"), found.count("d"), found.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(signs, signs[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def answers(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_all_short_patterns_by_trying_all_edits():
    """Every audit that gives a fitting conversation, for every pattern of up to three rows."""
    for n in range(4):
        for codes in itertools.product(["u ", "a ", "s ", ". ", "ub", "ad", "st", "at"], repeat=n):
            best = None
            for steps in itertools.product("KRD", repeat=n):
                for inserts in itertools.product(range(3), repeat=n + 1):
                    cost, audit, kept = 3 * sum(inserts), "", ["?" * inserts[0]]
                    audit += "I" * inserts[0]
                    for k, (code, step) in enumerate(zip(codes, steps)):
                        if step != "D" and code[1] in "bd":
                            break
                        cost += {"K": 0, "R": 3, "D": 4}[step] + (3 if code[1] == "t" and step != "D" else 0)
                        audit += step + "I" * inserts[k + 1]
                        kept.append({"K": code[0], "R": "?", "D": ""}[step] + "?" * inserts[k + 1])
                    else:
                        said = "".join(kept)
                        if len(said) < 8 and any(fitting(said, p) for p in ("", "ua", "uaua", "uauaua", "s", "sua", "suaua", "suauaua")):
                            best = min(best or (cost, audit), (cost, audit))
            cells = turn_repair.cell_of("".join(codes))
            got = min(cells[q] for q in turn_repair.FINAL if cells[q])
            assert got == best, (codes, got, best)


def fitting(said, pattern):
    if pattern == "s":
        return False
    return len(said) == len(pattern) and all(a == b or a == "?" and b != "s" for a, b in zip(said, pattern))


@pytest.mark.parametrize("span", [turn_repair.SPAN, 3])
def test_repair_equals_brute_force(spark, span):
    rng, rows = random.Random(5), []
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    for conv in range(60):
        for turn in range(rng.randrange(1, 40)):
            text = rng.choice(["Yes.", "No", " \n", "Why?", None, "über.\t", "a\nb!", f"t{turn}."])
            role = roles[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    rows += [(77, k, "user" if k % 2 == 0 else "assistant", f"line {k}.") for k in range(700)]
    rows += [(78, 3, "user", "same.")] * 40 + [(None, 1, "user", "hi."), (None, None, None, None), (-9, None, "system", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert answers(turn_repair.repair_damaged(df, span)) == expected(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_turn_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert answers(got) == expected(rows)


def test_repaired_conversations(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c"), (2, 0, "system", "x."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turn_repair.repaired(turn_repair.whole(df)).orderBy("conv", "place").collect()
    said = [(r.conv, r.place, r.role, r.text) for r in got]
    assert said[:2] == [("1", 0, "user", "a."), ("1", 1, "assistant", "b.")] or said[0][2] == "user"
    assert not any(r.conv == "3" for r in got)
    for conv in ("1", "2"):
        signs = "".join(r.role[0] for r in got if r.conv == conv)
        assert signs.removeprefix("s") == "ua" * (len(signs) // 2)


def test_edges(spark):
    names = ["conv", "at", "rows", "digest", "code", "head", "place", "copies", "audit"]
    schema = "conv_id long, turn int, role string, text string, " + ", ".join(f"{c} string" for c in names)
    rows = [(1, 5, "user", "x" * 200_000 + ".", *names), (1, 5, "user", "x" * 200_000 + ".", *names), (None, None, None, None, *names)]
    df = spark.createDataFrame(rows, schema)
    assert answers(turn_repair.repair_damaged(df)) == expected([r[:4] for r in rows])
    empty = turn_repair.repair_damaged(df.where("1 = 0"))
    assert empty.count() == 0 and empty.schema["conv_id"].dataType.simpleString() == "bigint"
    # a conversation all of whose rows are dropped stays as a row
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id long, turn int, role string, text string")
    assert answers(turn_repair.repair_damaged(one)) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
