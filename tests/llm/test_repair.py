import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from ledgerloom.llm import repair as R
from ledgerloom.llm.repair import Costs, damage, lightest, repair

SHAPE = re.compile(r"(s?(ua)+)?")
LETTERS = {"suao"[i] + fault[0]: row["suao"[i]] for fault, row in R.LETTERS.items() for i in range(4)}


def by_hand(rows, costs):
    """Cheapest audit, by trying every sequence of edits that isn't dearer than deleting everything. ``rows``: (initial, fault)."""
    best = [(costs.delete * len(rows), "D" * len(rows))]

    def go(at, cost, audit, initials):
        if (cost, audit) > best[0] and cost >= best[0][0] + 1:
            return
        if at == len(rows) and SHAPE.fullmatch(initials):
            best[0] = min(best[0], (cost, audit))
        if cost + costs.insert <= best[0][0]:
            for new in "ua":
                go(at, cost + costs.insert, audit + "I", initials + new)
        if at < len(rows):
            initial, fault = rows[at]
            go(at + 1, cost + costs.delete, audit + "D", initials)
            if fault not in ("blank", "duplicate"):
                more = costs.truncated * (fault == "truncated")
                go(at + 1, cost + more, audit + "K", initials + initial)
                for new in "ua":
                    go(at + 1, cost + costs.rerole + more, audit + "R", initials + new)

    go(0, 0, "", "")
    return best[0]


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 2, 2, 1), Costs(3, 2, 1, 0)])
def test_cheapest_and_least_audit(costs):
    rng = random.Random(7)
    kinds = [(i, f) for i in "suao" for f in R.FAULTS]
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds[::1] + [("u", "fine"), ("a", "fine")] * 6) for _ in range(rng.randint(3, 4))] for _ in range(80)]
    for rows in cases:
        codes = "".join(R.LETTERS[f][i] for i, f in rows)
        want = by_hand(rows, costs)
        assert lightest([codes], costs) == want, rows
        for cut in range(1, len(codes)):
            assert lightest([codes[:cut], codes[cut:]], costs) == want
        assert lightest(list(codes), costs) == want


def test_a_long_conversation_in_segments():
    rng = random.Random(3)
    codes = "".join(rng.choice("sua" * 20 + "oSUAO12345678") for _ in range(3000))
    want = lightest([codes])
    assert lightest([codes[i : i + 64] for i in range(0, len(codes), 64)]) == want
    assert want[0] < 2 * len(codes) and sum(e != "I" for e in want[1]) == len(codes)


def plainly(table):
    """The contract, row by row, for small tables of (conv_id, turn, role, text)."""
    conversations = {}
    for conv, turn, role, text in table:
        rows = conversations.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            h = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            rows += [(turn is not None, turn or 0, role, h, text, turn)] * (2 if kind == 3 else 1)
    out = {}
    solve = lru_cache(None)(lambda rows: by_hand(rows, Costs()))
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: r[:4])
        seen, faults = set(), []
        for _, _, role, _, text, _ in rows:
            visible = re.sub(r"[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "fine")
            seen.add((role, text))
        turns = [r[5] for r in rows if r[5] is not None]
        initials = [r[2][:1] or "?" for r in rows]
        cost, audit = solve(tuple(zip(initials, faults)))
        kept, at, done = [], 0, ""
        for edit in audit:
            next_role = "assistant" if done.endswith("u") else "user"
            if edit == "I":
                kept.append(f"{next_role}:")
                done += next_role[0]
                continue
            role, text = rows[at][2], rows[at][4]
            at += 1
            if edit != "D":
                role = next_role if edit == "R" else role
                done += role[:1]
                kept.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def table(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        at = 0
        for turn in range(rng.randint(1, 6)):
            at += rng.random() < 0.1
            role = rng.choice([("system", "user")[turn > 0], "user", "assistant", ("user", "assistant")[turn % 2], ("user", "assistant")[turn % 2], rng.choice([None, "", "User", "tool", "éa"])])
            text = rng.choice(["Yes.", "Was?  \n", "no end", "", None, " \t\x0b", "Yes.", "a. b! c", "é. ", f"row {rng.random()}!", "𝄞"])
            rows.append((conv, rng.choice([turn + at] * 12 + [None, 2]), role, text))
    return rows


@pytest.mark.parametrize("segment", [2, 4096])
def test_against_the_contract_by_hand(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    rows = table(300, 5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, POS int, audit string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair(damage(df), keep_text=False).collect()}
    want = plainly(rows)
    assert set(got) == {r[0] for r in rows}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_repaired_rows_and_clean_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (2, 0, "user", "One."), (2, 1, "user", "Two."), (2, 2, "assistant", "cut of"), (3, 5, "assistant", "Only.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", 0, "system", "Be kind."), (1, 1, "K", 1, "user", "Hello?"), (1, 2, "K", 2, "assistant", "Hi."), (2, 0, "K", 0, "user", "One."), (2, 1, "R", 1, "assistant", "Two.")]
    got = [tuple(r) for r in repair(df, Costs(rerole=9, delete=9, insert=1, truncated=0)).where("conv_id > 1").orderBy("conv_id", "place").collect()]
    assert got == [(2, 0, "K", 0, "user", "One."), (2, 1, "I", None, "assistant", ""), (2, 2, "K", 1, "user", "Two."), (2, 3, "K", 2, "assistant", "cut of"), (3, 0, "I", None, "user", ""), (3, 1, "K", 5, "assistant", "Only.")]


def test_no_rows_and_one_long_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damage(empty), keep_text=False).count() == 0 and repair(empty).count() == 0
    long = spark.range(20000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('row ', id, '.') text")
    row = repair(long, keep_text=False).head()
    assert (row.gaps, row.duplicate, row.illegal, row.cost, row.audit) == (0, 0, 0, 0, "K" * 20000)
    text = "\n".join(f"{('user', 'assistant')[i % 2]}:row {i}." for i in range(20000))
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
