"""Repair of conversations: the lightest derivation of a valid turn order, found by Knuth's agenda.

Rows are judged without their texts, numbered over all of the table by a range
sort, and gathered into segments of a bounded number of rows. A segment's spans
(state before, state after) are derived in parallel; spans are the edges by which
a conversation's prefix grows. Only a letter a row is ever held for a whole
conversation. Texts travel once, to be written out or digested in order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import spread, with_position

from .common import small_batches

SEGMENT = 4096
#: States of a prefix: nothing yet, a system turn, an open user turn, a closed exchange.
START, SYSTEM, OPEN, CLOSED = "0sua"
STATES = START + SYSTEM + OPEN + CLOSED
GOAL = "goal"
_AFTER_S, _AFTER_U, _AFTER_A = {START: SYSTEM}, {START: OPEN, SYSTEM: OPEN, CLOSED: OPEN}, {OPEN: CLOSED}
_MOVES = {"s": _AFTER_S, "u": _AFTER_U, "a": _AFTER_A}
_NAMES = {"u": "user", "a": "assistant"}
#: A row's letter: the class of its role (system, user, assistant, other) by its fault.
FAULTS = ("fine", "blank", "duplicate", "truncated")
LETTERS = {f: dict(zip("suao", row)) for f, row in zip(FAULTS, ("suao", "1234", "5678", "SUAO"))}
_READ = {letter: (role, fault) for fault, row in LETTERS.items() for role, letter in row.items()}
_INITIALS = str.maketrans({letter: role for letter, (role, _) in _READ.items()})
LEGAL = frozenset(("su", "ua", "au"))
SPACES = r"[\x20\x09-\x0D]"


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def agenda(axioms: dict, edges, goal) -> tuple | None:
    """Knuth's generalisation of Dijkstra's algorithm over a weighted hypergraph.

    ``axioms`` holds items and their values; ``edges(item)`` gives the deductions
    that an item allows, as (new item, function of its value). Values are (cost,
    audit) pairs in their natural order. Every function here adds a cost of at
    least zero and letters at the end, so it is superior: its result is never below
    what it is applied to. It keeps the order of values of one item too: audits of
    one item are spelled in a prefix code of one word a row, so two of them differ
    before either ends. So the least item of the agenda is final when popped.
    """
    heap = [(value, item) for item, value in axioms.items()]
    heapq.heapify(heap)
    final: dict = {}
    while heap:
        value, item = heapq.heappop(heap)
        if item in final:
            continue
        final[item] = value
        if item == goal:
            break
        for to, function in edges(item):
            if to not in final:
                heapq.heappush(heap, (function(value), to))
    return final if goal is None else final.get(goal)


def _then(cost: int, word):
    return lambda value: (value[0] + cost, value[1] + word)


def _row_edges(letter: str, state: str, costs: Costs) -> Iterator[tuple[str, int, str]]:
    """State after, cost and word of each way to deal with a row: at most one insertion, then an edit.

    Two insertions in a row are never cheapest before a row: they could go, or wait for the end.
    """
    role, fault = _READ[letter]
    extra = costs.truncated if fault == "truncated" else 0
    befores = [(state, 0, "")] + [(to, costs.insert, "I") for move in (_AFTER_U, _AFTER_A) if (to := move.get(state))]
    for at, cost, word in befores:
        yield at, cost + costs.delete, word + "D"
        if fault in ("blank", "duplicate"):
            continue
        if to := _MOVES.get(role, {}).get(at):
            yield to, cost + extra, word + "K"
        for move in (_AFTER_U, _AFTER_A):
            if to := move.get(at):
                yield to, cost + costs.rerole + extra, word + "R"


@lru_cache(maxsize=1 << 15)
def spans(codes: str, costs: Costs) -> tuple:
    """For each state before a segment the states after it, ordered by audit: (state before, state after, cost, audit)."""
    out = []
    for before in STATES:
        def edges(item):
            at, state = item
            return [((at + 1, to), _then(cost, word)) for to, cost, word in _row_edges(codes[at], state, costs)] if at < len(codes) else []

        final = agenda({(0, before): (0, "")}, edges, None)
        ends = sorted((value[1], state, value[0]) for (at, state), value in final.items() if at == len(codes))
        out += [(before, state, cost, audit) for audit, state, cost in ends]
    return tuple(out)


def _ends(costs: Costs) -> dict:
    return {START: (0, ""), CLOSED: (0, ""), OPEN: (costs.insert, "I"), SYSTEM: (2 * costs.insert, "II")}


@lru_cache(maxsize=1 << 15)
def _whole(codes: str, costs: Costs) -> tuple[int, str]:
    def edges(item):
        at, state = item
        if at == len(codes):
            return [((at + 1, GOAL), _then(*_ends(costs)[state]))]
        return [((at + 1, to), _then(cost, word)) for to, cost, word in _row_edges(codes[at], state, costs)]

    return agenda({(0, START): (0, "")}, edges, (len(codes) + 1, GOAL))


def lightest(segments: list[str], costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation given as the letters of its segments.

    Prefix items (segments read, state) are joined with span items of the next
    segment. There a span's letter is its rank among the audits from the same
    state: audits are compared by rank and written out for the chosen path only.
    """
    if len(segments) <= 1:
        return _whole(segments[0] if segments else "", costs)
    ranked: list[dict] = []
    for codes in segments:
        rows: dict = {}
        for before, after, cost, _ in spans(codes, costs):
            rows.setdefault(before, []).append((after, cost))
        ranked.append(rows)

    def edges(item):
        at, state = item
        if at == len(segments):
            return [((at + 1, GOAL), _then(_ends(costs)[state][0], b""))]
        return [((at + 1, to), _then(cost, bytes([rank]))) for rank, (to, cost) in enumerate(ranked[at][state])]

    cost, path = agenda({(0, START): (0, b"")}, edges, (len(segments) + 1, GOAL))
    state, parts = START, []
    for at, codes in enumerate(segments):
        rank = path[at]
        after = ranked[at][state][rank][0]
        parts.append(next(audit for before, to, _, audit in spans(codes, costs) if (before, to) == (state, after)))
        state = after
    return cost, "".join(parts) + _ends(costs)[state][1]


def plan_of(audit: str, codes: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """Each edit of an audit and the role it leaves (None: the row's own, or no row)."""
    state, letters = START, iter(codes)
    for edit in audit:
        letter = None if edit == "I" else next(letters)
        if edit == "D":
            yield edit, None
        elif edit == "K":
            state = _MOVES[_READ[letter][0]][state]
            yield edit, None
        else:
            state = CLOSED if state == OPEN else OPEN
            yield edit, _NAMES[state]


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with faults put in by crc32(`conv:turn`) mod 20: 0 drops the row, 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls count as one space. ``dropped`` rows stay, marked, so that
    a conversation of which nothing is left is still known."""
    space = F.lit(" ")
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rows = df.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy"))


def _letter(fault: Column, role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    out = None
    for name, row in LETTERS.items():
        for k, letter in row.items():
            out = F.when((fault == name) & (kind == k), letter) if out is None else out.when((fault == name) & (kind == k), letter)
    return out


_ORDER = ["conv_id", "turn", "role", "h", "copy"]


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, seg, the letters of its rows in order, first and last turn and the number of different turns.

    The numbering is a range sort of rows without texts, so a long conversation is
    dealt over several tasks. Rows seen earlier are those behind the least position
    of their (conversation, role, text); a hash of 128 bits stands for the text.
    """
    visible = F.regexp_replace("text", SPACES, "")
    slim = rows.where(~F.col("dropped")).select(
        "conv_id", "turn", "role", F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")).alias("h"), "copy",
        (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("cut"))
    placed = with_position(slim, _ORDER)
    seen = placed.groupBy("conv_id", "h", spread("conv_id", "h")).agg(F.min("pos").alias("_seen")).drop("_spread")
    p = placed.join(seen.toDF("_c", "_h", "_seen"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h"))).drop("_c", "_h")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("_seen"), "duplicate").when(F.col("cut"), "truncated").otherwise("fine")
    p = p.select("conv_id", F.floor(F.col("pos") / SEGMENT).alias("seg"), "pos", "turn", _letter(fault, F.col("role")).alias("letter"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return p.groupBy("conv_id", "seg").agg(
        F.array_join(F.transform(ordered, lambda r: r["letter"]), "").alias("codes"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turns"))


class Report(NamedTuple):
    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str


def judge(parts: list[tuple[str, int | None, int | None, int]], costs: Costs = Costs()) -> Report:
    """Faults and cheapest repair of a conversation from its segments (letters, least and greatest turn, number of turns)."""
    codes = "".join(p[0] for p in parts)
    initials = codes.translate(_INITIALS)
    known = [p for p in parts if p[1] is not None]
    turns = sum(p[3] for p in known) - sum(a[2] == b[1] for a, b in zip(known, known[1:]))
    blank, duplicate, truncated = (sum(codes.count(c) for c in LETTERS[f].values()) for f in FAULTS[1:])
    cost, audit = lightest([p[0] for p in parts], costs)
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return Report(known[-1][2] - known[0][1] + 1 - turns if known else 0, blank, duplicate, truncated, illegal, cost, audit)


def repair(rows: DataFrame, costs: Costs = Costs(), keep_text: bool = True) -> DataFrame:
    """Repair conversations by the cheapest edits that leave ``(s?(ua)+)?`` of role initials.

    ``rows``: conv_id, turn, role, text, and optionally dropped (the row only makes
    its conversation known) and copy; other columns are not looked at. Rows of a
    conversation stand by turn, nulls first, then by role, by a hash of role and
    text, and by copy. Keep costs nothing, Rerole, Delete and Insert what ``costs``
    says; blank and duplicate rows must be deleted; truncated rows that stay cost
    more. Of equal costs the audit that is least in ASCII wins. A null role or text
    is one space; an empty role has no initial, so its row can't be kept as it is; a null
    conversation id is a conversation; no rows give no rows.

    With ``keep_text`` a row for each turn of the repaired conversations: conv_id,
    place, edit (K, R or I), turn, role, text. Without, one for each conversation:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, over the turns as ``role:text`` joined by line feeds.

    Texts are dealt by conversation and read in order as a stream, behind the
    segments' letters, so a task holds a letter a row of one conversation and never
    its texts. A digest has to be taken in one task, as SHA-256 has no other way.
    """
    spark = rows.sparkSession
    small_batches(spark)
    names = {c.lower() for c in rows.columns}
    dropped = F.col("dropped") if "dropped" in names else F.lit(False)
    copy = F.col("copy") if "copy" in names else F.lit(0)
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), dropped.alias("dropped"), copy.alias("copy"))
    nothing = F.lit(None)
    # kind 0: the conversation is there; 1: letters of a segment; 2: a row with its text.
    letters = segments(rows).select(
        "conv_id", F.lit(1).alias("kind"), "seg", nothing.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"), F.lit(0).alias("copy"), F.col("codes").alias("text"), "least", "most", "turns")
    texts = rows.select(
        "conv_id", F.when(F.col("dropped"), 0).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("seg"), "turn", "role",
        F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")).alias("h"), "copy", F.when(~F.col("dropped"), F.col("text")).alias("text"),
        nothing.cast("long").alias("least"), nothing.cast("long").alias("most"), nothing.cast("long").alias("turns"))
    stream = letters.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "seg", "turn", "role", "h", "copy")
    stream = stream.select("conv_id", "kind", "turn", "role", "text", "least", "most", "turns")
    if keep_text:
        schema = "conv_id long, place long, edit string, turn long, role string, text string"
    else:
        schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    types = [pa.int64() if part.split()[1] == "long" else pa.string() for part in schema.split(", ")]
    fields = [part.split()[0] for part in schema.split(", ")]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=fields)

    def run(batches):
        held, size = [], 0
        entries = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv_id, of_conversation in groupby(entries, key=lambda r: r[0]):
            parts, report, edits, place, sha = [], None, None, 0, hashlib.sha256()

            def out(edit, turn, role, text):
                nonlocal place, size
                if keep_text:
                    held.append((conv_id, place, edit, turn, role, text))
                    size += len(text)
                else:
                    sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                place += 1

            for _, kind, turn, role, text, least, most, turns in of_conversation:
                if kind == 0:
                    continue
                if kind == 1:
                    parts.append((text, least, most, turns))
                    continue
                if edits is None:
                    report = judge(parts, costs)
                    edits = plan_of(report.audit, (c for p in parts for c in p[0]))
                edit, new = next(edits)
                while edit == "I":
                    out(edit, None, new, "")
                    edit, new = next(edits)
                if edit != "D":
                    out(edit, turn, new or role, text)
                if size > 1 << 22:
                    yield batch(held)
                    held, size = [], 0
            for edit, new in edits or ():
                out(edit, None, new, "")
            if not keep_text:
                held.append((conv_id, *(report or Report(0, 0, 0, 0, 0, 0, "")), sha.hexdigest()))
                size += 64 + len(report.audit if report else "")
            if size > 1 << 22 or len(held) >= 8192:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return stream.mapInArrow(run, schema)
