import hashlib
import itertools
import random
import re
import zlib

import pytest

from slopefield.llm import conversation_repair as C
from slopefield.session import session_settings

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, code int"
TEXTS = ["Yes.", "no end", "  ", "", "Why?", None, "A. B.", "Yes."]
ROLES = ["user", "assistant", "system", "tool", None, "user", "assistant"]
LAWFUL = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\f\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("none" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """Every sequence of edits whose roles follow the pattern, two insertions in a row at most."""
    best = None
    inserts = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for added in inserts:
            mine = lines + [(r, "") for r in added]
            so_far = cost + 5 * len(added), audit + "I" * len(added)
            if not re.match(r"(s?(ua)*u?)$", "".join(r[:1] or "-" for r, _ in mine)):
                continue
            if i == len(turns):
                if LAWFUL.fullmatch("".join(r[:1] or "-" for r, _ in mine)):
                    found = *so_far, mine
                    if best is None or found[:2] < best[:2]:
                        best = found
                continue
            _, _, role, text = turns[i]
            go(i + 1, so_far[0] + 2, so_far[1] + "D", mine)
            if faults[i] in ("blank", "duplicate"):
                continue
            more = 5 if faults[i] == "truncated" else 0
            go(i + 1, so_far[0] + more, so_far[1] + "K", [*mine, (role, text)])
            for given in ("user", "assistant"):
                go(i + 1, so_far[0] + more + 1, so_far[1] + "R", [*mine, (given, text)])

    go(0, 0, "", [])
    return best


def brute_force(rows):
    out = {}
    damaged = after_damage(rows)
    for conv in {r[0] for r in rows}:
        turns = [r for r in damaged if r[0] == conv]
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        faults = faults_of(turns)
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(turns, turns[1:])]
        cost, audit, lines = cheapest(turns, faults)
        whole = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (
            gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(whole.encode()).hexdigest(),
        )
    return out


def digests(df):
    found = C.repair_digests(df, C.repair(C.damaged(df))).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


def some_rows(rng, conversations, most):
    rows = []
    for conv in range(conversations):
        turns = rng.sample(range(12), rng.randint(1, most))
        nulls = [None] if rng.random() < 0.3 else []
        for turn in turns + nulls:
            rows.append((conv, turn, rng.choice(ROLES), rng.choice(TEXTS)))
    rows += [(None, 3, "user", "Null conversation."), (None, 4, "assistant", "Yes.")]
    return rows


@pytest.mark.parametrize("spread", [False, True])
def test_damage_and_repair_against_all_edits(spark, table_of, spread):
    rows = some_rows(random.Random(3), 60, 4)
    df = table_of([(*r, 1, 1, 1) for r in rows], SCHEMA)
    with session_settings(
        spark, **{"spark__sql__adaptive__coalescePartitions__enabled": str(not spread).lower()}
    ):
        assert digests(df) == brute_force(rows)


def test_conversation_over_many_tasks_equals_one_walk(spark, table_of):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(ROLES[:4]), f"{rng.choice(['a.', 'b', 'c!'])} {t % 90}.") for t in range(900)]
    df = table_of([(*r, 1, 1, 1) for r in rows], SCHEMA)
    with session_settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        found = C.repair(df)
        parts = {r.pos >> 33 for r in found.turns.select("pos").collect()}
        kept = [tuple(r) for r in C.repaired_turns(found).orderBy("place").collect()]
    assert len(parts) > 3
    faults = faults_of(rows)
    number = {"none": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    codes = bytes(C.INITIALS.get(r[2][:1], 0) + 4 * number[f] if r[2] else 0 for r, f in zip(
        [(a, b, c or " ", d) for a, b, c, d in rows], faults))
    _, edits, _ = C.walk(codes, C.END, C.START)
    mine = "".join(r.edit for r in found.edits.orderBy("pos").collect())
    assert mine == "".join(edits)
    assert LAWFUL.fullmatch("".join(r[3][:1] for r in kept))
    assert len(kept) == sum(e != "D" for e in mine)


def test_segments_cost_what_the_whole_costs():
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(2, 60)))
        cut = rng.randint(1, len(codes) - 1)
        whole, kept = C.checkpoints(codes, C.END)
        assert len(kept) <= len(codes) // C.block_length(len(codes)) + 1
        behind = C.checkpoints(codes[cut:], C.END)[0]
        assert whole == C.before_segment(C.transfer(codes[:cut]), behind)
        state, first, _ = C.walk(codes[:cut], behind, C.START, last=False)
        rest = C.walk(codes[cut:], C.END, state)[1]
        assert first + rest == C.walk(codes, C.END, C.START)[1]


def test_long_texts_repeated_rows_and_other_columns(table_of):
    long = "word " * 40_000 + "end."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long[:-1]), (1, 3, "assistant", long)]
    rows += [(2, 1, "user", "Same."), (2, 1, "user", "Same."), (3, None, None, None)]
    df = table_of([(*r, 9, 9, 9) for r in rows], SCHEMA)
    assert digests(df) == brute_force(rows)


def test_no_conversations(table_of):
    assert digests(table_of([], SCHEMA)) == {}
