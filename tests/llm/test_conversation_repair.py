"""Repair of conversations against all edits of small ones, and a plain program on the given ones."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SF
from tidemark.llm import conversation_repair as C, queries

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def run(audit, turns):
    """Cost and turns left by an audit, or None where it does not end in a legal conversation."""
    cost, out, last, k = 0, [], "", 0
    for e in audit:
        if e == "I":
            cost, last = cost + 3, NEXT[last]
            out.append((ROLE[last], ""))
            continue
        role, text, fault = turns[k]
        k += 1
        if e == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 3 * (fault == "truncated") + 3 * (e == "R")
        if e == "K":
            if role[:1] == "s" and last or role[:1] in "ua" and role[:1] != NEXT[last] or role[:1] not in ("s", "u", "a"):
                return None
            last = role[:1]
            out.append((role, text))
        else:
            last = NEXT[last]
            out.append((ROLE[last], text))
    return (cost, out) if k == len(turns) and (not out or last == "a") else None


def every_audit(turns):
    gaps = list(product(["", "I", "II", "III"], repeat=len(turns) + 1))
    for edits in product("DKR", repeat=len(turns)):
        for g in gaps:
            yield "".join(a + b for a, b in zip(g, (*edits, ""), strict=True))


def slow_repair(turns):
    found = ((r[0], a) for a in every_audit(turns) if (r := run(a, turns)))
    return min(found)


def plain_repair(turns):
    """Cheapest cost to the end from each (turn, last role), then the least letter that keeps to it."""
    n, most = len(turns), 1 << 60
    rest = [dict.fromkeys(NEXT, most) for _ in range(n + 1)]

    def moves(k, last):
        if k < n:
            role, _, fault = turns[k]
            yield "D", k + 1, last, 4
        yield "I", k, NEXT[last], 3
        if k < n and fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            if role[:1] == NEXT[last] or role[:1] == "s" and not last:
                yield "K", k + 1, role[:1], more
            yield "R", k + 1, NEXT[last], 3 + more

    rest[n] |= {"": 0, "a": 0}
    for k in range(n, -1, -1):
        for _ in range(4):
            for last in NEXT:
                rest[k][last] = min([rest[k][last], *(c + rest[j][q] for _, j, q, c in moves(k, last))])
    k, last, audit, left = 0, "", "", rest[0][""]
    while k < n or left:
        letter, k, last, left = min((e, j, q, left - c) for e, j, q, c in moves(k, last) if c + rest[j][q] == left)
        audit += letter
    return rest[0][""], audit


def fast_repair(turns, modulus=C.MODULUS, settle=C.SETTLE):
    repair = C.Repair(modulus)
    for role, _, fault in turns:
        repair.add(role[:1], ["", "blank", "duplicate", "truncated"].index(fault))
        if repair.turns % settle == 0:
            repair.settle()
    return repair.result()


FAULT = st.sampled_from(["", "", "blank", "duplicate", "truncated"])
ROLES = st.sampled_from(["user", "assistant", "assistant", "system", "tool", ""])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ROLES, st.just("x"), FAULT), max_size=4))
def test_small_conversations_by_all_audits(turns):
    assert fast_repair(turns) == slow_repair(turns) == plain_repair(turns)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, st.just("x"), FAULT), max_size=60), st.sampled_from([7, 3, C.MODULUS]), st.sampled_from([1, 5, 4096]))
def test_long_conversations_with_colliding_hashes_and_settled_prefixes(turns, modulus, settle):
    assert fast_repair(turns, modulus, settle) == plain_repair(turns)


def test_one_role_for_long():
    turns = [("assistant", "x", "")] * 3001
    assert fast_repair(turns) == plain_repair(turns)


def fault_of(text, role, seen):
    words = text.strip(" \t\n\v\f\r")
    found = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
    seen.add((role, text))
    return found


def slow_query(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        elif kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).digest()))
        seen, turns = set(), []
        for _, role, text in found:
            turns.append((role, text, fault_of(text, role, seen)))
        at = [t for t, _, _ in found if t is not None]
        counts = Counter(t[2] for t in turns)
        pairs = ["".join(p) for p in zip([t[0][:1] for t in turns], [t[0][:1] for t in turns[1:]])]
        cost, audit = plain_repair(turns)
        said = "\n".join(f"{r}:{t}" for r, t in run(audit, turns)[1])
        out[conv] = (
            max(at) - min(at) + 1 - len(set(at)) if at else 0,
            *(counts[k] for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            sha256(said.encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_turns():
    rng = random.Random(4)
    texts = ["Yes.", "No", " ", "", None, "é ü?", "line\nend!\n", "So. \t", "x" * 50_000]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    return rows + [(99, k, "assistant", f"part {k}.") for k in range(500)]


@pytest.mark.parametrize("name", ["given", "odd", "none"])
def test_query(spark, tmp_path, name):
    if name == "given":
        sf = SF
    else:
        kind = "conv_id long, turn long, role string, text string, audit string, place string"
        rows = odd_turns() if name == "odd" else []
        sf = str(tmp_path)
        spark.createDataFrame([(*r, "a", "p") for r in rows], kind).repartition(3).write.parquet(f"{sf}/conversations.parquet")
    given_rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == slow_query(given_rows)
    assert len(got) == len({r[0] for r in given_rows})
