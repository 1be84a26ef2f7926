"""Conversation repair against a plain version of its contract."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows, most):
    """All edit sequences with at most ``most`` inserts between rows, the cheapest and then the least one."""
    @functools.lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        goes = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserts:
            found += [(c + 2, "I" + a) for r in "ua" if r in goes for c, a in [best(i, r, inserts - 1)] if c is not None]
        if i < len(rows):
            role, fault = rows[i]
            more = fault == "truncated"
            c, a = best(i + 1, state, most)
            found += [(c + 3, "D" + a)] if c is not None else []
            if fault not in ("blank", "duplicate"):
                found += [(c + more, "K" + a) for c, a in [best(i + 1, role[:1], most)] if c is not None] if role[:1] and role[:1] in goes else []
                found += [(c + more + 2, "R" + a) for r in "ua" if r in goes for c, a in [best(i + 1, r, most)] if c is not None]
        return min(found) if found else (None, None)

    for i in reversed(range(len(rows))):  # so that no call goes deep
        for state in "", *"sua":
            best(i, state, most)
    return best(0, "", most)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def repaired(conv):
    """What op12 tells of one conversation, from its original rows (conv_id, turn, role, text)."""
    name = lambda v: " " if v is None else str(v)
    rows = []
    for conv_id, turn, role, text in conv:
        role, text = name(role), name(text)
        k = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    rows = [r[1:] for r in rows]
    fault = faults(rows)
    cost, audit = cheapest([(r, f) for (r, _), f in zip(rows, fault, strict=True)], 3)
    out, left = [], list(rows)
    for edit in audit:
        fix = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((fix, ""))
        else:
            role, text = left.pop(0)
            out += [] if edit == "D" else [(role if edit == "K" else fix, text)]
    assert LEGAL.match("".join(r[:1] for r, _ in out)) and not left
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: fault.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def check(df):
    convs = {}
    for r in df.collect():
        convs.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    got = conversations.digest(df).collect()
    assert len(got) == len(convs)
    for r in got:
        r = r.asDict()
        assert r == {"conv_id": r["conv_id"], **repaired(convs[r["conv_id"]])}
    return got


def test_signatures_are_solved_as_by_trying_all():
    solver = conversations._Solver()
    told = {"x": "blank"} | {c: "truncated" for c in "SUAO"}
    rng = random.Random(7)
    some = [t for n in range(4) for t in itertools.product("suaoSUAOx", repeat=n)]
    some += [tuple(rng.choice("suaoSUAxuaua") for _ in range(rng.randint(4, 12))) for _ in range(500)]
    for letters in some:
        assert solver.solve("".join(letters)) == cheapest([(c.lower(), told.get(c)) for c in letters], 3), letters


def test_what_is_remembered_is_bounded(monkeypatch):
    rng = random.Random(2)
    long = ["".join(rng.choice("suaoSUAx") for _ in range(3000)) for _ in range(3)]
    want = [conversations._Solver().solve(s) for s in long]
    monkeypatch.setattr(conversations, "MEMO", 100)
    solver = conversations._Solver()
    assert [solver.solve(s) for s in long] == want
    assert len(solver.known) <= 201


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    got = check(spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet"))
    assert {"K", "R", "D", "I"} <= set("".join(r.audit for r in got))
    for fault in ("gaps", "blank", "duplicate", "truncated", "illegal"):
        assert any(r[fault] for r in got), fault


def test_awkward_rows(spark):
    """Nulls in all columns, empty and very long texts and conversations, ties, repeated rows, clashing and dotted columns."""
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "system", "S."), (1, None, "user", None), (2, 0, "", ""), (2, 5, "assistant", " \t\n"), (3, 1, "user", "é" * 200_000), (3, 2, "assistant", "Yes? ")]
    rows += [(4, 1, "user", "Same.")] * 3 + [(4, 1, "assistant", "Other."), (4, 1, "user", "And.")] + [(5, 2**40, "tool", "x."), (5, -3, "User", "x.")]
    rows += [(6, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", f"{t}!"])) for t in range(700)]
    rows += [(7 + t, 0, "user", "Gone.") for t in range(60)]
    kind = "conv_id long, turn long, role string, text string, audit string, `place` int, `a.b` string, present boolean"
    check(spark.createDataFrame([(*r, "x", 1, "y", False) for r in rows], kind))
    assert conversations.digest(spark.createDataFrame([], kind)).collect() == []
    # conversations without a row left are told as well
    lost = [r for r in conversations.digest(spark.createDataFrame([(*r, "x", 1, "y", False) for r in rows], kind)).collect() if not r.audit]
    assert lost and {r.repaired_sha256 for r in lost} == {hashlib.sha256(b"").hexdigest()}


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes"), (2, 0, "assistant", "Hello."), (3, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in conversations.repair(df).collect())
    assert got == [(1, 1, "K", "user", "Hi."), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "There."), (1, 4, "K", "assistant", "Yes"), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Hello.")]
