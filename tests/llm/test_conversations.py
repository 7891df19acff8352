"""Operator 12 against plain Python."""

import random
import re
import zlib

from panelwise.llm import conversations
from panelwise.llm.conversations import FINISH, Table, damage, op12_conversation_repair, ordered_rows, repair_conversations, repair_report

from .brute import SPACED, sha

AFTER = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
GIVES = {"0": "u", "1": "u", "2": "a", "3": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(kinds):
    """(cost, audit, outputs) of the best edits of rows (fault, initial); the least by cost, then by audit, over all edit sequences."""
    best = {q: (0, "", []) if q in "03" else None for q in "0123"}
    for _ in range(3):
        best = {q: min([x for x in (best[q], ins(best, q)) if x], default=None) for q in "0123"}
    for fault, initial in reversed(kinds):
        extra, new = 3 if fault == "truncated" else 0, {}
        for q in "0123":
            options = [(4 + best[q][0], "D" + best[q][1], ["", *best[q][2]])]
            if fault not in ("blank", "duplicate"):
                if (q, initial) in AFTER:
                    x = best[AFTER[q, initial]]
                    options.append((extra + x[0], "K" + x[1], ["k", *x[2]]))
                x = best[AFTER[q, GIVES[q]]]
                options.append((extra + 3 + x[0], "R" + x[1], [GIVES[q], *x[2]]))
            new[q] = min(options)
        for _ in range(3):
            new = {q: min(new[q], ins(new, q)) for q in "0123"}
        best = new
    return best["0"]


def ins(best, q):
    x = best[AFTER[q, GIVES[q]]]
    return x and (3 + x[0], "I" + x[1], ["+" + GIVES[q], *x[2]])


def report(rows):
    """The digest of one conversation's rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = SPACED.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = cheapest(list(zip(faults, initials)))
    lines, left = [], iter(rows)
    for edit, o in zip(audit, out):
        if edit == "I":
            lines.append(f"{NAMES[o[1]]}:")
            continue
        _, role, text = next(left)
        if edit != "D":
            lines.append(f"{role if o == 'k' else NAMES[o]}:{text}")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def grouped(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0])) for c, x in by.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")


def test_walk_finds_the_least_edits():
    dice = random.Random(12)
    for _ in range(400):
        kinds = [dice.randint(0, 8) for _ in range(dice.randint(1, 9))]
        edits, q = "", 0
        for e, _, q in Table().walk(kinds, 0, FINISH):
            edits += e
        edits += conversations.finish(q)[0]
        want = cheapest([("blank" if k == 0 else "truncated" if k > 4 else "", "suax"[(k - 1) % 4]) for k in kinds])
        assert edits == want[1]
        matrix = Table().matrix(kinds)
        assert min(matrix[q] + FINISH[q] for q in range(4)) == want[0]


def test_odd_rows(spark):
    rows = [(1, 0, "system", "a."), (1, 1, "user", "b?"), (1, 2, "assistant", "c"), (1, 4, "assistant", "c"), (1, 5, "user", ""), (2, None, None, None), (2, None, "user", "x."), (2, 3, "tool", "y!"), (2, 9, "user", "z."), (None, 0, "assistant", "q."), (None, 1, "", "q."), (None, 2, "User", "é ."), (3, 7, "user", None), (4, 0, "user", "\t\n "), (4, 1, "user", "w. \x0b"), (4, 2, "assistant", "w" * 100_000 + "!")]
    df = frame(spark, rows).repartition(3)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {"" if c is None else f"={c}": report(x) for c, x in grouped(sorted(plain, key=lambda r: r[2])).items()}
    assert {r["ck"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair_report(df).collect()} == want
    edits = sorted(repair_conversations(df).filter("conv_id = 1").collect(), key=lambda r: r.place)
    assert "".join(r.edit for r in edits) == want["=1"][6]
    assert [(r.fault, r.edit) for r in edits if r.fault] == [("truncated", "K"), ("duplicate", "D"), ("blank", "D")]
    assert sha("\n".join(f"{r.role}:{r.text}" for r in edits if r.edit != "D")) == want["=1"][7]
    assert repair_report(df.limit(0)).count() == 0 and repair_conversations(df.limit(0)).count() == 0


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    dice = random.Random(5)
    rows = [(1, t, dice.choice(["user", "assistant", "user", "assistant", "system", "tool"]), dice.choice(["", "same.", f"text {t}", f"text {t}.", f"line {t}\nmore!"])) for t in range(700)]
    rows += [(2, t, "user", f"{t}.") for t in range(3)] + [(0, t, "assistant", f"{t}") for t in range(4)]
    rows += [rows[10]] * 50
    df = frame(spark, rows)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 23)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        light = ordered_rows(df)
        pieces = {r[0] for r in light.filter("ck = '=1'").select("pid").distinct().collect()}
        assert len(pieces) > 10
        monkeypatch.setattr(conversations, "BLOCK", 7)
        have = {r["ck"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair_report(df).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert have == {f"={c}": report(x) for c, x in grouped(rows).items()}


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in damage(df).collect()) == sorted(damaged(rows))
    left = grouped(damaged(rows))
    assert got(op12_conversation_repair(spark, path)) == {c: report(left.get(c, [])) for c, *_ in rows}


def test_conversation_that_loses_all_rows(spark, tmp_path):
    key = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(key, 0, "user", "x"), (None, 5, "user", "y."), (None, 6, "assistant", "z.")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    have = got(op12_conversation_repair(spark, str(tmp_path)))
    left = grouped(damaged(rows))
    assert have == {c: report(left.get(c, [])) for c, *_ in rows}
    assert have[key] == (0, 0, 0, 0, 0, 0, "", sha(""))
