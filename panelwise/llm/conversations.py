"""Repair of conversation structure by a checkpointed dynamic programme.

Rows of a conversation are kept, given another role or deleted, and empty rows are inserted, so that
the roles' initials read (s?(ua)+)? at the least cost; of equally cheap edit sequences the one whose
initials come first in ASCII is taken. Four states know what may follow: 0 nothing yet, 1 after s,
2 after u, 3 after a. Backward, a vector holds the cost from each state to the end; forward, only
edits that are tight against the vectors are walked, the ASCII-least first.

Vectors are stored at every square root of n-th row alone and those between are computed again while
walking. Up to a constant they take few values, so that a step is a look-up in a table that fills up
as it is used. Rows are dealt out by range, in order: a conversation of any size divides over tasks,
which exchange one matrix of costs from state to state for each piece, over the driver, at most two
pieces for each partition. Texts do not take part: they are joined to the edits afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read

INFINITE, INSERT, REROLE, DELETE, TRUNCATED = 1 << 50, 3, 3, 4, 3
#: The state after an inserted or reroled row, and after a kept row by initial (s, u, a, other); None where none may stand.
NEXT = (2, 2, 3, 2)
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: Costs to finish from each state after the last row.
FINISH = (0, 2 * INSERT, INSERT, 0)
WHITE = " \t\n\x0b\f\r"
ENDS = [".", "!", "?"]
#: Rows whose texts are put together before a conversation's digest goes on.
BLOCK = 1024
KEY = ["ck", "turn", "role", "t1", "t2"]


class Table:
    """Steps of the programme by look-up. A row's kind is 0 (must go) or 1 + 4 * truncated + initial; vectors are numbered, each with 0 as its least cost."""

    def __init__(self):
        self.vectors, self.number, self.backward, self.forward = [], {}, {}, {}

    def vector(self, costs) -> tuple[int, int]:
        """The number of a vector and the constant taken off."""
        least = min(costs)
        shape = tuple(min(c - least, INFINITE) for c in costs)
        if shape not in self.number:
            self.number[shape] = len(self.vectors)
            self.vectors.append(shape)
        return self.number[shape], least

    @staticmethod
    def choices(kind: int, after, q: int) -> tuple[int, int, int]:
        """Costs of deleting, keeping and reroling a row in state ``q``."""
        extra = TRUNCATED if kind > 4 else 0
        kept = KEPT[q][(kind - 1) % 4] if kind else None
        return DELETE + after[q], INFINITE if kept is None else extra + after[kept], extra + REROLE + after[NEXT[q]] if kind else INFINITE

    def before(self, kind: int, after) -> list[int]:
        """Costs before a row, with insertions, given those after it."""
        bare = [min(self.choices(kind, after, q)) for q in range(4)]
        return [min(bare[q], INSERT + bare[NEXT[q]], 2 * INSERT + bare[NEXT[NEXT[q]]]) for q in range(4)]

    def back(self, kind: int, v: int) -> tuple[int, int]:
        """The vector before a row of this kind, given that after it, and the constant taken off."""
        if (kind, v) not in self.backward:
            self.backward[kind, v] = self.vector(self.before(kind, self.vectors[v]))
        return self.backward[kind, v]

    def step(self, kind: int, q: int, v: int) -> tuple[str, str, int]:
        """Edits up to and with this row's own, the roles that they give (k: its own, d: none), and the state after it."""
        if (kind, q, v) not in self.forward:
            after, edits, roles, at = self.vectors[v], "", "", q
            costs = self.before(kind, after)
            while True:
                delete, keep, rerole = self.choices(kind, after, at)
                if delete == costs[at]:
                    edits, roles = edits + "D", roles + "d"
                    break
                if INSERT + costs[NEXT[at]] == costs[at]:
                    at = NEXT[at]
                    edits, roles = edits + "I", roles + "ssua"[at]
                elif keep == costs[at]:
                    edits, roles, at = edits + "K", roles + "k", KEPT[at][(kind - 1) % 4]
                    break
                else:
                    at = NEXT[at]
                    edits, roles = edits + "R", roles + "ssua"[at]
                    break
            self.forward[kind, q, v] = edits, roles, at
        return self.forward[kind, q, v]

    def matrix(self, kinds: list[int]) -> list[int]:
        """Least costs from each state before the rows to each state after them, row by row of the matrix."""
        columns = []
        for q in range(4):
            v, total = self.vector([0 if q == x else INFINITE for x in range(4)])
            for kind in reversed(kinds):
                v, more = self.back(kind, v)
                total += more
            columns.append([min(c + total, INFINITE) for c in self.vectors[v]])
        return [columns[q][p] for p in range(4) for q in range(4)]

    def walk(self, kinds: list[int], q: int, after) -> Iterator[tuple[str, str, int]]:
        """The step of each row in order. Vectors are kept at every isqrt(n)-th row; a block's are computed again when the walk reaches it."""
        n, (v, _) = len(kinds), self.vector(after)
        size = max(1, isqrt(n))
        points = [v]
        for low in range((n - 1) // size * size, 0, -size):
            for kind in reversed(kinds[low : min(low + size, n)]):
                v = self.back(kind, v)[0]
            points.append(v)
        for low in range(0, n, size):
            block = kinds[low : low + size]
            inside = [points.pop()]
            for kind in reversed(block[1:]):
                inside.append(self.back(kind, inside[-1])[0])
            for kind in block:
                edits, roles, q = self.step(kind, q, inside.pop())
                yield edits, roles, q


def finish(q: int) -> tuple[str, str]:
    """Insertions after the last row, and their roles."""
    edits = roles = ""
    while FINISH[q]:
        q = NEXT[q]
        edits, roles = edits + "I", roles + "ssua"[q]
    return edits, roles


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left after each row's damage by crc32(``conv_id:turn``) % 20, nulls as one space.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("__kind")).filter("__kind <> 0")
    kind = F.col("__kind")
    damaged = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), damaged.alias("text"), F.explode(times).alias("__copy")).drop("__copy")


def conversation_key(conv_id: str | Column = "conv_id") -> Column:
    """A text that tells conversations apart, with one for those without an id."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("ck")


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with nulls as one space, the conversation's key and two hashes of the text."""
    plain = rows.select("conv_id", conversation_key(), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return plain.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


def ordered_rows(rows: DataFrame) -> DataFrame:
    """pid, KEY, n, kind, blank, initial: different rows with the number of their copies, sorted by conversation, turn (null first), role and hashes over partitions in range order.

    Equal rows are counted on the map side, so that copies gather nowhere, and the ranges divide a
    large conversation like any other rows.
    """
    end = F.rtrim("text", F.lit(WHITE))
    initial = F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(0), F.lit("u"), F.lit(1), F.lit("a"), F.lit(2)), F.substring("role", 1, 1)), F.lit(3))
    flags = F.when(end == "", 0).when(F.substring(end, -1, 1).isin(ENDS), 1).otherwise(2)
    each = _keyed(rows).select(*KEY, initial.alias("initial"), flags.alias("end"))
    counted = each.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("initial").alias("initial"), F.max("end").alias("end"))
    firsts = counted.groupBy("ck", "role", "t1", "t2").agg(F.min(F.struct("turn"))["turn"].alias("turn"), F.lit(True).alias("new"))
    a, b = counted.alias("a"), firsts.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    marked = a.join(b, same, "left").select("a.*", F.coalesce("b.new", F.lit(False)).alias("new"))
    kind = F.when((F.col("end") == 0) | ~F.col("new"), 0).otherwise(F.col("end") * 4 - 3 + F.col("initial"))
    light = marked.select(*KEY, "n", kind.alias("kind"), (F.col("end") == 0).alias("blank"), "initial")
    return cut(light.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("pid", F.spark_partition_id().cast("long")))


class Partition:
    """The rows of one partition and where its conversations begin."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        got = list(batches)
        self.size = sum(len(b) for b in got)
        if not self.size:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        self.column = {c: table[c].chunk(0) for c in table.column_names}
        self.pid = self.column["pid"][0].as_py()
        ck = self.column["ck"]
        new = np.asarray(pc.not_equal(ck[1:], ck[:-1]).to_numpy(zero_copy_only=False)) if self.size > 1 else np.zeros(0, bool)
        self.begins = np.flatnonzero(np.concatenate(([True], new))).tolist()
        self.ends = [*self.begins[1:], self.size]
        self.kinds, self.initials = self.column["kind"].to_pylist(), self.column["initial"].to_pylist()

    def run(self, k: int) -> list[int]:
        return self.kinds[self.begins[k] : self.ends[k]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition, with their matrices of costs."""
    p, table = Partition(batches), Table()
    if not p.size:
        return
    ends = sorted({0, len(p.begins) - 1})
    last = p.size - 1
    yield pa.RecordBatch.from_pylist([{"pid": p.pid, "runs": len(p.begins), "ck": p.column["ck"][p.begins[k]].as_py(), "matrix": table.matrix(p.run(k)), "initial": p.initials[last], "turn": p.column["turn"][last].as_py()} for k in ends], schema=pa.schema([("pid", pa.int64()), ("runs", pa.int64()), ("ck", pa.string()), ("matrix", pa.list_(pa.int64())), ("initial", pa.int64()), ("turn", pa.int64())]))


def _borders(light: DataFrame) -> dict[int, dict]:
    """What a partition has to know of others, by pid, where its first conversation began before it or its last one goes on: two rows a partition at most come to the driver."""
    found: dict[int, list] = {}
    for r in light.mapInArrow(_pieces, "pid long, runs long, ck string, matrix array<long>, initial long, turn long").collect():
        found.setdefault(r.pid, []).append(r)
    pids, know, after = sorted(found), {}, None
    for a, b in zip(reversed(pids[:-1]), reversed(pids[1:])):
        if found[a][-1].ck == found[b][0].ck:
            matrix = found[b][0].matrix
            beyond = know.get(b, {}).get("after", FINISH) if found[b][0].runs == 1 else FINISH
            after = [min(matrix[4 * p + q] + beyond[q] for q in range(4)) for p in range(4)]
            know.setdefault(a, {})["after"] = after
            know.setdefault(b, {})["before"] = {"initial": found[a][-1].initial, "turn": found[a][-1].turn}
    if not know:
        return know
    sent = light.sparkSession.sparkContext.broadcast(know)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Partition(batches)
        if p.size and "after" in sent.value.get(p.pid, {}):
            kinds, table, states = p.run(len(p.begins) - 1), Table(), []
            for q in range(4):
                for _, _, state in table.walk(kinds, q, sent.value[p.pid]["after"]):
                    pass
                states.append(state)
            yield pa.RecordBatch.from_arrays([pa.array([p.pid]), pa.array([states], pa.list_(pa.int64()))], names=["pid", "states"])

    states = {r.pid: r.states for r in light.mapInArrow(ends, "pid long, states array<long>").collect()}
    for a, b in zip(pids[:-1], pids[1:]):
        if "before" in know.get(b, {}):
            entered = know[a]["before"]["state"] if found[a][0].runs == 1 and "before" in know[a] else 0
            know[b]["before"]["state"] = states[a][entered]
    return know


def plan_edits(light: DataFrame) -> DataFrame:
    """KEY, place, block, whole, edits, roles, faults, illegal, new_turn of every row of ``ordered_rows``.

    ``edits`` are the initials of the row's edits with insertions before it and, on a conversation's
    last row, after it; ``roles`` and ``faults`` have a letter for each edit (k own role, u, a, d;
    b blank, d duplicate, t truncated, - none). ``illegal`` counts bad neighbours up to the row. A
    ``block`` holds up to ``BLOCK`` rows of a conversation; ``whole`` says that it holds all of them.
    """
    sent = light.sparkSession.sparkContext.broadcast(_borders(light))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, table = Partition(batches), Table()
        if not p.size:
            return
        know, count = sent.value.get(p.pid, {}), p.column["n"].to_pylist()
        blank, turn = p.column["blank"].to_pylist(), p.column["turn"].to_pylist()
        legal = {(0, 1), (1, 2), (2, 1)}
        block, whole = np.zeros(p.size, np.int64), np.zeros(p.size, bool)
        out = {c: [] for c in ("edits", "roles", "faults", "illegal", "new_turn")}
        for k, (low, high) in enumerate(zip(p.begins, p.ends)):
            before = know.get("before") if k == 0 else None
            after = know.get("after") if k == len(p.begins) - 1 else None
            block[low:high] = low + np.arange(high - low) // BLOCK
            whole[low:high] = before is None and after is None and high - low <= BLOCK
            previous, earlier = (before["initial"], before["turn"]) if before else (None, None)
            steps = table.walk(p.kinds[low:high], before["state"] if before else 0, after or FINISH)
            for i, (edits, roles, q) in zip(range(low, high), steps):
                kind, more = p.kinds[i], count[i] - 1
                tail = finish(q) if i == high - 1 and not after else ("", "")
                own = "b" if blank[i] else "d" if kind == 0 else "t" if kind > 4 else "-"
                out["edits"].append(edits + "D" * more + tail[0])
                out["roles"].append(roles + "d" * more + tail[1])
                out["faults"].append("-" * (len(edits) - 1) + own + ("b" if blank[i] else "d") * more + "-" * len(tail[0]))
                out["illegal"].append(more + (previous is not None and (previous, p.initials[i]) not in legal))
                out["new_turn"].append(int(turn[i] is not None and turn[i] != earlier))
                previous, earlier = p.initials[i], turn[i]
        base = np.int64(p.pid) << np.int64(36)
        columns = {c: p.column[c] for c in KEY} | {"place": pa.array(base + np.arange(p.size)), "block": pa.array(base + block), "whole": pa.array(whole)} | {c: pa.array(v, pa.string() if c in ("edits", "roles", "faults") else pa.int64()) for c, v in out.items()}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return light.mapInArrow(run, "ck string, turn long, role string, t1 long, t2 long, place long, block long, whole boolean, edits string, roles string, faults string, illegal long, new_turn long")


def _with_texts(rows: DataFrame) -> DataFrame:
    """The planned edits of every different row beside its conv_id and text. Copies are reduced to one on the map side before texts are shuffled."""
    texts = _keyed(rows).groupBy(*KEY).agg(F.first("conv_id").alias("conv_id"), F.first("text").alias("text"))
    a, b = plan_edits(ordered_rows(rows)).alias("a"), texts.alias("b")
    return a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]).select("a.*", "b.conv_id", "b.text")


def _letters(c: str) -> Column:
    return F.split(c, "")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, place (struct; order inside the conversation), edit (K, R, D, I), role, text, fault of every edit that repairs ``rows`` (conv_id, turn, role, text); without those of edit D the repaired conversations remain.

    ``role`` is the one after the edit. Null roles and texts are one space. Rows go by turn, null
    first; those of one turn by role and then by a hash of their text, and equal rows follow each
    other, the later ones as duplicates. A row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated. Blank and duplicate rows are deleted. Rows without a conv_id are one
    conversation. Extra columns of ``rows`` are left out; an empty table gives an empty result.
    """
    letters = F.arrays_zip(_letters("edits").alias("edit"), _letters("roles").alias("r"), _letters("faults").alias("f"))
    each = _with_texts(rows).select("conv_id", "place", "role", "text", F.posexplode(letters).alias("k", "e"))
    role = F.when(F.col("e.r") == "u", "user").when(F.col("e.r") == "a", "assistant").otherwise(F.col("role"))
    fault = F.when(F.col("e.f") == "b", "blank").when(F.col("e.f") == "d", "duplicate").when(F.col("e.f") == "t", "truncated")
    return each.select("conv_id", F.struct("place", "k").alias("place"), F.col("e.edit").alias("edit"), role.alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"), fault.alias("fault"))


SUMS = ["new_turn", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(rows: DataFrame) -> DataFrame:
    """ck (see ``conversation_key``), gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits), repaired_sha256 (of ``role:text`` of what remains, joined by newlines) for each conversation of ``rows``; see ``repair_conversations``.

    Lines are put together in blocks first. Where a block holds the whole conversation, as nearly all
    do, its hash is the result and no text goes further; of the others one task takes the blocks in
    turn and carries the hash on, holding one block at a time.
    """
    number = lambda c, letter: F.length(c) - F.length(F.translate(c, letter, ""))
    kept = F.zip_with(_letters("edits"), _letters("faults"), lambda e, f: (f == "t") & (e != "D"))
    cost = F.lit(INSERT) * number("edits", "I") + F.lit(REROLE) * number("edits", "R") + F.lit(DELETE) * number("edits", "D") + F.lit(TRUNCATED) * F.size(F.filter(kept, lambda x: x))
    line = lambda e, r: F.when(e == "D", F.lit(None)).otherwise(F.concat(F.when(r == "u", F.lit("user")).when(r == "a", F.lit("assistant")).otherwise(F.col("role")), F.lit(":"), F.when(e == "I", F.lit("")).otherwise(F.col("text"))))
    lines = F.filter(F.zip_with(_letters("edits"), _letters("roles"), line), lambda x: x.isNotNull())
    each = _with_texts(rows).select(
        "ck", "place", "block", "whole", "turn", "edits", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines"),
        "new_turn", number("faults", "b").alias("blank"), number("faults", "d").alias("duplicate"), number("faults", "t").alias("truncated"), "illegal", cost.alias("cost"),
    )
    inner = F.sort_array(F.collect_list(F.struct("place", "edits", "lines")))
    blocks = each.groupBy("ck", "block", "whole").agg(inner.alias("parts"), *[F.sum(c).cast("long").alias(c) for c in SUMS], F.min("turn").alias("low"), F.max("turn").alias("high"))
    text = F.when(F.exists("parts", lambda x: x["lines"].isNotNull()), F.array_join("parts.lines", "\n"))
    joined = blocks.select("ck", "block", "whole", F.array_join("parts.edits", "").alias("edits"), text.alias("text"), *SUMS, "low", "high")
    given, rest = F.when(F.col("whole"), F.sha2(F.coalesce("text", F.lit("")), 256)), F.when(~F.col("whole"), F.col("text"))
    blocks = joined.select("ck", "block", "edits", rest.alias("lines"), given.alias("given"), *SUMS, "low", "high")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = None, []

        def close(x):
            gaps = x["high"] - x["low"] + 1 - x["new_turn"] if x["high"] is not None else 0
            return {"ck": x["ck"], "gaps": gaps, "audit": "".join(x["edits"]), "repaired_sha256": x["given"] or x["sha"].hexdigest()} | {c: x[c] for c in SUMS[1:]}

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(batch.schema.names, values))
                if own is None or own["ck"] != row["ck"]:
                    if own is not None:
                        done.append(close(own))
                    own = {"ck": row["ck"], "edits": [], "sha": hashlib.sha256(), "given": row["given"], "any": False, "low": None, "high": None} | dict.fromkeys(SUMS, 0)
                own["edits"].append(row["edits"])
                if row["lines"] is not None:
                    own["sha"].update(("\n" if own["any"] else "").encode() + row["lines"].encode())
                    own["any"] = True
                for c in SUMS:
                    own[c] += row[c]
                own["low"] = row["low"] if own["low"] is None else own["low"]
                own["high"] = row["high"] if row["high"] is not None else own["high"]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=shape)
                done = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([close(own)], schema=shape)

    names = ["ck", "gaps", *SUMS[1:], "audit", "repaired_sha256"]
    shape = pa.schema([(c, pa.string() if c in ("ck", "audit", "repaired_sha256") else pa.int64()) for c in names])
    schema = ", ".join(f"{c} {'string' if c in ('ck', 'audit', 'repaired_sha256') else 'long'}" for c in names)
    return blocks.repartition("ck").sortWithinPartitions("ck", "block").mapInArrow(digest, schema)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 12 names. A conversation that has lost all its rows has zeros, no audit and the hash of the empty text."""
    whole = read(spark, sf_dir, "conversations")
    report = repair_report(damage(whole))
    convs = whole.select("conv_id").distinct().withColumn("ck", conversation_key())
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    joined = convs.join(report, "ck", "left")
    return joined.select("conv_id", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
