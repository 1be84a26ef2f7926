"""Conversation structure repair by signature deduplication.

A conversation's rows are told by one letter each: what its role is and what is
wrong with it.  The letters in order are its signature.  Each distinct signature
is solved once, from its end, with every suffix's answer remembered; the
cheapest edits (the audit) are joined back to all conversations that have it and
replayed over their rows.

Texts move once, to be replayed in the order of their conversation; the first
pass knows them by a digest.  A conversation's rows come to one task as a sorted
stream, of which one batch is held, since its hash has to see its rows in order;
what is held of a whole conversation is its audit, a letter a row, as in the
result.

Rows are ordered by turn (nulls first); ties of a turn by role, then by the
text's MD5, and rows that are equal in all stay neighbours.  Null roles and
texts are one space.  A null ``conv_id`` is a conversation of its own.  An empty
role has no initial, so it has to be edited.  An empty table gives no rows;
other columns than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import meet

#: What an edit costs, and what a kept or rerolled truncated row costs on top.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space of the contract.
SPACE = " \t\n\x0b\x0c\r"

#: Letters of a signature: the role's initial (``o`` for any other), in upper case if truncated, or a row that must go.
GONE = "x"
#: States: nothing yet, after the system row, after a user, after an assistant.  What a role leads to in each.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The one role that may be inserted, or given to a row, in each state.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)

#: Suffixes that a task remembers at most; then it starts afresh.
MEMO = 200_000


def _clean(conversations: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 leaves the row absent, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = _clean(conversations).withColumn("_k", F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20)
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") != 0).alias("present"), "_k")
    twice = d.where("_k = 3")
    return d.unionByName(twice).drop("_k")


def _last(c: Column) -> Column:
    """Last character that isn't white space; empty if there is none."""
    return F.right(F.rtrim(c, F.lit(SPACE)), F.lit(1))


def signatures(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id``: signature, gaps, blank, duplicate, truncated, illegal.

    ``rows`` has conv_id, turn, role, text and present (false: the conversation is there, this row isn't).
    """
    letter = F.left("role", F.lit(1))
    d = rows.select(
        "conv_id",
        "turn",
        "role",
        "present",
        F.unhex(F.md5("text")).alias("digest"),
        _last(F.col("text")).alias("_e"),
        F.when(letter.isin("s", "u", "a"), letter).otherwise("o").alias("_r"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    same = W.partitionBy("conv_id", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    along = W.partitionBy("conv_id", "present").orderBy(*order)
    d = d.repartition("conv_id").withColumn("_again", F.row_number().over(same) > 1)
    d = d.withColumns({"_place": F.row_number().over(along), "_before": F.lag("_r").over(along)})
    fault = F.when(F.col("_e") == "", "blank").when(F.col("_again"), "duplicate").when(~F.col("_e").isin(".", "!", "?"), "truncated")
    d = d.withColumn("_fault", F.when(F.col("present"), fault))
    code = F.when(F.col("_fault").isin("blank", "duplicate"), GONE).when(F.col("_fault") == "truncated", F.upper("_r")).otherwise(F.col("_r"))
    pair = F.concat("_before", "_r")
    d = d.withColumns({"_code": F.when(F.col("present"), code), "_bad": F.col("present") & ~pair.isin("su", "ua", "au"), "turn": F.when(F.col("present"), F.col("turn"))})
    # distinct turns are the places where a turn differs from the last one
    d = d.withColumn("_new", F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(along) == F.col("turn"), F.lit(False)))
    span = F.max("turn") - F.min("turn") + 1 - F.count_if("_new")
    tally = [F.count_if(F.col("_fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    whole = F.expr("coalesce(listagg(_code, '') WITHIN GROUP (ORDER BY _place), '')")
    return d.groupBy("conv_id").agg(whole.alias("signature"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *tally, F.count_if("_bad").alias("illegal"))


class _Solver:
    """Answers for signatures, remembered for each suffix.

    What is known of a suffix is, for each state in front of it, the least cost,
    the order of the states' audits among each other, and the edits before the
    next row.  Two audits differ in the edits up to the next row, or they are
    compared by the audits of the rest; so no audit is written out on the way.
    """

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        ends = []
        for state in START, SYSTEM, USER, ASSISTANT:
            at, audit = state, ""
            while at not in ENDS:
                at, audit = STEPS[at][NEXT[at]], audit + "I"
            ends.append((INSERT * len(audit), audit, 0, audit, at))
        self.empty = self._ranked(ends)
        self.known: dict[tuple[str, int], tuple[int, tuple]] = {}

    @staticmethod
    def _ranked(options: list[tuple]) -> tuple:
        """For each state (cost, rank, edits, state after them), from (cost, edits, rank of the rest, edits, state after)."""
        ranks = {k: r for r, k in enumerate(sorted({o[1:3] for o in options}))}
        return tuple((cost, ranks[edits, rest], edits, after) for cost, edits, rest, _, after in options)

    def _step(self, letter: str, rest: tuple) -> tuple:
        """The answers of a suffix from its first letter and the answers of the rest."""
        options = []
        for state in START, SYSTEM, USER, ASSISTANT:
            found, at = [], state
            for inserted in range(3):  # after two rows the state is one that was there
                edits, cost = "I" * inserted, INSERT * inserted
                found.append((cost + DELETE, edits + "D", at))
                if letter != GONE:
                    more = TRUNCATED if letter.isupper() else 0
                    own = letter.lower()
                    if own in STEPS[at]:
                        found.append((cost + more, edits + "K", STEPS[at][own]))
                    found.append((cost + more + REROLE, edits + "R", STEPS[at][NEXT[at]]))
                at = STEPS[at][NEXT[at]]
            options.append(min((cost + rest[after][0], edits, rest[after][1], edits, after) for cost, edits, after in found))
        return self._ranked(options)

    def solve(self, signature: str) -> tuple[int, str]:
        """The least cost and the audit, the ASCII-least of those at that cost."""
        answer, name, path = self.empty, 0, [self.empty]
        if len(self.known) > MEMO:
            self.forget()
        for letter in reversed(signature):  # a suffix is its first letter and the number of the rest
            if (letter, name) not in self.known:
                if len(self.known) > 2 * MEMO:  # one signature may be longer than that
                    self.known, name = {}, -name - 1
                self.known[letter, name] = (len(self.known) + 1, self._step(letter, answer))
            name, answer = self.known[letter, name]
            path.append(answer)
        audit, state = [], START
        for answer in reversed(path):
            _, _, edits, state = answer[state]
            audit.append(edits)
        return path[-1][START][0], "".join(audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solver = _Solver()
    for batch in batches:
        told = batch.column(0).to_pylist()
        answers = [solver.solve(s) for s in told]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())], ["signature", "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id``: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    told = signatures(rows)
    solved = told.select("signature").distinct().mapInArrow(_solve, "signature string, cost long, audit string")
    return meet(told, solved, ["signature"], F.col("conv_id")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _replay(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Each conversation's head (place 0, audit as text) and after it its repaired rows, in order, in one partition."""
    heads = audit.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), *HEAD)
    d = rows.where("present").select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "text", *(F.lit(None).cast("long").alias(c) for c in HEAD))
    d = heads.unionByName(d).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", F.md5("text"))
    key = rows.schema["conv_id"].dataType

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, last, conv = "", 0, 0, "", None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("row", "conv_id", "place", "edit", "role", "text")}

            def put(k: int | None, edit: str, role: str, text: str) -> None:
                nonlocal place, last
                place, last = place + 1, role[:1]
                for n, v in zip(out, (k, conv, place, edit, role, text), strict=True):
                    out[n].append(v)

            def inserts() -> None:
                nonlocal at
                while audit[at : at + 1] == "I":
                    put(None, "I", "assistant" if last == "u" else "user", "")
                    at += 1

            ids = batch.column(0).to_pylist()
            for k, (kind, role, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if kind == 0:
                    inserts()  # those at the last conversation's end
                    conv, audit, at, place, last = ids[k], text, 0, -1, ""
                    put(k, "", "", text)
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(None, edit, role if edit == "K" else "assistant" if last == "u" else "user", text)
            arrays = [pa.array(out["conv_id"], batch.column(0).type), pa.array(out["place"], pa.int64())] + [pa.array(out[n], pa.string()) for n in ("edit", "role", "text")]
            at_rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(5 + j).take(at_rows) for j in range(len(HEAD))], names)
        out = {n: [] for n in ("place", "edit", "role", "text")}
        while audit[at : at + 1] == "I":
            place, role = place + 1, "assistant" if last == "u" else "user"
            last, at = role[:1], at + 1
            for n, v in zip(out, (place, "I", role, ""), strict=True):
                out[n].append(v)
        if out["place"]:
            n = len(out["place"])
            tail = [pa.array([conv] * n, batch.column(0).type), pa.array(out["place"], pa.int64())] + [pa.array(out[c], pa.string()) for c in ("edit", "role", "text")]
            yield pa.RecordBatch.from_arrays(tail + [pa.nulls(n, pa.int64()) for _ in HEAD], names)

    names = ["conv_id", "place", "edit", "role", "text", *HEAD]
    return d.mapInArrow(replay, f"conv_id {key.simpleString()}, place long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in HEAD))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 1), edit (K, R or I), role, text; a conversation that lost all rows has none."""
    rows = _clean(conversations).withColumn("present", F.lit(True))
    return _replay(rows, audits(rows)).where("place > 0").select("conv_id", "place", "edit", "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and tells for each original ``conv_id`` its faults, audit and the hash of its repaired rows."""
    rows = damage(conversations)
    told = _replay(rows, audits(rows))
    key = rows.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state, begun = None, None, False
        for batch in batches:
            done = []
            for k, (place, role, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if place == 0:
                    if head is not None:
                        done.append((*head, state.hexdigest()))
                    head, state, begun = (batch.column(0)[k].as_py(), *(batch.column(5 + j)[k].as_py() for j in range(len(HEAD))), text), hashlib.sha256(), False
                else:
                    state.update(f"{'\n' if begun else ''}{role}:{text}".encode())
                    begun = True
            yield told_as(done, batch)
        if head is not None:
            yield told_as([(*head, state.hexdigest())], batch)

    def told_as(done: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.column(0).type, *[pa.int64()] * len(HEAD), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in done], t) for j, t in enumerate(kinds)], ["conv_id", *HEAD, "audit", "repaired_sha256"])

    return told.mapInArrow(hashed, f"conv_id {key}, " + ", ".join(f"{c} long" for c in HEAD) + ", audit string, repaired_sha256 string")
