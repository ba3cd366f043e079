"""Repair of the structure of conversations: the cheapest edits that make turns alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.auction import ENDING, STATES, USER, cheapest, costs, initial_code
from mlwatch.operators.frames import settled

PIECE_ROWS = 64
PIECE_CHARS = 1 << 20
BLANK = r"[\x20\x09-\x0D]"
KEPT = r"[^\x20\x09-\x0D]"
LEGAL = {"su", "ua", "au"}
ROLES = {"user": "user:", "assistant": "assistant:"}
KEY = "conv struct<id:{0}>, part int, no int"


def faults(text: Column, again: Column) -> Column:
    """0 none, 1 truncated, 2 duplicate, 3 blank: the first that a row has, in the order blank, duplicate, truncated."""
    ended = text.rlike(rf"[.!?]{BLANK}*\z")
    return F.when(~text.rlike(KEPT), 3).when(again, 2).when(~ended, 1).otherwise(0)


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, again): settled, in order over partitions and within them, equal rows together.

    ``again`` says that role and text stood in an earlier turn. The first turn of each role and text is found by
    sums within tasks; equal turns are ordered by role and text, and a row equal to the one before it is seen by the reader.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.withColumn("said", said)
    first = keyed.groupBy("conv", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    joined = keyed.join(first, ["conv", "said"])
    again = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")) > F.col("first")
    known = joined.select("conv", "turn", "role", "text", again.alias("again"))
    # the driver gets a sample of what rows are dealt by, so no whole texts
    dealt = known.repartitionByRange(parts, "conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64))
    return settled(dealt.sortWithinPartitions("conv", "turn", "role", "text"))


def pieces(rows: DataFrame, kind: str) -> DataFrame:
    """(conv, part, no, codes, faults, roles, texts): the ordered rows of a conversation, so many at a time, and whole texts."""
    schema = f"{KEY.format(kind)}, codes binary, blank long, duplicate long, truncated long, roles array<string>, texts array<string>"
    read = rows.select("conv", F.spark_partition_id().alias("part"), "role", "text", "again", F.col("turn").cast("string").alias("turn"), faults(F.col("text"), F.col("again")).alias("fault"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int]] = []
        conv, part, before, no, chars = None, 0, None, 0, 0

        def piece() -> pa.RecordBatch:
            codes = bytes(initial_code(role[:1]) + STATES * min(fault, 2) for role, _, fault in held)
            values = [conv, part, no, codes, *[sum(f == k for _, _, f in held) for k in (3, 2, 1)], [r for r, _, _ in held], [t for _, t, _ in held]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        types: list[pa.DataType] = []
        names = ["conv", "part", "no", "codes", "blank", "duplicate", "truncated", "roles", "texts"]
        for b in batches:
            types = [b.schema.field("conv").type, pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 3, *[pa.list_(pa.string())] * 2]
            columns = [b.column(c).to_pylist() for c in ("conv", "part", "turn", "role", "text", "fault")]
            for c, p, turn, role, text, fault in zip(*columns, strict=True):
                if held and (c != conv or len(held) >= PIECE_ROWS or chars > PIECE_CHARS):
                    yield piece()
                    held, chars, no = [], 0, no + 1 if c == conv else 0
                if c != conv:
                    no = 0
                    before = None
                if (turn, role, text) == before and fault < 3:
                    fault = 2
                conv, part, before = c, p, (turn, role, text)
                held.append((role, text, fault))
                chars += len(text)
        if held:
            yield piece()

    return settled(read.mapInArrow(run, schema))


def later_costs(cut: DataFrame, kind: str) -> DataFrame:
    """(conv, part, no, after): for each piece, what the rest of its conversation costs at least, by the state after the piece.

    The costs through pieces are found side by side; only they are then added up from a conversation's end to its start,
    one piece in memory at a time. A null is a state with no way to the end.
    """

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [[c if c < inf else None for row in costs(codes) for c in row] for codes in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv", "part", "no")], pa.array(tables, pa.list_(pa.float64()))], ["conv", "part", "no", "table"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after = None, []
        for b in batches:
            out = []
            for c, table in zip(b.column("conv").to_pylist(), b.column("table").to_pylist(), strict=True):
                if c != conv:
                    conv, after = c, [cost for cost, _ in ENDING]
                out.append([x if x < inf else None for x in after])
                through_ = [inf if x is None else x for x in table]
                after = [min(through_[STATES * s + t] + after[t] for t in range(STATES)) for s in range(STATES)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv", "part", "no")], pa.array(out, pa.list_(pa.float64()))], ["conv", "part", "no", "after"])

    tables = cut.select("conv", "part", "no", "codes").mapInArrow(through, f"{KEY.format(kind)}, table array<double>")
    dealt = tables.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("no"))
    return dealt.mapInArrow(backwards, f"{KEY.format(kind)}, after array<double>")


def edited(held: list[tuple[str, str]], edits: str, state: int) -> tuple[list[str], int]:
    """The lines that edits leave of rows of role and text, and the state after them."""
    lines, rows = [], iter(held)
    for edit in edits:
        then = "assistant" if state == USER else "user"
        if edit == "I":
            lines.append(ROLES[then])
            state = initial_code(then[0])
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        role = role if edit == "K" else then
        lines.append(f"{role}:{text}")
        state = initial_code(role[:1])
    return lines, state


def repaired(cut: DataFrame, kind: str) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    Pieces pass in order, one in memory at a time; of a conversation the digest, the sums and the audit are kept.
    """
    schema = f"conv struct<id:{kind}>, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, cost, last, digest, audit, sums, any_line = None, 0, 0, None, hashlib.sha256(), [], [0] * 4, False
        out: list[list] = []

        def add(lines: list[str]) -> None:
            nonlocal any_line
            if lines:
                digest.update(("\n" * any_line + "\n".join(lines)).encode())
                any_line = True

        def close() -> None:
            audit.append(ENDING[state][1])
            add(edited([], ENDING[state][1], state)[0])
            out.append([conv, *sums, cost, "".join(audit), digest.hexdigest()])

        def flushed(kinds: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate([kinds, *[pa.int64()] * 5, *[pa.string()] * 2])]
            return pa.RecordBatch.from_arrays(columns, names)

        kinds = None
        for b in batches:
            kinds = b.schema.field("conv").type
            for r in b.to_pylist():
                after = tuple(inf if x is None else x for x in r["after"])
                if r["conv"] != conv:
                    if conv is not None:
                        close()
                    conv, state, last, digest, audit, sums, any_line = r["conv"], 0, None, hashlib.sha256(), [], [0] * 4, False
                    cost = int(min(c + a for c, a in zip(costs(r["codes"])[0], after, strict=True)))
                initials = [role[:1] for role in r["roles"]]
                pairs = zip([last, *initials] if last is not None else initials, initials if last is not None else initials[1:], strict=False)
                for k, n in enumerate((r["blank"], r["duplicate"], r["truncated"], sum(x + y not in LEGAL for x, y in pairs))):
                    sums[k] += n
                last = initials[-1]
                edits, end = cheapest(r["codes"], state, after)
                lines, state = edited(list(zip(r["roles"], r["texts"], strict=True)), edits, state)
                assert state == end
                audit.append(edits)
                add(lines)
            if out:
                yield flushed(kinds)
                out = []
        if conv is not None:
            close()
            yield flushed(kinds)

    joined = cut.join(later_costs(cut, kind), ["conv", "part", "no"])
    return joined.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by the hash of ``conv_id:turn``: of twenty remainders 0 drops a row, 1
    empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats the row and 4 makes it a user's. Nulls are one space, in the hash too."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hashed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat_ws(":", *told).cast("binary")) % 20).alias("rest"))
    rest = F.col("rest")
    return hashed.where(rest != 0).select(
        "conv_id",
        "turn",
        F.when(rest == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(rest == 1, "").when(rest == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(rest == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation of ``rows``.

    Rows are taken by turn, null turns first, equal turns by role and text. ``gaps`` is the number of turns missing between
    the first and the last one. A row's first fault counts: blank, duplicate (role and text of an earlier row), truncated
    (does not end with ``.``, ``!`` or ``?``). ``illegal`` counts neighbours that are not system-user, user-assistant or
    assistant-user by their roles' initials. ``audit`` lists the cheapest edits that leave an optional system turn and pairs of user
    and assistant, or nothing: Keep 0, Rerole 1, Delete 2 (what blank and duplicate rows must be), Insert 5, and 5 for each truncated row that
    stays; of equally cheap ones the least list. ``repaired_sha256`` is the digest of ``role:text`` lines.

    Null roles and texts count as empty, a null conversation is one; repeated rows are duplicates; an empty table gives no rows;
    other columns are not read. A long conversation is cut in pieces: what edits can cost in each piece is found by auctions
    side by side, then the pieces pass in order, one in memory at a time, as a digest needs.
    """
    kind = dict(rows.dtypes)[conv]
    own = rows.select(F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    cut = pieces(ordered(own), kind)
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = own.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"))
    return gaps.join(repaired(cut, kind), "conv").select(F.col("conv.id").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
