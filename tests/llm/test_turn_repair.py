"""Repaired conversations against all ways to edit them, and the auction against plain shortest ways."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache
from math import inf

from mlwatch.llm import auction, queries
from mlwatch.llm.turn_repair import damaged, repair

WHITE = "\t\n\v\f\r "
THEN = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain(rows):
    """One conversation's answer, from rows (turn, role, text) with no nulls but turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append(3 if not body else 2 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0)
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, before, inserted):
        """Least (cost, edits) from row i after a turn of role ``before``; more than two insertions in a row never pay."""
        ways = [(0, "")] if i == len(rows) and before in ("", "a") else []
        if inserted < 2:
            c, e = best(i, THEN[before], inserted + 1)
            ways.append((c + 5, "I" + e))
        if i < len(rows):
            initial = rows[i][1][:1]
            c, e = best(i + 1, before, 0)
            ways.append((c + 2, "D" + e))
            if faults[i] < 2:
                more = 5 * faults[i]
                if initial == THEN[before] or (initial == "s" and before == ""):
                    c, e = best(i + 1, initial, 0)
                    ways.append((c + more, "K" + e))
                c, e = best(i + 1, THEN[before], 0)
                ways.append((c + 1 + more, "R" + e))
        return min(ways, default=(inf, ""))

    for i in range(len(rows), -1, -1):  # from the end, so that calls don't nest deeply
        for before in THEN:
            best(i, before, 0)
    cost, edits = best(0, "", 0)
    lines, before, left = [], "", iter(rows)
    for e in edits:
        then = THEN[before]
        if e == "I":
            lines.append(f"{NAME[then]}:")
            before = then
            continue
        _, role, text = next(left)
        if e != "D":
            role = role if e == "K" else NAME[then]
            lines.append(f"{role}:{text}")
            before = role[:1]
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *[faults.count(k) for k in (3, 2, 1)], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def make_conversations():
    rng = random.Random(9)
    texts = ["hi.", "what?", "no end", "", " \n", "é!", "ok. ", "漢字。", "a\nb."]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "u2"]
    out = {}
    for c in range(120):
        n = rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 9])
        out[c] = [(rng.choice([None, rng.randint(-2, 8), i]), rng.choice(roles), rng.choice([*texts, f"say {i}.", f"say {i}"])) for i in range(n)]
    good = [(i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(700)]
    out[200] = good
    out[201] = [(t, "user" if rng.random() < 0.1 else r, x[: -1 if rng.random() < 0.1 else None]) for t, r, x in good]
    out[202] = [(0, "system", "go.")] + [(1, "user", "again.")] * 300 + [(2, "assistant", "x" * 300_000 + ".")]
    out[203] = [(None, rng.choice(roles), f"{i}.") for i in range(200)]
    return {c: rows for c, rows in out.items() if rows}


def test_against_plain(spark):
    made = make_conversations()
    rows = [(c, t, r, x, "z", 1) for c, own in made.items() for t, r, x in own]
    rows += [(None, 1, None, "hello.", "z", 1), (None, 2, "assistant", None, "z", 1), (-5, None, None, None, "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, part int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair(df).collect()}
    made[None], made[-5] = [(1, "", "hello."), (2, "assistant", "")], [(None, "", "")]
    assert set(got) == set(made)
    for c, own in made.items():
        assert got[c] == plain(own), c


def test_empty(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repair(empty).collect() == []
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for c in [None, *range(60)]:
        for t in [None, *range(rng.randint(0, 6))][rng.randint(0, 1) :]:
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes. No.", "why?", "so", None, "ok!"])))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, t, r, x in rows:
        own = want.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        rest = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if rest == 1 else x.translate({ord(y): None for y in ".!?"}) if rest == 2 else x
        own += [(t, "user" if rest == 4 else r, x)] * {0: 0, 3: 2}.get(rest, 1)
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: plain(own) for c, own in want.items()}
    assert damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == sum(map(len, want.values()))


def test_auction():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 40]:
        codes = bytes(rng.randrange(12) for _ in range(n))
        arcs = auction.arcs_of(codes)
        for before, own in enumerate(auction.costs(codes)):
            dist = [inf] * len(arcs)
            dist[before] = 0
            for _ in range(3):  # inserted turns lead back by one node at most
                for i, out in enumerate(arcs):
                    for cost, j, _ in out:
                        dist[j] = min(dist[j], dist[i] + cost)
            assert list(own) == dist[4 * n :]
