"""Conversation repair against an exhaustive search, on shipped and on made-up rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parchmint.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    shown = lambda v: " " if v is None else str(v)
    out = collections.defaultdict(list)
    for c, t, role, text in rows:
        k = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", shown(text)) if k == 2 else shown(text)
        out[c] += [(t, "user" if k == 4 else shown(role), text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired(rows):
    """All facts of one conversation, by search over all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, seen, faults = {t for t, *_ in rows if t is not None}, set(), []
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-")
        seen.add((role, text))
    roles = [r[1][:1] for r in rows]
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def least(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def way(cost, edit, line, *to):
            c, audit, rest = least(*to)
            ways.append((c + cost, edit + audit, (*line, *rest)))

        for new in "ua":
            full = {"u": "user", "a": "assistant"}[new]
            if new in after[last]:
                if inserted < 3:
                    way(2, "I", [f"{full}:"], i, new, inserted + 1)
                if i < len(rows) and faults[i] not in "bd":
                    way(2 + (faults[i] == "t"), "R", [f"{full}:{rows[i][2]}"], i + 1, new, 0)
        if i < len(rows):
            way(3, "D", [], i + 1, last, 0)
            if faults[i] not in "bd" and roles[i] and roles[i] in after[last]:
                way(int(faults[i] == "t"), "K", [f"{rows[i][1]}:{rows[i][2]}"], i + 1, roles[i], 0)
        return min(ways, default=(1 << 30, "~", ()))

    cost, audit, lines = least(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def check(spark, folder, rows):
    got = [tuple(r) for r in conversations.op11_conversation_repair(spark, folder).collect()]
    want = {c: repaired(r) for c, r in damaged(rows).items()}
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want


def test_shipped_conversations(spark, sf):
    check(spark, sf, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_nulls_ties_repeats_and_odd_roles(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for c in [*range(60), None]:
        for t in range(r.randrange(9)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", "system", "tool", "sue", None]), r.choice(["a.", "b!", "c", "  ", None, "é?", "a.", "x\n", "dd. \n", "long " * 30000])))
        if r.random() < 0.3 and rows:
            rows.append(rows[-1])
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(1) for k in ("c", "c2", "pos", "n", "audit", "signature", "code")})
    wide.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path), rows)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_one_conversation_of_many_turns(spark):
    """Its rows lie in several tasks and its signature has thousands of rows; the recursion doesn't go deep."""
    rows = spark.range(6000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    rows = rows.where("id <> 3001").unionByName(rows.where("id = 10"))
    solved, out = conversations.repair(rows.select("conv_id", "turn", "role", "text"))
    found = solved.collect()[0]
    assert (found.gaps, found.duplicate, found.illegal, found.cost) == (1, 1, 2, 5)
    assert collections.Counter(found.audit) == {"K": 5999, "D": 1, "I": 1}
    shown = [(r.position, r.role, r.edit) for r in out.collect()]
    assert [p for p, *_ in shown] == list(range(6000)) and all(role == ("user", "assistant")[p % 2] for p, role, _ in shown)
    assert shown[3001] == (3001, "assistant", "I")


@pytest.mark.parametrize(("signature", "want"), [("", (0, "")), ("s-", (3, "D")), ("u-", (2, "KI")), ("u-u-", (2, "KR")), ("s-u-a-", (0, "KKK")), ("a-", (2, "IK")), ("obut", (6, "DD"))])
def test_signatures(signature, want):
    """In the last, keeping the cut row needs an answer (1 + 2), and deleting it costs as much."""
    assert conversations.solve(signature) == want
