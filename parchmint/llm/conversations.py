"""Conversation structure repair by distinct signatures.

A conversation's roles and faults are written as a compact string, two characters a row. Each distinct string is solved once,
by a memoised recursion over what is left of it, into the cheapest edits (the audit); audits are joined back to the
conversations, and the edits are replayed over their rows.

Rows stand in one order all over the corpus: they are dealt by range of (conversation, turn, role, text) and numbered
where they lie. So a conversation that holds a large part of all rows is spread over many tasks: equal rows are counted
first, faults come from keyed minima, signatures from blocks of at most 64 rows. What meets in one task for one
conversation are its signature and its audit, which have a few characters a row, and the stream of its sorted rows that
``replay`` and ``digests`` read batch by batch (an order and a digest over a whole conversation can't be had otherwise).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm._arrow import small_batches
from parchmint.llm._scratch import stage

BLANK = " \t\n\x0b\f\r"
BLOCK_BITS = 6
#: Edits and their costs, fixed by the contract; a truncated row that stays costs one more.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
# What has been given so far: nothing, a system row, a user row, an assistant row. A conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant row leads to, and that row's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
Plan = tuple[tuple[int, ...], tuple[str, ...]]


def _best(options: list[dict[str, int]]) -> Plan:
    """The least (cost, edit) by state, with rows inserted before where that is cheaper. Every edit leads to one state only, so
    the first letter alone decides between equal costs."""
    best = [min(((c, e) for e, c in o.items()), default=(1 << 40, "~")) for o in options]
    for _ in range(3):
        best = [min(b, (best[NEXT[s]][0] + COST[INSERT], INSERT)) for s, b in enumerate(best)]
    return tuple(c for c, _ in best), tuple(e for _, e in best)


def _step(row: str, rest: tuple[int, ...]) -> Plan:
    """Costs and edits by state for one row (role and fault), where what follows costs ``rest`` by state."""
    role, fault = row
    options = []
    for s in range(4):
        o = {DELETE: COST[DELETE] + rest[s]}
        if fault not in "bd":
            late = int(fault == "t")
            o[REROLE] = COST[REROLE] + late + rest[NEXT[s]]
            to = SYSTEM if role == "s" and s == START else NEXT[s] if role == ROLE[s][0] else None
            if to is not None:
                o[KEEP] = COST[KEEP] + late + rest[to]
        options.append(o)
    return _best(options)


END = _best([{"": 0}, {}, {}, {"": 0}])


def solve(signature: str, memo: dict | None = None) -> tuple[int, str]:
    """(cost, audit) of a signature. The recursion over its rows goes by the costs of what is left, less their least; these
    are few, so ``memo`` gets a few hundred entries in all, however long and many the signatures are."""
    memo = {} if memo is None else memo
    least, (costs, last) = 0, END
    edits = []
    for i in range(len(signature) - 2, -2, -2):
        low = min(costs)
        least += low
        left = signature[i : i + 2], tuple(c - low for c in costs)
        if left not in memo:
            memo[left] = _step(*left)
        costs, letters = memo[left]
        edits.append(letters)
    state, audit = START, []
    for i, letters in enumerate([*reversed(edits), last]):
        while letters[state] == INSERT:
            audit.append(INSERT)
            state = NEXT[state]
        audit.append(letters[state])
        if letters[state] == REROLE or letters[state] == KEEP and (signature[2 * i] != "s"):
            state = NEXT[state]
        elif letters[state] == KEEP:
            state = SYSTEM
    return least + costs[START], "".join(audit)


def signature_facts(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated rows, adjacent roles other than su, ua, au)."""
    roles, faults = signature[::2], signature[1::2]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal


def _solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, memo = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"], {}
    for batch in it:
        rows = [(s, *signature_facts(s), *solve(s, memo)) for s in batch.column(0).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("signature", "audit") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def place(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """Rows in the order of their conversation: ``c, turn, role, text, n, pos``, written once.

    Rows equal in all four columns become one with a count ``n`` (``copies`` of each; one where it isn't given; a row of no
    copies only says that its conversation exists). Null roles and texts read as one space. ``pos`` grows with (conversation,
    turn, role, text), nulls first, so rows of one turn stand by role and text.
    """
    own = rows.select(F.col(conv).alias("c"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    merged = own.groupBy("c", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = [F.asc_nulls_first("c"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = merged.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, F.asc("text"))
    return stage(dealt.withColumn("pos", F.monotonically_increasing_id()), "conversation-rows")


def signatures(placed: DataFrame) -> DataFrame:
    """``c, signature`` of conversations that have rows: for each row its role (``s u a``, else ``o``) and its first fault:
    ``b`` blank, ``d`` role and text seen earlier, ``t`` truncated, ``-`` none."""
    core = F.rtrim("text", F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("c").cast("string"), F.lit("\x1e")), F.length("role").cast("string"), "role", "text"), 256)
    own = placed.where("n > 0").select(
        "c", "pos", "n", key.alias("key"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("r"), F.when(core == "", "b").when(F.right(core, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t").alias("f")
    )
    first = own.groupBy("key").agg(F.min("pos").alias("first"))
    again = F.when(F.col("f") == "b", "b").otherwise("d")
    code = F.concat("r", F.when(F.col("pos") == F.col("first"), F.col("f")).otherwise(again), F.expr("repeat(concat(r, if(f = 'b', 'b', 'd')), cast(n - 1 as int))"))
    joined = lambda at, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, x))), lambda s: s[x]), "").alias(x)
    coded = own.join(first, "key").select("c", "pos", code.alias("signature"), F.shiftright("pos", BLOCK_BITS).alias("block"))
    return coded.groupBy("c", "block").agg(joined("pos", "signature")).groupBy("c").agg(joined("block", "signature"))


def audits(placed: DataFrame) -> DataFrame:
    """A row for each conversation: ``c, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    turns = placed.groupBy("c").agg(F.min(F.when(F.col("n") > 0, F.col("turn"))).alias("lo"), F.max(F.when(F.col("n") > 0, F.col("turn"))).alias("hi"), F.count_distinct(F.when(F.col("n") > 0, F.col("turn"))).alias("k"))
    gaps = F.expr("coalesce(try_cast(cast(hi AS decimal(38, 0)) - lo + 1 - k AS bigint), 0L)")
    own = signatures(placed).withColumnRenamed("c", "c2")
    every = stage(turns.join(own, turns.c.eqNullSafe(own.c2), "left").select("c", gaps.alias("gaps"), F.coalesce("signature", F.lit("")).alias("signature")), "conversation-signatures")
    schema = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    solved = every.select("signature").distinct().mapInArrow(_solve, schema)
    return stage(every.join(solved, "signature").drop("signature"), "conversation-audits")


def replay(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired rows: ``c, position, role, text, edit``, those of a conversation in order one after the other.

    Each conversation's audit goes ahead of its sorted rows as a row of its own, so no row carries the audit of all.
    """
    head = solved.select("c", F.lit(-1).cast("long").alias("pos"), F.col("audit").alias("role"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"))
    rows = head.unionByName(placed.where("n > 0").select("c", "pos", "role", "text", "n"))
    kind = placed.schema["c"].dataType.simpleString()
    small_batches(placed.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position = "", 0, START, 0
        c = None
        for batch in it:
            out: list[tuple] = []

            def give(role: str, text: str, edit: str) -> None:
                nonlocal position
                out.append((c, position, role, text, edit))
                position += 1

            def inserted() -> None:
                nonlocal at, state
                while audit[at : at + 1] == INSERT:
                    give(ROLE[state], "", INSERT)
                    state, at = NEXT[state], at + 1

            for own, pos, role, text, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if pos < 0:
                    inserted()  # what the conversation before still lacks
                    c, audit, at, state, position = own, role, 0, START, 0
                    continue
                for _ in range(n):
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == KEEP:
                        state = SYSTEM if role[:1] == "s" else NEXT[state]
                        give(role, text, edit)
                    elif edit == REROLE:
                        give(ROLE[state], text, edit)
                        state = NEXT[state]
            if not audit[at:].strip(INSERT):
                inserted()  # after the conversation's last row
            yield _repaired(out, batch.schema.field(0).type)

    def _repaired(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        c, position, role, text, edit = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, key), pa.array(position, pa.int64()), *(pa.array(x, pa.string()) for x in (role, text, edit))], ["c", "position", "role", "text", "edit"])

    return rows.repartition("c").sortWithinPartitions("c", "pos").select("c", "pos", "role", "text", "n").mapInArrow(run, f"c {kind}, position long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """``c, repaired_sha256`` of what ``replay`` gives (conversations that kept a row): ``role:text``, newline-joined. Rows are
    folded as they come; nothing but the running digest is held."""
    kind = repaired.schema["c"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, key, sha = None, None, None
        for batch in it:
            out = []
            key = batch.schema.field(0).type
            for own, position, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if position == 0:
                    if sha is not None:
                        out.append((c, sha.hexdigest()))
                    c, sha = own, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield _shas(out, key)
        if sha is not None:
            yield _shas([(c, sha.hexdigest())], key)

    def _shas(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        c, sha = zip(*out, strict=True) if out else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(c, key), pa.array(sha, pa.string())], ["c", "repaired_sha256"])

    return repaired.mapInArrow(run, f"c {kind}, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of conversations, both with the conversation as ``c``.

    Null roles and texts read as one space, and no role that begins with another letter than s, u and a can be kept; rows
    without a conversation are one conversation. Rows of one turn stand by role and text, null turns first, and equal rows one
    after the other (all but the first are duplicates). Turns that aren't there make a gap, null turns none; gaps that don't
    fit a long are 0. Further columns aren't read. An empty table gives two empty ones.
    """
    placed = place(rows, conv, turn, role, text, copies)
    solved = audits(placed)
    return solved, replay(placed, solved)


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(damaged rows, copies of each), by ``crc32(conv_id:turn) % 20``; nulls are one space."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", at("role").alias("role"), at("text").alias("text"), code.alias("code"))
    gone = F.col("code") == 0
    role = F.when(gone, "").when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(gone | (F.col("code") == 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.withColumns({"role": role, "text": text}), F.when(gone, 0).when(F.col("code") == 3, 2).otherwise(1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved, repaired = repair(*_damaged(spark, sf_dir))
    shas = digests(repaired).withColumnRenamed("c", "c2")
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return solved.join(shas, solved.c.eqNullSafe(shas.c2), "left").select(F.col("c").alias("conv_id"), *facts, sha.alias("repaired_sha256"))


def _damaged(spark: SparkSession, sf_dir: str) -> tuple:
    rows, copies = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows, "conv_id", "turn", "role", "text", copies
