"""Repair of conversation structure by error-correcting Earley parsing.

A conversation should be ``(s?(ua)+)?`` in role initials: an optional system
turn, then pairs of user and assistant, or nothing. :data:`GRAMMAR` has a
nonterminal for each state of such a conversation and, beside the proper turns,
weighted productions that delete, rerole or insert one. It is written for
reading from the last turn to the first, so it is left-recursive: every item
starts at column 0, a column of the chart has as many items as the grammar has
places for its dot, and parsing is linear. A completed item keeps the least
(cost, audit) of the turns read so far; the audit is its first edit and the
item behind, and as the first edit decides among equal costs, comparing first
edits gives the ASCII-least audit.

* Rows that are alike are counted before they are sent, so that repeats are one
  row; a turn's first saying is the least of a grouping, joined back.
* Turns are dealt by ranges of (conv_id, turn, role, text), which splits any
  conversation, and streamed. A conversation within a task is repaired there.
* One that reaches over tasks, or over :data:`BLOCK_ROWS`, is cut into blocks.
  A block yields the least cost from each state to each state; these small
  rows are streamed backwards per conversation, which gives every block the
  cost of what follows; blocks are then parsed side by side, from each state
  they may be entered in, and streamed forwards to tell which one it is.

Scale: turns are shuffled once to count them, once to tell first sayings and
once by range. A task holds a block. Only what the result asks for sees a long
conversation as a whole: the audit, one character a turn, and the hash, which
is streamed.

Defined cases: null roles and texts are one space, as is a null conv_id or turn
in the key of the damage; turns without conv_id are one conversation; null
turns come first; turns of equal number are ordered by role and text. A role
is judged by its first character, in either direction: only s, u and a may be
kept. Conversations of which no turn is left have zeros and the hash of an
empty text; an empty table gives no rows; other columns are not read. A very
long text must fit a task's memory, a very long conversation need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import fresh_folder
from poolgauge.shipping import ship_code

BLOCK_ROWS, BLOCK_CHARS = 4_096, 4_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Nothing said yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEVER = 1 << 50
#: (state, what follows it, edit, role of the turn that the edit leaves): a state's rest is this turn and the rest of what follows.
GRAMMAR = [
    *[(q, q, "D", "") for q in STATES],
    (START, SYSTEM, "K", "s"),
    *[(q, to, edit, role) for q, to, role in ((START, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a")) for edit in "KRI"],
]
_READING = [p for p in GRAMMAR if p[2] != "I"]
_INSERTING = [p for p in GRAMMAR if p[2] == "I"]
NAMES = {"u": "user", "a": "assistant"}

#: For each state, the cost, first edit, state behind and role of its least audit.
Column_ = list[tuple[int, str, int, str]]


def weight(code: str, edit: str, role: str) -> int:
    """What an edit of a turn costs; ``code`` is the turn's initial (s, u, a or x) and fault (b, d, t or g)."""
    initial, fault = code
    if edit == "D":
        return DELETE
    if fault in "bd" or (edit == "K" and initial != role):
        return NEVER
    return (KEEP if edit == "K" else REROLE) + TRUNCATED * (fault == "t")


def _inserted(column: Column_) -> Column_:
    """Completes insertions, which read no turn, until none is cheaper."""
    changed = True
    while changed:
        changed = False
        for q, to, edit, role in _INSERTING:
            new = (column[to][0] + INSERT, edit, to, role)
            if new[0] < NEVER and new[:2] < column[q][:2]:
                column[q], changed = new, True
    return column


def _ended() -> Column_:
    """The column behind the last turn: a conversation may end where it has not begun, or after the assistant."""
    return _inserted([(0 if q in (START, ASSISTANT) else NEVER, "", q, "") for q in STATES])


END = _ended()
END_COSTS = tuple(c for c, *_ in END)


def parse(codes: str, ends: tuple[int, ...]) -> list[Column_]:
    """The chart of turns (two characters each): column i stands before turn i, the last one has the costs ``ends`` of what follows."""
    chart = [[(c, "", q, "") for q, c in zip(STATES, ends, strict=True)]]
    for i in range(len(codes) - 2, -1, -2):
        behind, code = chart[-1], codes[i : i + 2]
        column: Column_ = [(NEVER, "~", q, "") for q in STATES]
        for q, to, edit, role in _READING:  # the rest ``to`` is complete: scan the turn, complete ``q``
            new = (behind[to][0] + weight(code, edit, role), edit, to, role)
            if new[0] < NEVER and new[:2] < column[q][:2]:
                column[q] = new
        chart.append(_inserted(column))
    chart.reverse()
    return chart


def followed(chart: list[Column_], state: int) -> tuple[str, str, int]:
    """From a state before the first turn: the audit, the fate of every turn, and the state after the last.

    A fate is two characters: what is inserted before the turn ("." nothing,
    "u", "a", "p" user and assistant, "q" assistant and user) and the edit (K,
    D, or the new role u or a).
    """
    audit, fates = [], []
    for column in chart[:-1]:
        before = ""
        while column[state][1] == "I":
            before += column[state][3]
            audit.append("I")
            state = column[state][2]
        _, edit, to, role = column[state]
        audit.append(edit)
        fates.append({"": ".", "ua": "p", "au": "q"}.get(before, before) + (role if edit == "R" else edit))
        state = to
    return "".join(audit), "".join(fates), state


def tail(state: int) -> str:
    """Roles inserted behind the last turn."""
    roles = ""
    while END[state][1]:
        roles, state = roles + END[state][3], END[state][2]
    return roles


@lru_cache(maxsize=50_000)
def _repaired(codes: str) -> tuple[int, str, str, str]:
    """Cost, audit, fates and roles inserted at the end of a whole conversation."""
    chart = parse(codes, END_COSTS)
    audit, fates, state = followed(chart, START)
    return chart[0][START][0], audit, fates, tail(state)


def said(fate: str, role: str, text: str) -> Iterator[str]:
    """The lines that a turn leaves."""
    for r in {".": "", "p": "ua", "q": "au"}.get(fate[0], fate[0]):
        yield NAMES[r] + ":"
    if fate[1] != "D":
        yield f"{NAMES.get(fate[1], role)}:{text}"


def _times(audit: str, times: list[int]) -> str:
    """The audit with the deletions of a turn's repeats behind its own edit."""
    if max(times, default=1) == 1:
        return audit
    rest = iter(times)
    return "".join(c if c == "I" else c + "D" * (next(rest) - 1) for c in audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (how often) of the turns that are left, all damaged by the CRC-32 of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), what.alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("what") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def coded(turns: DataFrame) -> DataFrame:
    """``turns`` with ``code``: initial and first fault of the first of alike turns; the others are its duplicates, or blank too."""
    own = turns.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("turn"), "text"), "order": F.struct(F.col("turn").isNotNull().alias("has"), "turn")})
    first = own.groupBy("conv_id", "role", "h1", "h2").agg(F.min("order").alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    both = own.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_off = F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "b").when(~F.col("order").eqNullSafe(F.col("first")), "d").when(cut_off, "t").otherwise("g")
    initial = F.substring("role", 1, 1)
    return both.select("conv_id", "turn", "role", "text", "n", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault).alias("code"))


class _Block:
    """Consecutive turns of one conversation."""

    def __init__(self, conv):
        self.conv, self.rows, self.chars = conv, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.chars += len(row[2])

    def numbers(self) -> dict:
        """Counts that need no other block; turns: the different numbers, which are sorted."""
        blank = dup = cut_off = illegal = 0
        last = ""
        for _, role, _, n, code in self.rows:
            blank += n * (code[1] == "b")
            dup += (n - 1) * (code[1] != "b") + (code[1] == "d")
            cut_off += code[1] == "t"
            illegal += (n - 1) + (bool(last) and not _legal(last, role[:1]))
            last = role[:1] or "-"
        turns = [t for t, *_ in self.rows if t is not None]
        return {"blank": blank, "duplicate": dup, "truncated": cut_off, "illegal": illegal, "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}

    @property
    def codes(self) -> str:
        return "".join(r[4] for r in self.rows)

    @property
    def times(self) -> list[int]:
        return [r[3] for r in self.rows]


def _legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au")


_NUMBERS = ["blank", "duplicate", "truncated", "illegal"]
_FACTS = pa.schema([*[(c, pa.int64()) for c in (*_NUMBERS, "gaps", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_OPEN = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("codes", pa.string()), ("times", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("head", pa.string()), ("foot", pa.string())])
_SQL = {"int64": "long", "int32": "int", "string": "string", "list<item: int64>": "array<long>", "list<element: int64>": "array<long>"}


def _ddl(schema: pa.Schema, kind: str) -> str:
    return f"conv_id {kind}, " + ", ".join(f"{f.name} {_SQL[str(f.type)]}" for f in schema)


def _batch(rows: list[dict], conv_type: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", conv_type), *schema]))


def _streamed(turns: DataFrame, folder: str, block_rows: int) -> DataFrame:
    """Write and reread: rows of whole conversations (``audit``), of blocks of others (``codes``), and of their turns (``role``)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([*_FACTS, *_OPEN])

    def whole(b: _Block) -> dict:
        cost, audit, fates, roles = _repaired(b.codes)
        lines = [x for i, r in enumerate(b.rows) for x in said(fates[2 * i : 2 * i + 2], r[1], r[2])] + [NAMES[r] + ":" for r in roles]
        facts = b.numbers()
        gaps = facts["high"] - facts["low"] + 1 - facts["turns"] if facts["turns"] else 0
        return {"conv_id": b.conv, **{c: facts[c] for c in _NUMBERS}, "gaps": gaps, "cost": cost + DELETE * (sum(b.times) - len(b.rows)), "audit": _times(audit, b.times) + "I" * len(roles), "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def opened(b: _Block, number: int) -> Iterator[dict]:
        costs = [c for q in STATES for c, *_ in parse(b.codes, tuple(0 if q == e else NEVER for e in STATES))[0]]
        yield {"conv_id": b.conv, "block": number, "codes": b.codes, "times": b.times, "costs": costs, "head": b.rows[0][1][:1], "foot": b.rows[-1][1][:1], **b.numbers()}
        for at, (_, role, text, *_) in enumerate(b.rows):
            yield {"conv_id": b.conv, "block": number, "at": at, "role": role, "text": text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, sure, out, size = TaskContext.get().partitionId() << 32, None, False, [], 0
        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = block is not None and conv != block.conv
                if other or (block and (len(block.rows) == block_rows or block.chars > BLOCK_CHARS)):
                    # the first conversation of a task may begin in another one, and a full block is not the whole
                    size += block.chars
                    out.extend([whole(block)] if other and sure else opened(block, number))
                    number, sure, block = number + 1, other, None
                    if len(out) > 4_000 or size > BLOCK_CHARS:
                        yield _batch(out, conv_type, schema)
                        out, size = [], 0
                if block is None:
                    block = _Block(conv)
                block.add(tuple(row))
        if block is not None:  # the last one may go on in another task
            out.extend(opened(block, number))
        if out:
            yield _batch(out, conv_type, schema)

    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "n", "code")
    dealt.mapInArrow(run, _ddl(schema, kind)).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(_ddl(schema, kind)).parquet(folder)


def _long_ones(found: DataFrame) -> DataFrame:
    """The results of conversations in blocks, each fact in a row of its own or more."""
    spark = found.sparkSession
    kind = found.schema["conv_id"].dataType.simpleString()
    blocks = found.where(F.col("codes").isNotNull())

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), lambda r: r[0]):
            ends = list(END_COSTS)
            for _, block, costs in rows:
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "ends": pa.array([ends], pa.list_(pa.int64()))})
                ends = [min(NEVER, *(costs[4 * e + q] + ends[e] for e in STATES)) for q in STATES]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, times, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chart = parse(codes, tuple(ends))
                each = [followed(chart, q) if chart[0][q][0] < NEVER else ("", "", q) for q in STATES]
                costs = [min(NEVER, chart[0][q][0] - ends[each[q][2]]) + DELETE * (sum(times) - len(times)) for q in STATES]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "exits": pa.array([[s for *_, s in each]], pa.list_(pa.int32())), "paid": pa.array([costs], pa.list_(pa.int64())), "audits": [[_times(a, times) for a, *_ in each]], "fates": [[f for _, f, _ in each]]})

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which each block is entered; behind the last block, a row of the conversation's numbers and end."""
        conv_type = None
        schema = pa.schema([("block", pa.int64()), ("entry", pa.int32()), ("roles", pa.string()), *[_FACTS.field(c) for c in (*_NUMBERS, "gaps", "cost")]])

        def rows() -> Iterator[tuple]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv_id").type
                yield from (dict(zip(b.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

        for conv, mine in groupby(rows(), lambda r: r["conv_id"]):
            state, total, low, high, turns, foot = START, dict.fromkeys([*_NUMBERS, "cost"], 0), None, None, 0, None
            for r in mine:
                yield _batch([{"conv_id": conv, "block": r["block"], "entry": state}], conv_type, schema)
                total = {c: total[c] + (r["paid"][state] if c == "cost" else r[c]) for c in total}
                total["illegal"] += foot is not None and not _legal(foot or "-", r["head"])
                turns += r["turns"] - (high is not None and r["low"] == high)
                low, high = (r["low"] if low is None else low), (high if r["high"] is None else r["high"])
                state, foot = r["exits"][state], r["foot"]
            roles = tail(state)
            total["cost"] += INSERT * len(roles)
            yield _batch([{"conv_id": conv, "roles": roles, **total, "gaps": high - low + 1 - turns if turns else 0}], conv_type, schema)

    def stored(df: DataFrame, name: str) -> DataFrame:
        folder = fresh_folder(spark, name)
        df.write.option("compression", "zstd").parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    back = blocks.select("conv_id", "block", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = back.mapInArrow(backwards, "block long, ends array<long>")
    own = stored(blocks.join(ends, "block").select("block", "codes", "times", "ends").mapInArrow(parsed, "block long, exits array<int>, paid array<long>, audits array<string>, fates array<string>"), "parsed-blocks")
    facts = blocks.select("conv_id", "block", *_NUMBERS, "turns", "low", "high", "head", "foot").join(own.select("block", "exits", "paid"), "block")
    facts = facts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    way = stored(facts.mapInArrow(forwards, f"conv_id {kind}, block long, entry int, roles string, " + ", ".join(f"{c} long" for c in (*_NUMBERS, "gaps", "cost"))), "entered-blocks")

    total = way.where(F.col("block").isNull())
    entered = way.where(F.col("block").isNotNull()).select("block", "entry").join(own, "block")
    audits = blocks.select("conv_id", "block").join(entered.select("block", F.get("audits", "entry").alias("own")), "block")
    # one string a conversation is what the result is
    last = total.select("conv_id", F.lit(2**62).alias("block"), F.repeat(F.lit("I"), F.length("roles")).alias("own"))
    audit = audits.select("conv_id", "block", "own").union(last).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "own"))), lambda x: x["own"]), "").alias("audit"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns come in order; behind those of a conversation, a row with the roles inserted at its end."""
        own, first = hashlib.sha256(), True
        for b in batches:
            for conv, role, text, fate, roles in zip(b.column(0), *(c.to_pylist() for c in b.columns[1:]), strict=True):
                for line in [NAMES[r] + ":" for r in roles] if roles is not None else said(fate, role, text):
                    own.update(line.encode() if first else b"\n" + line.encode())
                    first = False
                if roles is not None:
                    yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv.as_py()], conv.type), "repaired_sha256": [own.hexdigest()]})
                    own, first = hashlib.sha256(), True

    turns = found.where(F.col("at").isNotNull()).join(entered.select("block", F.get("fates", "entry").alias("fates")), "block")
    none = F.lit(None).cast("string")
    turns = turns.select("conv_id", "block", "at", "role", "text", F.substring("fates", 2 * F.col("at") + 1, 2).alias("fate"), none.alias("roles"))
    turns = turns.union(total.select("conv_id", F.lit(2**62), F.lit(0), none, none, none, "roles"))
    hashes = turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "role", "text", "fate", "roles").mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")
    return total.select("conv_id", *_NUMBERS, "gaps", "cost").unionByName(audit, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of turns (conv_id, turn, role, text, n)."""
    spark = turns.sparkSession
    ship_code(spark)
    counted = fresh_folder(spark, "turns")
    turns.write.option("compression", "zstd").parquet(counted)
    ranked = fresh_folder(spark, "coded-turns")
    coded(spark.read.schema(turns.schema).parquet(counted)).write.option("compression", "zstd").parquet(ranked)
    found = _streamed(spark.read.parquet(ranked), fresh_folder(spark, "repaired"), block_rows)
    columns = ["gaps", *_NUMBERS, "cost", "audit", "repaired_sha256"]
    done = found.where(F.col("audit").isNotNull()).select("conv_id", *columns)
    long_ones = _long_ones(found).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])
    return done.unionByName(long_ones)


def digest(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Damage all conversations, repair them, and report every original conv_id."""
    fixed = repair(damaged(conversations), block_rows)
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    both = every.join(fixed, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_NUMBERS, "cost")]
    return both.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
