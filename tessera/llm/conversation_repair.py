"""Repair of conversation structure (operator 11) by depth-first branch-and-bound.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. Its rows
are kept, given another role, deleted or filled up with empty rows; the cheapest
such edits, and among them the ASCII-least string of their initials (the audit),
are found by a search over nodes (rows used, state of the pattern): an explicit
stack, lower bounds on what the rest of the rows costs, the best (cost, audit)
found so far, and at every node the best prefix that reached it. Prefixes that
are dominated or cannot beat the incumbent are dropped; when the stack is empty,
the incumbent is proved best.

Scale. Rows are counted when equal, judged by one grouping and a join on
(conversation, role, text hash), and dealt by one range partitioning on
(conversation, turn, ...), so a conversation with a third of all rows is spread
over many tasks. A conversation that lies inside a task, up to ``BLOCK`` rows, is
solved there. Any other is cut into blocks; a block is solved for every state it
may be entered in, and keeps, per pair of states, the best edits. A second step
chains the blocks of a conversation in order, holding at most one (cost, audit,
running hash) per state. What grows there with a conversation is its audit,
which is part of the result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import cut, in_batches, lean

WHITE = " \t\n\x0b\x0c\r"
#: Rows that are searched at once.
BLOCK = 256

# The pattern as an automaton: states are "" (nothing yet) and the last initial.
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
#: The one of user and assistant that may follow a state.
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Insertions that end a conversation properly.
CLOSING = {"": "", "a": "", "u": "I", "s": "II"}
LEGAL = {"su", "ua", "au"}
RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: No state is worth more than this compared with any other: whatever the rest of
#: a conversation, one can be had from the other by deleting one row (a later
#: system row) and inserting one, or by inserting two.
SLACK = max(DELETE + INSERT, 2 * INSERT)

Row = tuple[str, bool, bool]      # initial of the role, must go, truncated


def suffix_bounds(rows: list[Row]) -> list[dict[str, int]]:
    """For every number of used rows and state, the least cost of the rest if it
    may end in any state: no end can cost less."""
    low = [dict.fromkeys(NEXT, 0)]
    for initial, must_go, truncated in reversed(rows):
        after, extra, own = low[-1], TRUNCATED * truncated, {}
        for q in NEXT:
            own[q] = DELETE + after[q]
            if not must_go:
                own[q] = min(own[q], RETAG + extra + after[WANTED[q]])
                if initial in NEXT[q]:
                    own[q] = min(own[q], extra + after[NEXT[q][initial]])
        low.append({q: min(own[q], INSERT + own[WANTED[q]], 2 * INSERT + own[WANTED[WANTED[q]]]) for q in NEXT})
    return low[::-1]


def cheapest(rows: list[Row], entry: str, low: list[dict[str, int]]) -> dict[str, tuple[int, str]]:
    """For every state in which the rows may be left, entered in ``entry``, the
    least (cost, audit); states that no end can make worth while are left out.
    Insertions after the last row are not tried: they are the next block's."""
    n, least = len(rows), None
    found: dict[str, tuple[int, str]] = {}
    reached: dict[tuple[int, str], tuple[int, str]] = {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, q = stack.pop()
        if least is not None and cost + low[i][q] > least + SLACK:
            continue
        old = reached.get((i, q))
        if old is not None and old <= (cost, audit):
            continue
        reached[i, q] = cost, audit
        if i == n:
            found[q] = cost, audit
            least = cost if least is None else min(least, cost)
            continue
        initial, must_go, truncated = rows[i]
        extra = TRUNCATED * truncated
        edits = [(cost + DELETE, audit + "D", i + 1, q), (cost + INSERT, audit + "I", i, WANTED[q])]
        if not must_go:
            edits.append((cost + RETAG + extra, audit + "R", i + 1, WANTED[q]))
            if initial in NEXT[q]:
                edits.append((cost + extra, audit + "K", i + 1, NEXT[q][initial]))
        # the most promising edit is popped first, so that an incumbent is found early
        edits.sort(key=lambda e: (e[0] + low[e[2]][e[3]], e[1]), reverse=True)
        stack += edits
    return found


def replay(state: str, audit: str, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines ``role:text`` that the edits leave, from a state on."""
    rows = zip(roles, texts)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            role = ROLE[WANTED[state]]
        if edit != "D":
            state = role[:1]
            yield f"{role}:{text}"


class Chain:
    """The best edits of a conversation so far, per state they end in."""

    def __init__(self, keep_text: bool):
        self.best = {"": (0, "", hashlib.sha256(), [] if keep_text else None, False)}

    def add(self, moves: dict[tuple[str, str], tuple[int, str]], roles: list[str], texts: list[str]) -> None:
        ways: dict[str, tuple[int, str, str, str]] = {}
        for (a, b), (cost, audit) in moves.items():
            if a in self.best:
                way = (self.best[a][0] + cost, self.best[a][1] + audit, a, audit)
                ways[b] = min(ways.get(b, way), way)
        self.best = {b: self._after(a, audit, cost, whole, roles, texts) for b, (cost, whole, a, audit) in ways.items()}

    def _after(self, state, audit, cost, whole, roles, texts):
        _, _, sha, kept, started = self.best[state]
        sha, kept = sha.copy(), kept if kept is None else [*kept]
        for line in replay(state, audit, roles, texts):
            part = ("\n" if started else "") + line
            started = True
            sha.update(part.encode())
            if kept is not None:
                kept.append(part)
        return cost, whole, sha, kept, started

    def end(self) -> tuple[int, str, str, str | None]:
        """Cost, audit, hash and (if wanted) text of the whole conversation."""
        self.add({(q, q + "|"): (INSERT * len(c), c) for q, c in CLOSING.items()}, [], [])
        cost, audit, sha, kept, _ = min(self.best.values(), key=lambda x: x[:2])
        return cost, audit, sha.hexdigest(), None if kept is None else "".join(kept)


_MOVES = "array<struct<a:string,b:string,cost:long,audit:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCK_SCHEMA = ("part int, no long, done boolean, first string, last string, min_turn long, max_turn long, "
                 f"n_turns long, {', '.join(f'{c} long' for c in _COUNTS)}, moves {_MOVES}, roles array<string>, "
                 "texts array<string>, gaps long, cost long, audit string, sha256 string, repaired string")


def _block(items: list[dict]) -> dict:
    """What is known of a run of rows without its neighbours."""
    turns = [x["turn"] for x in items if x["turn"] is not None]
    initials = [x["role"][:1] for x in items]
    faults = [x["fault"] for x in items]
    return {"first": initials[0], "last": initials[-1], "min_turn": min(turns, default=None), "max_turn": max(turns, default=None),
            "n_turns": len(set(turns)), **{f: faults.count(f) for f in _COUNTS[:3]},
            "illegal": sum(a + b not in LEGAL for a, b in itertools.pairwise(initials)),
            "roles": [x["role"] for x in items], "texts": [x["text"] for x in items],
            "rows": [(x["role"][:1], x["fault"] in ("blank", "duplicate"), x["fault"] == "truncated") for x in items]}


def _gaps(low, high, n: int) -> int:
    return 0 if low is None else high - low + 1 - n


def _solved(block: dict, keep_text: bool) -> dict:
    """A whole conversation in one block."""
    chain = Chain(keep_text)
    rows = block["rows"]
    chain.add({("", b): way for b, way in cheapest(rows, "", suffix_bounds(rows)).items()}, block["roles"], block["texts"])
    cost, audit, sha, text = chain.end()
    return {**{c: block[c] for c in _COUNTS}, "gaps": _gaps(block["min_turn"], block["max_turn"], block["n_turns"]),
            "cost": cost, "audit": audit, "sha256": sha, "repaired": text, "done": True}


def _open(block: dict) -> dict:
    """A block whose conversation goes on in others: its best edits for every entry."""
    low = suffix_bounds(block["rows"])
    return {**block, "done": False, "moves": [{"a": a, "b": b, "cost": c, "audit": x} for a in NEXT
                                              for b, (c, x) in cheapest(block["rows"], a, low).items()]}


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Single rows, in order, with their first fault."""
    for batch in batches:
        for x in batch.to_pylist():
            for copy in range(x["copies"]):
                fault = ("blank" if x["blank"] else "duplicate" if copy or not x["is_first"]
                         else "truncated" if x["truncated"] else "")
                yield {**x, "fault": fault}


def _chunks(items: Iterable[dict]) -> Iterator[tuple[int, int, list[dict]]]:
    """(number of the conversation, number of the block, at most BLOCK rows)."""
    for k, (_, rows) in enumerate(itertools.groupby(items, key=lambda x: x["conv"])):
        for j in itertools.count():
            if not (chunk := list(itertools.islice(rows, BLOCK))):
                break
            yield k, j, chunk


def _packed(rows: Iterable[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(part, schema)


def _to_blocks(keep_text: bool, schema: pa.Schema):
    """mapInArrow function over sorted partitions: rows to blocks. A conversation
    of one block that has others before and after it in the partition is whole."""
    def solve(batches):
        chunks = _chunks(_items(batches))
        now, no = next(chunks, None), 0
        while now is not None:
            after = next(chunks, None)
            k, j, items = now
            whole = k > 0 and j == 0 and after is not None and after[0] != k
            block = _block(items)
            yield {"conv": items[0]["conv"], "part": items[0]["part"], "no": no,
                   **(_solved(block, keep_text) if whole else _open(block))}
            now, no = after, no + 1

    return lambda batches: _packed(solve(batches), schema)


def _to_conversations(keep_text: bool, schema: pa.Schema):
    """mapInArrow function over blocks, sorted by conversation, part, no."""
    def chain(batches):
        blocks = (x for batch in batches for x in batch.to_pylist())
        for conv, own in itertools.groupby(blocks, key=lambda x: x["conv"]):
            links, counts, low, high, n, last = Chain(keep_text), dict.fromkeys(_COUNTS, 0), None, None, 0, None
            for b in own:
                links.add({(m["a"], m["b"]): (m["cost"], m["audit"]) for m in b["moves"]}, b["roles"], b["texts"])
                for c in _COUNTS:
                    counts[c] += b[c]
                counts["illegal"] += last is not None and last + b["first"] not in LEGAL
                last = b["last"]
                if b["min_turn"] is not None:
                    n += b["n_turns"] - (high == b["min_turn"])      # a turn may lie on both sides of a cut
                    low, high = b["min_turn"] if low is None else low, b["max_turn"]
            cost, audit, sha, text = links.end()
            yield {"conv": conv, **counts, "gaps": _gaps(low, high, n), "cost": cost, "audit": audit, "sha256": sha, "repaired": text}

    return lambda batches: _packed(chain(batches), schema)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the row's key, for tests of
    the repair: dropped, emptied, without sentence ends, twice, or by the user."""
    fault = F.crc32(F.concat(or_space(F.col(conv_id)), F.lit(":"), or_space(F.col(turn)))) % 20
    words = or_space(F.col(text))
    return (rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.when(fault == 4, F.lit("user")).otherwise(or_space(F.col(role))).alias("role"),
                        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
                        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))
                .withColumn("times", F.explode(F.array_repeat(F.lit(True), F.col("times")))).drop("times"))


def judged(rows: DataFrame) -> DataFrame:
    """Different rows of (conv, turn, role, text) with the number of copies, whether
    the first copy is the first of its role and text in the conversation, and the
    faults that a text shows by itself. Texts are compared by 128 bits here."""
    same = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    counted = (rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
                   .withColumn("same", same).withColumn("when", when))
    earliest = (rows.select(F.col("conv").alias("c"), F.col("role").alias("r"), same.alias("s"), when.alias("w"))
                    .groupBy("c", "r", "s").agg(F.min("w").alias("earliest")))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    return (counted.join(earliest, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("same") == F.col("s")))
                   .select("conv", "turn", "role", "text", "copies", F.col("when").eqNullSafe(F.col("earliest")).alias("is_first"),
                           (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated")))


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           ids: DataFrame | None = None, keep_text: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, sha256 and repaired (the lines ``role:text``; NULL unless
    ``keep_text``, the hash is of them anyway).

    Rows are taken by turn, NULL first; rows of one turn by role, then text. A row's
    first fault counts: blank (no letter but white space), duplicate (role and
    text were there before), truncated (the last letter ends no sentence). A NULL
    role or text is one space; a NULL conv_id is a conversation; repeated rows are
    duplicates. A conversation of ``ids`` (same column) without rows has zeros, an
    empty audit and the hash of nothing. Turns are whole numbers. Other columns
    are not read.
    """
    kind = dict(rows.dtypes)[conv_id]
    plain = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        or_space(F.col(role)).alias("role"), or_space(F.col(text)).alias("text"))
    order = ["conv", "turn", "role", "text"]
    dealt = (judged(plain).repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64)))
             .sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ddl = f"conv {kind}, {_BLOCK_SCHEMA}"
    blocks = cut(in_batches(dealt).mapInArrow(lean(_to_blocks(keep_text, _schema(ddl))), ddl))
    fields = ["conv", "gaps", *_COUNTS, "cost", "audit", "sha256", "repaired"]
    out = f"conv {kind}, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, sha256 string, repaired string"
    chained = (blocks.where("NOT done").repartition("conv").sortWithinPartitions("conv", "part", "no")
               .mapInArrow(lean(_to_conversations(keep_text, _schema(out))), out))
    found = blocks.where("done").select(*fields).unionByName(chained.select(*fields))
    every = (rows if ids is None else ids).select(F.col(conv_id).alias(conv_id)).distinct()
    nothing = {**{c: 0 for c in ("gaps", *_COUNTS, "cost")}, "audit": "", "sha256": hashlib.sha256().hexdigest()}
    return every.join(found, F.col(conv_id).eqNullSafe(F.col("conv")), "left").select(
        conv_id, *(F.coalesce(c, F.lit(v).cast("long" if v == 0 else "string")).alias(c) for c, v in nothing.items()),
        F.when(F.lit(keep_text), F.coalesce("repaired", F.lit(""))).alias("repaired"))
