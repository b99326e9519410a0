"""Conversation repair against a plain cheapest-path search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as cr
from tessera.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def sp(v):
    return " " if v is None else v


def first_faults(rows):
    """rows: (role, text) in order -> first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def plain_best(rows, faults):
    """(cost, audit, lines) by an exhaustive table over (rows used, last initial),
    built from the end, all strings spelled out."""
    n = len(rows)
    nxt = {"": "su", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}
    after = {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}
    for i in range(n - 1, -1, -1):
        role, text = rows[i]
        must_go, extra = faults[i] in ("blank", "duplicate"), 3 * (faults[i] == "truncated")
        own = {}
        for q in nxt:
            ways = [(4 + after[q][0], "D" + after[q][1], after[q][2])]
            if not must_go:
                for letter, to, cost in [("K", role, 0)] + [("R", role_of[x], 3) for x in "ua"]:
                    if to[:1] in tuple(nxt[q]) and to[:1]:
                        c, a, lines = after[to[:1]]
                        ways.append((cost + extra + c, letter + a, (f"{to}:{text}", *lines)))
            own[q] = min(ways)
        for _ in range(3):
            for q in nxt:
                for x in "ua":
                    if x in nxt[q]:
                        c, a, lines = own[x]
                        own[q] = min(own[q], (3 + c, "I" + a, (f"{role_of[x]}:", *lines)))
        after = own
    return after[""]


def plain(rows, ids):
    """Expected rows for rows (conv, turn, role, text) after damage."""
    convs = {i: [] for i in ids}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in convs.items():
        own = sorted(((t, sp(r), sp(x)) for _, t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [(r, x) for _, r, x in own]
        turns = {t for t, _, _ in own if t is not None}
        faults = first_faults(pairs)
        cost, audit, lines = plain_best(pairs, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines))
    return out


def plain_damage(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if k == 4 else sp(role), "" if k == 1 else sp(text)
        if k == 2:
            text = re.sub("[.!?]", "", text)
        yield from [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def got(df, **options):
    return {r[0]: tuple(r)[1:] for r in cr.repair(df, keep_text=True, **options).collect()}


def conversation(rnd, conv, n):
    rows = []
    for t in range(n):
        role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
        text = rnd.choice(["Yes.", "No!", "Why", "", " \t", None, "Hm. ", "x" * rnd.randrange(5) + "?", f"t{t}.", f"u{t}"])
        rows.append((conv, rnd.choice([t, t, t, t + 1, None, 3 * t]), role, text))
    return rows


def alternating(rnd, conv, n):
    return [(conv, t, ["user", "assistant"][(t + (rnd.random() < 0.1)) % 2], f"text {t}{rnd.choice(['.', '.', '', '?'])}") for t in range(n)]


def test_random_conversations(spark):
    rnd = random.Random(1)
    rows = [r for c in range(250) for r in conversation(rnd, c, rnd.randrange(1, 14))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(df) == plain(rows, [])


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rnd = random.Random(block)
    rows = [r for c in range(30) for r in conversation(rnd, c, rnd.randrange(1, 40))]
    rows += [r for c in (100, None) for r in alternating(rnd, c, 150)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows, [])


def test_one_hot_conversation_is_spread(spark):
    rnd = random.Random(4)
    rows = alternating(rnd, 5, 3000) + [r for c in range(10, 400) for r in conversation(rnd, c, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain(rows, [])


def test_many_equal_rows(spark):
    rows = [(1, None, None, None)] * 900 + [(1, 0, "user", "Hi.")] * 700 + [(1, 1, "assistant", "Yes.")] * 2 + [(None, None, None, None)] * 5
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows, [])


def test_search_equals_the_table_for_every_short_conversation():
    kinds = [(r, f) for r in ("system", "user", "assistant", "x") for f in ("", "truncated", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            pairs, faults = [(r, str(i)) for i, (r, _) in enumerate(rows)], [f for _, f in rows]
            items = [{"turn": i, "role": r, "text": x, "fault": f} for i, ((r, x), f) in enumerate(zip(pairs, faults))]
            want = plain_best(pairs, faults)
            chain = cr.Chain(True)
            for k in range(0, n, 2):         # blocks of two
                block = cr._open(cr._block(items[k:k + 2]))
                chain.add({(m["a"], m["b"]): (m["cost"], m["audit"]) for m in block["moves"]}, block["roles"], block["texts"])
            cost, audit, _, text = chain.end()
            assert (cost, audit, text) == (want[0], want[1], "\n".join(want[2]))


def test_search_stays_small_on_long_blocks():
    rnd = random.Random(2)
    for make in (lambda i: "a" if i % 2 else "u", lambda i: "u" if i % 2 else "a", lambda i: rnd.choice("sua"), lambda i: "s"):
        rows = [(make(i), rnd.random() < 0.1, rnd.random() < 0.3) for i in range(2000)]
        found = cr.cheapest(rows, "a", cr.suffix_bounds(rows))
        assert min(c for c, _ in found.values()) == cr.suffix_bounds(rows)[0]["a"]


def test_damage_and_conversations_that_lose_all_rows(spark):
    rnd = random.Random(8)
    rows = [r for c in [None, *range(400)] for r in conversation(rnd, c, rnd.randrange(1, 4))]
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = list(plain_damage(rows))
    assert sorted(map(str, damaged)) == sorted(str(tuple(r)) for r in cr.damage(df).collect())
    want = plain(damaged, [r[0] for r in rows])
    assert got(cr.damage(df), ids=df) == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest(), "") in want.values()


def test_empty_table_and_clashing_columns(spark):
    rnd = random.Random(9)
    rows = conversation(rnd, 1, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("conv", "part", "no", "same", "when", "copies", "blank", "c", "audit", "times"):
        df = df.withColumn(c, F.lit("x"))
    assert got(df) == plain(rows, [])
    assert got(cr.damage(df), ids=df) == plain(list(plain_damage(rows)), [1])
    assert got(df.limit(0)) == {}


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: v[:-1] for k, v in plain(list(plain_damage(rows)), [r[0] for r in rows]).items()}
    cols = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, sf).select(*cols).collect()} == want
