"""Benchmark decontamination by pigeonhole edit matching (operator 5).

A test item of length L may differ by k = floor(``rate`` * L) edits. Cut into
k + 1 pieces, at least one piece stands unharmed in every text that holds the
item within its budget. All pieces go into one automaton that finds their exact
hits in one pass over a text; each hit names a window, and the window is
verified with Myers' bit-parallel edit distance.

Both sides are normalised alike: lower case, every run of ASCII characters other
than letters and digits is one space (words that are decorated or broken over
lines compare equal); distances count UTF-8 bytes of that form.

An item of fewer than ``SHORT`` words matches on word borders only. Such an item
is no passage, and any text may hold it: it is reported, but drops no document.

Scale: texts are never shuffled; a row is searched by itself. The items are read
by the driver in blocks of about ``block_chars`` characters and sent to the
executors. More items than that make more passes over the texts: each pass is
written before the next block is read, so that one block is held at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_batches, lean

#: Words below which an item needs word borders and drops no document.
SHORT = 3
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str) -> str:
    """Normal form, a character for each byte of its UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()).decode("latin-1")


def is_short(normal: str) -> bool:
    return normal.count(" ") + 1 < SHORT


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 near-equal [start, end) pieces."""
    n = budget + 1
    return [(i * length // n, (i + 1) * length // n) for i in range(n)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, text: str):
        self.n = len(text)
        self.mask: dict[str, int] = defaultdict(int)
        for i, ch in enumerate(text):
            self.mask[ch] |= 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """Least edit distance to any substring of ``text``, and the end of the first such substring."""
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        pv, mv, score, best, end = full, 0, self.n, self.n, 0
        mask = self.mask
        for j, ch in enumerate(text, 1):
            eq = mask.get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph <<= 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            if score < best:
                best, end = score, j
        return best, end


class Items:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.ids, self.texts, self.budget, self.short, self.patterns = [], [], [], [], {}
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            t = normalise(text)
            if not t:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            budget = int(rate * len(t))
            self.short.append(is_short(t))
            if self.short[k]:
                t = f" {t} "
            self.texts.append(t)
            self.budget.append(budget)
            for a, b in pieces(len(t), budget):
                where[t[a:b]].append((k, a))
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item number, least distance) of the items that the text holds."""
        if not text or not self.ids:
            return []
        t = f" {normalise(text)} "
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (size, at) in self.automaton.iter(t):
            for k, offset in at:
                starts[k].append(last + 1 - size - offset)
        found = []
        for k, diagonals in sorted(starts.items()):
            n, budget = len(self.texts[k]), self.budget[k]
            best = budget + 1
            done = None
            for d in sorted(set(diagonals)):
                if best == 0:
                    break
                if done is not None and d <= done:      # the last window holds this one's
                    continue
                edge = 0 if self.short[k] else 1        # only short items see the border spaces
                a, b = max(edge, d - budget), min(d + n + 3 * budget, len(t) - edge)
                done = d + budget
                if d >= 0 and t.startswith(self.texts[k], d):
                    best = 0
                elif budget:
                    if k not in self.patterns:
                        self.patterns[k] = Pattern(self.texts[k])
                    best = min(best, self.patterns[k].search(t[a:b])[0])
            if best <= budget:
                found.append((k, best))
        return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", rate: float = 0.08,
               block_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, distance) for every document that holds an item within
    its edit budget; one row per row of ``docs`` and row of ``benchmark``.

    NULL and empty texts, and items without a letter or digit, match nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    d_kind, i_kind = dict(docs.dtypes)[doc_id], items.schema["item_id"].dataType
    i_arrow = items.select("item_id").limit(0).toArrow().schema.field(0).type
    ready = in_batches(docs).selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")

    def scan(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Items(sent.value, rate)
            for batch in batches:
                row, item, dist = [], [], []
                for i, t in enumerate(batch.column(1)):
                    for k, d in index.matches(t.as_py()):
                        row.append(i)
                        item.append(index.ids[k])
                        dist.append(d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, i_arrow), pa.array(dist, pa.int64())],
                    names=["doc_id", "item_id", "distance"])

        return ready.mapInArrow(lean(run), f"doc_id {d_kind}, item_id {i_kind.simpleString()}, distance long")

    n = _n_blocks(items, block_chars)
    if n == 1:
        return scan(spark.sparkContext.broadcast(_block(items, 0, 1)))
    found = []
    for block in range(n):
        sent = spark.sparkContext.broadcast(_block(items, block, n))
        found.append(cut(scan(sent)))
        sent.destroy()
    return reduce(DataFrame.unionAll, found)


def _n_blocks(items: DataFrame, block_chars: int) -> int:
    return max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))


def _block(items: DataFrame, block: int, blocks: int) -> list[tuple[object, str]]:
    """The (item_id, text) rows of one of ``blocks`` blocks."""
    rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
    return [(r["item_id"], r["text"]) for r in rows]


def drop_leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text",
                 rate: float = 0.08, block_chars: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item of ``SHORT`` or more
    words, decided row by row."""
    spark = docs.sparkSession
    items = (benchmark.select(F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
                      .select(F.lit(None).cast("long").alias("item_id"), "text"))
    at = docs.columns.index(text)

    def without(docs: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Items([r for r in sent.value if not is_short(normalise(r[1]))], rate)
            for batch in batches:
                keep = [not index.matches(t.as_py()) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return in_batches(docs).mapInArrow(lean(run), docs.schema)

    n = _n_blocks(items, block_chars)
    for block in range(n):
        sent = spark.sparkContext.broadcast(_block(items, block, n))
        if n == 1:
            return without(docs, sent)
        docs = cut(without(docs, sent))
        sent.destroy()
    return docs
