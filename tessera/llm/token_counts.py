"""Token counts (operator 13): byte-level BPE by rank-synchronous array merging.

The pre-tokens of a batch of texts are held once each, as one ragged array of
symbols. In every round each sequence finds its lowest-rank pair and all
sequences merge the occurrences of theirs at once; a sequence without a
mergeable pair leaves. What survives of a sequence is its number of tokens.

A round equals the one-merge-at-a-time order because a merge can only make
pairs of higher rank: the symbol it makes is used by later merges only (checked
when the vocabulary is read). Occurrences that overlap ("aaa") are taken from
the left. Ranks are looked up again only beside the symbols just made.

A row is counted by itself, over its whole text, and nothing is shuffled. The
merge table (50,000 pairs, about 1 MB; its size is the vocabulary's, not the
data's) is read by the driver and broadcast, so executors need no file. Memory
is bounded by a slice of texts; a longer text is worked on in runs of
pre-tokens. A single pre-token of n bytes takes at most one round per distinct
rank in it, a round a pass over what is left of it.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_CHARS, in_batches, lean, slices

# Fixed: the pattern of the byte-level pre-tokenizer.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Pre-tokens worked on at a time, and different ones remembered by a task.
RUN = 1 << 17
KNOWN = 1 << 18
NONE = np.int32(np.iinfo(np.int32).max)


class Merges(NamedTuple):
    """A vocabulary as arrays: ``base[byte]`` is a byte's symbol; ``keys`` are the
    mergeable pairs (left << 32 | right), sorted, with their ``ranks``; a pair of
    rank r makes ``made[r]``. ``specials`` are strings that are one token each."""
    base: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    specials: tuple[str, ...]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1
    for itself, the others in order from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_merges(path: str) -> Merges:
    """The vocabulary of a byte-level BPE file. Files that ask for more than this
    operator does (normalizers, prefix spaces, greedy strips) are refused."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level BPE with the usual pre-tokenizer")
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
           if model.get(k)]
    added = spec.get("added_tokens") or []
    if odd or spec.get("normalizer") or pre.get("add_prefix_space") or any(
            t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: unsupported settings {odd}")
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, made = (np.array([ids[x] for x in xs], dtype=np.int64)
                         for xs in (*zip(*pairs), [a + b for a, b in pairs]))
    base = np.array([ids[c] for c in byte_letters()], dtype=np.int64)
    born = dict.fromkeys(base.tolist(), -1)
    for rank, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist())):
        if born.get(a, rank) >= rank or born.get(b, rank) >= rank or c in born:
            raise ValueError(f"{path}: merge {rank} uses a symbol that no earlier merge makes, or makes one again")
        born[c] = rank
    keys = left << 32 | right
    order = np.argsort(keys)
    return Merges(base, keys[order], order.astype(np.int32), made, tuple(t["content"] for t in added))


def _ranks(left: np.ndarray, right: np.ndarray, merges: Merges) -> np.ndarray:
    keys = left << 32 | right
    at = np.minimum(np.searchsorted(merges.keys, keys), len(merges.keys) - 1)
    return np.where(merges.keys[at] == keys, merges.ranks[at], NONE)


def merged_lengths(data: bytes, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Number of tokens of each sequence of bytes; ``lengths`` cut ``data``."""
    counts = lengths.astype(np.int64)
    symbol = merges.base[np.frombuffer(data, dtype=np.uint8)]
    seq = np.repeat(np.arange(len(lengths)), lengths)
    if not len(symbol):
        return counts
    rank = np.full(len(symbol), NONE)      # of the pair that starts here
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inner] = _ranks(symbol[inner], symbol[inner + 1], merges)
    while True:
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(seq)]))
        keep = low < NONE                  # sequences that still merge
        hits = np.flatnonzero((rank == low) & keep)
        if not len(hits):
            return counts
        first = np.r_[True, hits[1:] != hits[:-1] + 1]
        run_start = np.maximum.accumulate(np.where(first, hits, 0))
        hits = hits[(hits - run_start) % 2 == 0]
        symbol[hits] = merges.made[rank[hits]]
        counts -= np.bincount(seq[hits], minlength=len(counts))
        keep[hits + 1] = False
        hits = (np.cumsum(keep) - 1)[hits]
        symbol, seq, rank = symbol[keep], seq[keep], rank[keep]
        around = np.r_[hits, hits[hits > 0] - 1]
        last = np.r_[seq[1:] != seq[:-1], True][around]
        rank[around[last]] = NONE
        around = around[~last]
        rank[around] = _ranks(symbol[around], symbol[around + 1], merges)


class _Numbers(dict):
    """Numbers new keys in order."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Counter:
    """Counts the tokens of texts. Pre-tokens that were merged before are known
    by number, up to ``KNOWN`` of them; then the numbering starts anew."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words = regex.compile(PATTERN)
        special = "|".join(regex.escape(s) for s in sorted(merges.specials, key=len, reverse=True))
        self.special = regex.compile(special) if special else None
        self.numbers, self.sizes = _Numbers(), np.zeros(0, dtype=np.int64)

    def _runs(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text that holds no special string, in runs."""
        if len(text) <= SLICE_CHARS:
            yield self.words.findall(text)
            return
        found = (m[0] for m in self.words.finditer(text))
        while run := list(itertools.islice(found, RUN)):
            yield run

    def _merge_new(self) -> None:
        """Sizes of the words numbered since the last call."""
        words = [w.encode() for w in itertools.islice(self.numbers, len(self.sizes), None)]
        new = merged_lengths(b"".join(words), np.fromiter(map(len, words), np.int64, len(words)), self.merges)
        self.sizes = np.r_[self.sizes, new]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        uses, owners, held = [], [], 0

        def settle():
            self._merge_new()
            if uses:
                ends = np.cumsum([len(u) for u in uses])
                total = np.r_[0, np.cumsum(self.sizes[np.concatenate(uses)])][ends]
                np.add.at(out, owners, np.diff(np.r_[0, total]))
            uses.clear(), owners.clear()
            if len(self.numbers) > KNOWN:
                self.numbers, self.sizes = _Numbers(), np.zeros(0, dtype=np.int64)

        for i, text in enumerate(texts):
            parts = [text or ""]
            if self.special and text:
                parts = self.special.split(text)
                out[i] += len(parts) - 1          # a special string is one token
            for part in parts:
                for run in self._runs(part):
                    uses.append(np.fromiter(map(self.numbers.__getitem__, run), np.int64, len(run)))
                    owners.append(i)
                    held += len(run)
                    if held >= RUN:
                        settle()
                        held = 0
        settle()
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the file's path on the driver. A NULL or empty text has 0
    bytes and 0 tokens; a special token's string inside a text is one token, as
    the file's library has it; nothing is cut, padded or added. Repeated rows
    and a NULL id stay; other columns are not read.
    """
    kind = dict(docs.dtypes)[doc_id]
    merges = docs.sparkSession.sparkContext.broadcast(tuple(read_merges(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Merges(*merges.value))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = [counter.counts(texts[a:b]) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else [], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col(doc_id).alias("doc_id"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                        F.col(text).alias("text"))
    return (in_batches(sized).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
