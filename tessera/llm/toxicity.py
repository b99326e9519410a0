"""Toxicity scores by weak supervision (operator 1).

1. Lexicon. Over a bounded sample of labelled texts, words and word beginnings
   are counted by class in Spark; those found almost only in toxic texts become
   lexicon voters (a beginning stands in for the words that it covers). Without
   labels, ``SEED`` is the lexicon.
2. Voters. Each lexicon entry, and patterns (several different entries, entries
   in plenty, shouting, marks, insults in the second person), vote on each text.
   The gold label of a sampled text is one more voter.
3. Label model. A two-class generative model gives every voter a rate of firing
   in toxic and in clean texts, fitted by expectation maximisation. What the
   classes leave unexplained, the correlation of the voters' residuals, is
   estimated too: a voter's evidence counts 1 / (1 + its correlations with the
   others), so ten copies of one voter weigh like one.
4. Classifier. Logistic regression on the votes, fitted to the posterior labels.

Texts are scored row by row in one pass; the model is a few hundred numbers sent
with the code. Only the sample's votes (small integers) reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_batches, lean
from tessera.llm.jaccard_join import similar_groups

#: Lexicon used where no labelled text is given.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "trash", "clown", "pathetic", "worthless", "disgusting")

_WORD = re.compile(r"[^\W\d_]+")
_SECOND_PERSON = re.compile(r"\b(?:you|your|you're|ur)\b")
SHORTEST, LONGEST = 3, 10        # lengths of word beginnings

PATTERNS = ("entries>=1", "entries>=2", "entries>=3", "entries>=4", "hits>=3", "hits>=6",
            "dense", "second person", "shouting", "marks", "repeats", "short")


@dataclass
class Lexicon:
    """Entries: whole words, beginnings written with a final '*', and beginnings
    written with a final '+', of which a text must have two different words."""

    entries: Sequence[str]
    words: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    pairs: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for i, e in enumerate(self.entries):
            if e[-1] in "*+":
                (self.starts if e[-1] == "*" else self.pairs)[e[:-1]] = i
            else:
                self.words[e] = i
        self.lengths = sorted({len(s) for s in self.starts.keys() | self.pairs.keys()})

    def votes(self, text: str | None) -> list[int]:
        """Numbers of the voters that fire: entries first, patterns behind them."""
        text = text or ""
        count = Counter(_WORD.findall(text.lower()))
        fired: set[int] = set()
        once: dict[str, int] = {}          # beginnings of pairs, and the count of their first word
        different = hits = 0
        for w, c in count.items():
            found = w in self.words
            if found:
                fired.add(self.words[w])
            for k in self.lengths:
                if k > len(w):
                    break
                start = w[:k]
                if start in self.starts:
                    fired.add(self.starts[start])
                    found = True
                if start in self.pairs:
                    if start not in once:
                        once[start] = c
                    else:
                        fired.add(self.pairs[start])
                        found = True
            if found:
                different += 1
                hits += c
        total = sum(count.values())
        letters = sum(map(len, count)) or 1
        upper = sum(map(str.isupper, text)) if hits else 0
        checks = (different >= 1, different >= 2, different >= 3, different >= 4, hits >= 3, hits >= 6,
                  hits * 50 >= total > 0, bool(hits) and bool(_SECOND_PERSON.search(text.lower())),
                  upper * 2 > letters, text.count("!!") >= 5,
                  total > 20 and 4 * len(count) < total, 0 < total < 40)
        n = len(self.entries)
        return sorted(fired) + [n + i for i, x in enumerate(checks) if x]

    @property
    def size(self) -> int:
        return len(self.entries) + len(PATTERNS)


def _grams(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    starts = Counter(w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return words | {s + "*" for s in starts} | {s + "+" for s, c in starts.items() if c > 1}


def _count_grams(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Texts by class that hold a gram, summed per partition (in parts, if there are many)."""
    def flush(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        counts = [pa.array([c[x] for x in names], pa.int64()) for c in (toxic, clean)]
        toxic.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["gram", "toxic", "clean"])

    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        for t, y in zip(batch.column(0), batch.column(1), strict=True):
            (toxic if y.as_py() else clean).update(_grams(t.as_py()))
            if len(toxic) + len(clean) >= most:
                yield flush(toxic, clean)
    yield flush(toxic, clean)


def choose_entries(grams: Sequence[tuple[str, int, int]], most: int) -> list[str]:
    """Entries by falling support. One that is covered by a chosen one, or says
    the same as a longer one, is left out; pairs are weighed against pairs."""
    chosen: list[tuple[str, int]] = []
    for g, toxic, _ in sorted(grams, key=lambda x: (-x[1], x[0][-1] in "*+", -len(x[0]), x[0])):
        stem, pair = g.rstrip("*+"), g[-1] == "+"
        covered = any((h[-1] in "*+" and stem.startswith(h[:-1])) or (h.rstrip("*+").startswith(stem) and toxic <= n * 1.1)
                      for h, n in chosen if (h[-1] == "+") == pair)
        if not covered:
            chosen.append((g, toxic))
            if len(chosen) == most:
                break
    return [g for g, _ in chosen]


def mine_lexicon(sample: DataFrame, positives: int, precision: float = 0.5, most: int = 300, rows: int = 20_000) -> list[str]:
    """Entries for (text, toxic) rows. Among the texts that hold an entry, the
    share of toxic ones is at least ``precision`` at the lower end of its 98 %
    interval (Wilson; 90 % for pairs, of which there are far fewer to try), and
    3 % of the toxic texts (3 at least) hold it. At most ``rows``
    grams of the highest support are looked at, ``most`` are chosen."""
    least = max(3, math.ceil(0.03 * positives))
    z2 = F.when(F.col("gram").endswith("+"), 1.64 ** 2).otherwise(2.33 ** 2)
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    low = (share + z2 / (2 * n) - F.sqrt(z2 * (share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    found = (sample.select("text", "toxic").mapInArrow(lean(_count_grams), "gram string, toxic long, clean long")
             .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") >= least) & (low >= precision))
             .orderBy(F.desc("toxic"), "gram").limit(rows).collect())
    return choose_entries([tuple(r) for r in found], most)


def dependency_forest(x: np.ndarray, p: np.ndarray, least: float = 0.2) -> list[int]:
    """Parent of each voter, -1 for none: the heaviest forest over pairs whose
    correlation within the classes (``p``: label or posterior) is ``least`` or more."""
    on, off = p @ x / max(p.sum(), 1e-9), (1 - p) @ x / max((1 - p).sum(), 1e-9)
    rest = x - np.outer(p, on) - np.outer(1 - p, off)
    spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
    corr = np.abs((rest.T @ rest) / len(x) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0.0)
    parent = [-1] * x.shape[1]
    seen = np.zeros(x.shape[1], bool)
    for root in range(x.shape[1]):            # a tree from each voter that none has reached
        best, by = np.full(x.shape[1], -1.0), np.full(x.shape[1], -1)
        at = root
        while not seen[at]:
            seen[at] = True
            parent[at] = int(by[at])
            nearer = ~seen & (corr[at] > best)
            best[nearer], by[nearer] = corr[at][nearer], at
            open_ = np.where(seen, -1.0, best)
            if open_.max() >= least:
                at = int(open_.argmax())
    return parent


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20, dependent: bool = True) -> np.ndarray:
    """Posterior probability of the toxic class for rows of 0/1 votes.

    The generative model: a class is drawn, then each voter fires at a rate that
    depends on the class and, where it is correlated with another voter within the
    classes, on that one's vote (``dependency_forest``). EM estimates prior and
    rates. What a voter says that its parent has said already is no evidence.
    ``gold`` (0, 1) starts the estimate and stays a voter with a rate of its own.
    Voters that fire nowhere say nothing and are left out. With ``dependent``
    false all voters are independent given the class.
    """
    x = np.column_stack((votes[:, votes.any(axis=0)], gold)).astype(np.float64)
    p = np.where(gold > 0, 0.95, 0.05)
    parent = np.array([*(dependency_forest(x[:, :-1], gold) if dependent else [-1] * (x.shape[1] - 1)), -1])
    child = np.flatnonzero(parent >= 0)
    free = np.flatnonzero(parent < 0)
    says, told = x[:, child], x[:, parent[child]]
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        on = (p @ x + 0.5 * prior) / (p.sum() + prior)                    # smoothed rates of firing
        off = ((1 - p) @ x + 0.5 * prior) / ((1 - p).sum() + prior)
        on, off = np.clip(on, 1e-4, 1 - 1e-4), np.clip(off, 1e-4, 1 - 1e-4)
        evidence = x[:, free] @ np.log(on / off)[free] + (1 - x[:, free]) @ np.log((1 - on) / (1 - off))[free]
        for given in (told, 1 - told) if len(child) else ():
            # rates where the parent fires, then where it doesn't; few rows count as the classes' common rate
            common = ((given * says).sum(axis=0) + 0.5) / (given.sum(axis=0) + 1)
            yes, no = ((w @ (given * says) + common) / (w @ given + 1) for w in (p, 1 - p))
            yes, no = np.clip(yes, 1e-4, 1 - 1e-4), np.clip(no, 1e-4, 1 - 1e-4)
            evidence += (given * says) @ np.log(yes / no) + (given * (1 - says)) @ np.log((1 - yes) / (1 - no))
        new = 1 / (1 + np.exp(-np.clip(evidence + math.log(prior / (1 - prior)), -50, 50)))
        if np.abs(new - p).max() < 1e-4:
            return new
        p = new
    return p


def prior_weights(entries: int) -> np.ndarray:
    """What is believed without labels: one entry gives 0.5, two 0.9 or more."""
    return np.array([1.0] * entries + [1.2, 1.2] + [0.6] * 2 + [0.0] * (len(PATTERNS) - 4) + [-2.2])


def fit_logistic(x: np.ndarray, p: np.ndarray, prior: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of logistic regression on soft labels, by Newton steps;
    weights that the labels say little about stay near ``prior``."""
    x = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0.0, z) - p * z).sum() + 0.5 * (penalty * (w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - q) - penalty * (w - prior))
        for _ in range(30):                   # where a class is far off, a whole step overshoots
            if (new := loss(w + step)) <= now:
                break
            step = step / 2
        else:
            break
        w, now = w + step, new
        if np.abs(step).max() < 1e-6:
            break
    return w


def _votes(entries: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lexicon.votes(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32())), batch.column(1)],
                names=["votes", "toxic"])

    return run


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray

    def scorer(self):
        entries, weights = self.entries, self.weights.tolist()

        def score(texts: Iterator[str | None]) -> list[float]:
            lexicon = Lexicon(entries)
            return [1 / (1 + math.exp(-max(-50.0, min(50.0, weights[-1] + sum(weights[i] for i in lexicon.votes(t))))))
                    for t in texts]

        return score


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", train_rows: int = 12_000) -> Model:
    """Fit on at most ``train_rows`` labelled texts, those of the smallest id hashes.

    Rows with a NULL id or label are not used; an id with several labels is toxic
    if one says so, and one with several texts has the least; of near copies (the
    groups of the n-gram join over the sample) with one label the least id counts,
    lest their words pass for evidence. The seed lexicon is always among the voters;
    without toxic and clean texts it decides, one entry giving a score of 0.5 and
    two 0.9 or more.
    """
    ids = cut(labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
              .groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("id")).limit(train_rows))
    texts = cut(in_batches(docs).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
                .join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    groups = similar_groups(texts, "id").select(F.col("doc_id").alias("id"), F.col("component_id").alias("group"))
    first = texts.select("id", "toxic").join(groups, "id").groupBy("group", "toxic").agg(F.min("id").alias("id"))
    sample = cut(texts.join(first.select("id"), "id").select("text", "toxic"))
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 4:
        return Model([*SEED], prior_weights(len(SEED)))
    entries = mine_lexicon(sample, n[1])
    entries += [w for w in SEED if w not in entries]
    rows = sample.mapInArrow(lean(_votes(entries)), "votes array<int>, toxic int").collect()
    x = np.zeros((len(rows), len(entries) + len(PATTERNS)))
    for i, r in enumerate(rows):
        x[i, r[0]] = 1.0
    gold = np.array([r[1] for r in rows])
    order = np.lexsort((*x.T[:8], gold))          # the same sums in whatever order the rows came
    return Model(entries, fit_logistic(x[order], label_model(x[order], gold[order]), prior_weights(len(entries))))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. NULL and empty texts are scored as ''."""
    kind = dict(docs.dtypes)[doc_id]
    run_score = model.scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = run_score(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return (in_batches(docs).selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(lean(run), f"doc_id {kind}, score double")
                .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more."""
    at = docs.columns.index(text)
    run_score = model.scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = run_score(t.as_py() for t in batch.column(at))
            yield batch.filter(pa.array([x < threshold for x in s], pa.bool_()))

    return in_batches(docs).mapInArrow(lean(run), docs.schema)
