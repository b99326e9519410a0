"""Exact Jaccard self-join of documents on word n-grams (operator 6).

A document is the set of its distinct n-word shingles. Two sets link when their
Jaccard similarity reaches the threshold t, and documents form groups by links.

Universe-partition pigeonhole. Sets fall into size bands [2**k, 2**(k+1)). A band
hashes the universe of shingles into M segments; a set's part in a segment is
its subset there. Linked sets x and y, |x| <= |y|, differ in at most
H = floor(|x| (1 - t) / t) shingles, so of segments of x with a weight of H + 1
or more at least one agrees. A segment weighs 1 if an equal subset is looked
for, and 2 if the subsets with one shingle deleted are indexed too: then subsets
that miss each other differ in at least two shingles. A set indexes all its
segments in its own band, and in the band below if a linked set may lie there;
the smaller set looks for the larger one in its own band.

Cost-based allocation, twice:
* per band, the cheapest of ``SETTINGS`` (segment size, deletions or not) under
  which every set of the band has the weight it needs;
* per set, which segments to look at: it may leave out a weight of
  (all - H - 1), and leaves out the segments with the most other sets. A passage
  that a third of all documents share fills some segments; these are left out,
  and nothing is lost by it. Segments that no other set has cost nothing.

Candidates are verified on the whole sets, in two steps. First every set is
verified against the one representative that it meets most; a segment's
representative is its most central set, whose segments have the most sets. That
joins the bulk of a group of near copies in as many comparisons as it has
members. Then every candidate pair whose sets lie in different groups so far is
verified (pairs within one group can't change the result): pair by pair where
the segment has at most ``SMALL`` sets, else in tiles. The large segments that
some set looks at form clusters; a cluster's sets outside its largest group are
compared with all of its sets, block by block, by counting common shingles in
0/1 matrices. A tile returns at most one link per set.

Sets meet by signature. Signatures of very many sets are found beforehand from a
sample of the sets; their sets are dealt over as many tasks as their number asks
for. The sample decides where rows go, not which.

Exact copies are one set throughout. What is shuffled is three numbers a
segment, never texts; the shingles of a set move only where it is a candidate.
Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, give_back, in_batches, lean, slices
from tessera.llm.components import connected, least_labels
from tessera.llm.words import LOWER, U, mix, shingle_sets

#: (shingles per segment at the band's upper end, are deletions indexed), cheapest first.
SETTINGS = [(3.0, False), (2.5, False), (2.0, False), (1.5, False), (1.5, True), (1.0, True),
            *((2.0 ** -i, True) for i in range(1, 40))]
#: From this setting on each one's segments are halves of the one's before; the
#: settings up to it, by segment size.
NESTED = 5
TRIED = [(0,), (1,), (2,), (3, 4), (5,)]
#: Ids up to this many are sent to every task; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Segments with more sets are compared in tiles.
SMALL = 16
#: A signature with about this many sets or more is dealt over several tasks, each
#: with about so many; it is found among one set in ``SAMPLED``. At most ``MOST_HOT``
#: are known (the largest).
HOT_SETS, SAMPLED, MOST_HOT = 1 << 16, 64, 10_000
#: Sets and shingles of a block of a tile, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000


class Bound:
    """Integer forms of the threshold."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:        # below, a set may differ from a linked one in all its segments
            raise ValueError("percent must be over 50 and at most 100")
        self.percent = percent

    def differ(self, n: np.ndarray) -> np.ndarray:
        """Most shingles in which a set of ``n`` and a linked set no smaller differ."""
        return n * (100 - self.percent) // self.percent

    def least(self, n: np.ndarray) -> np.ndarray:
        """Least size of a set that a set of ``n`` can link with."""
        return -(-n * self.percent // 100)

    def linked(self, common, n, m):
        return 100 * common >= self.percent * (n + m - common)


def _segments(band: int, setting: int) -> int:
    size = Fraction(SETTINGS[setting][0])
    return max(1, int(((1 << band + 1) - 1) / size))


def _parts(g: np.ndarray, owner: np.ndarray, band: int, setting: int):
    """Subsets by (set, segment): order of the shingles, start of each subset, its
    size, its set and a hash of (band, segment, subset)."""
    m = _segments(band, setting)
    seed = U(0x51ED270B * (band + 1))
    segment = (mix(g ^ seed) >> U(11)) % U(m)
    if len(owner) and (int(owner[-1]) + 1) * m < 1 << 62:
        order = np.argsort(owner.astype(U) * U(m) + segment)
    else:
        order = np.lexsort((segment, owner))
    own, seg = owner[order], segment[order]
    first = np.ones(len(g), bool)
    first[1:] = (own[1:] != own[:-1]) | (seg[1:] != seg[:-1])
    start = np.flatnonzero(first)
    total = np.add.reduceat(mix(g[order] + seed), start) if len(start) else np.zeros(0, U)
    return order, start, np.diff(np.append(start, len(g))), own[start], total, mix(seg[start] * U(64) + U(band))


def _weights(sizes: np.ndarray, owner: np.ndarray, n_sets: int, deletions: bool) -> np.ndarray:
    return np.bincount(owner, weights=np.minimum(sizes, 2) if deletions else np.ones(len(sizes)), minlength=n_sets).astype(np.int64)


class Sets:
    """Shingle sets of a slice of texts, without the empty ones: ``rows`` are
    their texts' numbers, ``n`` sizes, ``sid`` hashes of the sets."""

    def __init__(self, texts: list[str | None], words: int):
        g, bounds = shingle_sets([(t or "").encode("utf-8", "replace").translate(LOWER) for t in texts], words)
        n = np.diff(bounds)
        self.rows = np.flatnonzero(n)
        self.n = n[self.rows]
        self.g = g
        self.starts = bounds[:-1][self.rows]
        self.sid = mix(np.add.reduceat(mix(g + U(0x5DEECE66D)), self.starts) + self.n.astype(U)).view(np.int64) if len(g) else np.zeros(0, np.int64)
        self.band = np.floor(np.log2(np.maximum(self.n, 1))).astype(np.int64)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the chosen sets and each one's place in ``which``."""
        n = self.n[which]
        owner = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[which], n)
        return self.g[at], owner


def _weights_under(g: np.ndarray, owner: np.ndarray, n_sets: int, band: int, settings: tuple[int, ...]) -> list[np.ndarray]:
    """Weight of each set under settings of one segment size."""
    m = _segments(band, settings[0])
    segment = (mix(g ^ U(0x51ED270B * (band + 1))) >> U(11)) % U(m)
    if n_sets * m <= 16 * len(g) + 1024:
        sizes = np.bincount(owner * m + segment.astype(np.int64), minlength=n_sets * m).reshape(n_sets, m)
        return [(np.minimum(sizes, 2) if SETTINGS[k][1] else sizes > 0).sum(axis=1) for k in settings]
    _, _, sizes, of, _, _ = _parts(g, owner, band, settings[0])
    return [_weights(sizes, of, n_sets, SETTINGS[k][1]) for k in settings]


def _failing_settings(s: Sets, bound: Bound) -> np.ndarray:
    """Bit k: under setting k the set lacks the weight it needs. Settings of
    different sizes split the shingles independently, so each is tried; from
    ``NESTED`` on every setting halves the segments of the one before, and a set
    with the weight it needs keeps it."""
    out = np.zeros(len(s.n), np.int64)
    for band in np.unique(s.band):
        here = np.flatnonzero(s.band == band)
        g, owner = s.of(here)
        most = bound.differ(s.n[here])
        for settings in TRIED:
            for k, weight in zip(settings, _weights_under(g, owner, len(here), int(band), settings), strict=True):
                out[here] |= (weight <= most).astype(np.int64) << k
        left = here[out[here] >> NESTED & 1 > 0]
        for k in range(NESTED + 1, len(SETTINGS)):
            if not len(left):
                break
            g, owner = s.of(left)
            left = left[_weights_under(g, owner, len(left), int(band), (k,))[0] <= bound.differ(s.n[left])]
            out[left] |= 1 << k
    return out


def _cheapest(failing: int) -> int:
    """The first setting that fails for no set of a band."""
    for k in range(len(SETTINGS)):
        if not failing >> k & 1:
            return k
    raise ValueError("no setting gives every set of a band the weight it needs")


def _signatures(s: Sets, bound: Bound, settings: dict[int, int], done: set[int]):
    """(signature, sid, slack) of sets not done yet; slack: the weight that a set
    may leave out where it looks for others, -1 where it is only found."""
    new = np.array([i for i, x in enumerate(s.sid.tolist()) if not (x in done or done.add(x))], np.int64)
    for band in np.unique(s.band[new]) if len(new) else ():
        here = new[s.band[new] == band]
        below = here[bound.least(s.n[here]) < 1 << int(band)]
        for which, k, own in ((here, int(band), True), (below, int(band) - 1, False)):
            if not len(which) or k not in settings:      # no set looks for others in a band without sets
                continue
            deletions = SETTINGS[settings[k]][1]
            g, owner = s.of(which)
            order, start, sizes, of, total, segment = _parts(g, owner, k, settings[k])
            slack = np.full(len(which), -1, np.int64)
            if own:
                slack = _weights(sizes, of, len(which), deletions) - bound.differ(s.n[which]) - 1
                if (slack < 0).any():
                    raise ValueError("a set lacks the weight to find the sets it links with")
                if deletions:
                    slack[:] = 0                          # small sets look at everything
            yield mix(segment ^ total), s.sid[which][of], slack[of]
            if deletions:
                part = np.repeat(np.arange(len(start)), sizes)
                many = sizes[part] > 1
                part = part[many]
                rest = total[part] - mix(g[order][many] + U(0x51ED270B * (k + 1)))
                yield mix(segment[part] ^ rest), s.sid[which][of[part]], slack[of[part]]


def _batches(names: list[str], parts: list, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
    for i in range(0, len(cols[0]) if cols else 0, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + rows]) for c in cols], names=names)


def _texts(batches: Iterator[pa.RecordBatch], words: int):
    """(batch, first row, Sets) of every slice of the texts in column 1."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            yield batch, a, b, Sets(texts[a:b], words)


def _describe(words: int, bound: Bound):
    def run(batches):
        for batch, a, b, s in _texts(batches, words):
            n, sid, failing = (np.zeros(b - a, np.int64) for _ in range(3))
            n[s.rows], sid[s.rows], failing[s.rows] = s.n, s.sid, _failing_settings(s, bound)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(sid, mask=n == 0), pa.array(failing)],
                names=["doc_id", "n", "sid", "failing"])

    return run


def _index(words: int, bound: Bound, settings: dict[int, int]):
    def run(batches):
        done: set[int] = set()
        for _, _, _, s in _texts(batches, words):
            parts = [(x.view(np.int64), sid, slack.astype(np.int32)) for x, sid, slack in _signatures(s, bound, settings, done)]
            yield from _batches(["sig", "sid", "slack"], parts)

    return run


def _shared(batches: Iterator[pa.RecordBatch], spill: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (sig, sid, slack, known) sorted by signature: those of signatures with
    two or more sets, with the number of rows. ``known`` is the estimated number of
    a signature whose rows are in other tasks as well, else 0. A signature with
    over ``spill`` rows is passed on in pieces; its number is then a lower bound
    (it only orders costs)."""
    names = ["sig", "sid", "slack", "sets"]
    held: list[np.ndarray] | None = None
    last, base = None, 0                   # of a signature passed on in pieces

    def out(cols: list[np.ndarray], start_count: int):
        sig, sid, slack, known = cols
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(sig)))
        size = np.maximum(size, known[at])
        several = (np.minimum.reduceat(sid, at) != np.maximum.reduceat(sid, at)) | (known[at] > 0)
        if start_count:
            several[0] = True
            size[0] += start_count
        part = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(sig))))
        keep = several[part]
        if keep.any():
            yield from _batches(names, [(sig[keep], sid[keep], slack[keep], size[part[keep]].astype(np.int64))])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        sig = held[0]
        cut_at = int(np.searchsorted(sig == sig[-1], True)) if len(sig) else 0
        if cut_at:
            yield from out([c[:cut_at] for c in held], base if base and sig[0] == last else 0)
            held = [c[cut_at:] for c in held]
        if len(held[0]) > spill:
            count = base if base and held[0][0] == last else 0
            if count or held[3][0] or (held[1] != held[1][0]).any():
                yield from out(held, count)
                last, base = held[0][0], count + len(held[0])
                held = [c[:0] for c in held]
            else:
                held = [c[:1] for c in held]     # one set again and again
    if held is not None and len(held[0]):
        yield from out(held, base if base and held[0][0] == last else 0)


def _members(words: int):
    def run(batches):
        for batch, a, b, s in _texts(batches, words):
            ends = s.starts + s.n
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.sid), pa.array([s.g[i:j].tobytes() for i, j in zip(s.starts, ends, strict=True)], pa.binary())],
                names=["sid", "shingles"])

    return run


def _verify(bound: Bound):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(bound.linked(common, len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def common_shingles(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Numbers of common shingles of the sets of x (rows) and y (columns)."""
    flat = [np.concatenate(s) for s in (x, y)]
    owner = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), np.float32)
    place = [np.searchsorted(both, f) for f in flat]
    known = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool)
             for p, f in zip(place, flat, strict=True)]
    for a in range(0, len(both), width):
        w = min(width, len(both) - a)
        m = []
        for k, s in enumerate((x, y)):
            here = known[k] & (place[k] >= a) & (place[k] < a + w)
            block = np.zeros((len(s), w), np.float32)
            block[owner[k][here], place[k][here] - a] = 1.0
            m.append(block)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _tile(bound: Bound):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid", ignore_index=True)
        sid, left = pdf["sid"].to_numpy(), pdf["left"].to_numpy()
        sets = [np.frombuffer(b, U) for b in pdf["shingles"]]
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(i) or not len(j):
            return pd.DataFrame({"a": sid[:0], "b": sid[:0]})
        size = np.array([len(s) for s in sets])
        common = common_shingles([sets[k] for k in i], [sets[k] for k in j])
        a, b = np.nonzero(bound.linked(common, size[i][:, None], size[j][None, :]))
        # a set that lies on both sides is one node
        node = np.searchsorted(sid, sid)
        label = least_labels(len(sid), node[i[a]], node[j[b]])[node]
        some = np.unique(np.concatenate((i[a], j[b]))) if len(a) else i[:0]
        some = some[label[some] != node[some]]
        give_back()
        return pd.DataFrame({"a": sid[some], "b": sid[label[some]]})

    return run


def _sent(df: DataFrame) -> DataFrame:
    """A broadcast side if its rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _linked_in_tiles(rows: DataFrame, shingles_of, bound: Bound) -> DataFrame:
    """Links among the sets of large segments: rows (sig, sid, group, n, looks)."""
    looks = rows.where("looks").select("sid", "sig")
    ties = looks.join(looks.groupBy("sid").agg(F.min("sig").alias("b")), "sid").select(F.col("sig").alias("a"), "b")
    clusters = connected(ties).toDF("sig", "cluster")
    sets = cut(rows.join(clusters, "sig", "left").select(F.coalesce("cluster", "sig").alias("cluster"), "sid", "group", "n").distinct())
    main = (sets.groupBy("cluster", "group").agg(F.count("*").alias("c"))
                .groupBy("cluster").agg(F.max(F.struct("c", "group")).alias("most")).select("cluster", F.col("most.group").alias("main")))
    sets = sets.join(main, "cluster").withColumn("odd", F.col("group") != F.col("main"))

    def blocks(which):
        """Number of blocks for the rows of a cluster."""
        return F.ceil(F.greatest(F.sum(which.cast("int")) / BLOCK_SETS, F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")

    counts = sets.groupBy("cluster").agg(blocks(F.col("odd")).alias("is"), blocks(F.lit(True)).alias("js"))
    full = sets.join(counts, "cluster").join(shingles_of(sets), "sid")
    block = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = full.where("odd").withColumn("i", block("is")).withColumn("j", each("js")).withColumn("left", F.lit(True))
    right = full.withColumn("j", block("js")).withColumn("i", each("is")).withColumn("left", F.lit(False))
    return cut(left.unionByName(right).select("cluster", "i", "j", "left", "sid", "shingles")
                   .groupBy("cluster", "i", "j").applyInPandas(_tile(bound), "a long, b long"))


def _hot(sets: DataFrame, signed_of) -> DataFrame:
    """(hot, known, parts): signatures of about ``HOT_SETS`` sets or more, their
    estimated number of sets and the number of tasks to deal them over.
    ``signed_of`` gives the signatures of the sets of some documents."""
    some = sets.where(F.pmod("sid", F.lit(SAMPLED)) == 0).select(F.col("rep_doc").alias("doc_id"))
    known = (F.count_distinct("sid") * SAMPLED).alias("known")
    return cut(signed_of(some).groupBy(F.col("sig").alias("hot")).agg(known).where(F.col("known") >= HOT_SETS)
               .orderBy(F.desc("known"), "hot").limit(MOST_HOT)
               .withColumn("parts", F.ceil(F.col("known") / HOT_SETS + 1).cast("long")))


def _dealt(signed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(sig, sid, slack, known), the rows of a signature in one partition, those of
    a hot one in several, by set."""
    if hot is None:
        return signed.withColumn("known", F.lit(0).cast("long")).repartition("sig").sortWithinPartitions("sig")
    return (signed.join(F.broadcast(hot), F.col("sig") == F.col("hot"), "left")        # at most MOST_HOT rows
            .select("sig", "sid", "slack", F.coalesce("known", F.lit(0)).alias("known"),
                    F.coalesce(F.pmod(F.xxhash64("sid"), F.col("parts")), F.lit(0)).alias("part"))
            .repartition("sig", "part").sortWithinPartitions("sig").drop("part"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                   percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of characters other than space and \\t\\n\\v\\f\\r, A-Z
    lower-cased. A text of 1 to ``words`` - 1 words has its whole sequence as its
    one shingle; NULL and empty texts have none and link with nothing. Sets link
    when 100 * common >= percent * union (over 50). A row without a doc_id links with
    nothing and has no component. Repeated rows are copies of each other.
    """
    return (_grouped(docs, doc_id, text, words, percent)
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, sid (the set's number, NULL without
    words), component (NULL without doc_id or words)."""
    bound = Bound(percent)
    ready = in_batches(docs).selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = dict(docs.dtypes)[doc_id]
    described = cut(ready.mapInArrow(lean(_describe(words, bound)), f"doc_id {kind}, n long, sid long, failing long"))
    sets = cut(described.where("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid")
               .agg(F.min("doc_id").alias("rep_doc"), F.max("n").alias("n"), F.bit_or("failing").alias("failing")))
    settings = {r[0]: _cheapest(r[1]) for r in sets.groupBy((F.length(F.bin("n")) - 1).cast("int")).agg(F.bit_or("failing")).collect()}

    def signed(texts: DataFrame) -> DataFrame:
        return texts.where("doc_id IS NOT NULL").mapInArrow(lean(_index(words, bound, settings)), "sig long, sid long, slack int")

    # with fewer sets, no signature can be hot
    hot = _hot(sets, lambda ids: signed(ready.join(_sent(ids), "doc_id", "left_semi"))) if sets.count() >= HOT_SETS else None
    met = cut(_dealt(signed(ready), hot)
                    .mapInArrow(lean(_shared), "sig long, sid long, slack int, sets long").distinct())
    costly = Window.partitionBy("sid").orderBy(F.desc("sets"), "sig")
    picked = cut(met.where("slack >= 0").withColumn("place", F.row_number().over(costly))
                    .where("place > slack").select("sig", "sid"))
    size = sets.select("sid", "n")

    def shingles_of(ids: DataFrame) -> DataFrame:
        """(sid, shingles) of the sets named, from the texts of one document each."""
        wanted = cut(sets.join(ids.select("sid").distinct(), "sid").select(F.col("rep_doc").alias("doc_id"), "sid"))
        return cut(ready.join(_sent(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
                        .mapInArrow(lean(_members(words)), "sid long, shingles binary")
                        .join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = cut(pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
                         .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b"))
        full = shingles_of(pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")))
        both = pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return cut(both.mapInArrow(lean(_verify(bound)), "a long, b long"))

    # every set against the representative that it meets most
    central = met.groupBy("sid").agg(F.sum("sets").alias("meets"))
    rep = (met.join(picked.select("sig").distinct(), "sig", "left_semi").join(central, "sid")
              .groupBy("sig").agg(F.max(F.struct("meets", "sid")).alias("most")).select("sig", F.col("most.sid").alias("rep")))
    links = linked(picked.join(rep, "sig").where("sid <> rep").groupBy("sid", "rep").agg(F.count("*").alias("c"))
                   .groupBy("sid").agg(F.max(F.struct("c", "rep")).alias("best"))
                   .select(F.col("sid").alias("a"), F.col("best.rep").alias("b")))
    groups = connected(links)

    # segments that some set looks at and that hold several groups so far
    label = (met.join(picked.select("sig").distinct(), "sig", "left_semi").join(groups.toDF("sid", "group"), "sid", "left")
                .withColumn("group", F.coalesce("group", "sid")))
    mixed = (label.groupBy("sig", "group").agg(F.count("*").alias("c"))
                  .groupBy("sig").agg(F.count("*").alias("groups"), F.sum("c").alias("c"), F.max(F.struct("c", "group")).alias("most"))
                  .where("groups > 1").select("sig", "c", F.col("most.group").alias("main")))
    rows = cut(label.join(mixed, "sig").join(picked.withColumn("looks", F.lit(True)), ["sig", "sid"], "left")
                    .join(size, "sid").select("sig", "sid", "group", "n", "c", (F.col("group") == F.col("main")).alias("is_main"),
                                              F.coalesce("looks", F.lit(False)).alias("looks")))
    few = rows.where(F.col("c") <= SMALL)
    mine = few.where("looks").select("sig", *(F.col(c).alias(f"{c}_") for c in ("sid", "group", "n", "is_main")))
    fits = f"group <> group_ AND n >= n_ AND 100 * n_ >= {percent} * n"
    # the rows of a segment's largest group meet only the rows outside it
    pairs = (mine.join(few.where("NOT is_main"), "sig").where(fits)
             .unionAll(mine.where("NOT is_main_").join(few.where("is_main"), "sig").where(fits)))
    links = links.unionAll(linked(pairs.select(F.col("sid_").alias("a"), F.col("sid").alias("b")).distinct()))

    many = rows.where(F.col("c") > SMALL)
    if not many.isEmpty():
        links = links.unionAll(_linked_in_tiles(many, shingles_of, bound))
    groups = connected(links)

    least = sets.select("sid", "rep_doc").join(groups.toDF("sid", "group"), "sid", "left").withColumn("group", F.coalesce("group", "sid"))
    roots = least.groupBy("group").agg(F.min("rep_doc").alias("component"))
    of_set = least.join(roots, "group").select(F.col("sid").alias("sid_"), "component")
    return (described.join(of_set, (F.col("sid") == F.col("sid_")) & F.col("doc_id").isNotNull(), "left")
                     .select("doc_id", "n", "sid", "component"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, a row of its least id; rows without an
    id stay. Where rows of one id have different texts, each is judged by its own
    group: a text goes only if its group keeps another row."""
    groups = cut(_grouped(docs, doc_id, text, words, percent).where("doc_id IS NOT NULL")
                 .groupBy("doc_id", "sid", F.coalesce("component", "doc_id").alias("component")).agg(F.count("*").alias("rows")))
    key = fresh(docs, "gone")
    rooted = groups.where("doc_id = component")
    # ids whose rows are not all kept, or all dropped: a row each of the sets kept
    mixed = cut(groups.groupBy("doc_id").agg(F.count_if(F.expr("doc_id = component")).alias("kept"), F.sum("rows").alias("rows"))
                .where("kept > 0 AND rows > 1").select("doc_id"))
    out_ids = groups.where("doc_id <> component").select("doc_id").unionAll(mixed).distinct()
    out = docs.join(_sent(cut(out_ids.toDF(key))), F.col(doc_id) == F.col(key), "left_anti")
    if mixed.isEmpty():
        return out
    a, b, sid = (fresh(docs, x) for x in ("a", "b", "sid"))
    rows = (docs.join(_sent(mixed.toDF(key)), F.col(doc_id) == F.col(key), "left_semi")
                .withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit("text"), F.col(text))}))
    kind = dict(docs.dtypes)[doc_id]
    sets = (in_batches(rows.select(F.struct(F.col(doc_id).alias("i"), F.col(a).alias("a"), F.col(b).alias("b")).alias("doc_id"),
                                   F.col(text).alias("text")))
            .mapInArrow(lean(_describe(words, Bound(percent))), f"doc_id struct<i:{kind},a:long,b:long>, n long, sid long, failing long")
            .select("doc_id.*", F.col("sid").alias(sid)).distinct())
    kept = sets.join(rooted.select(F.col("doc_id").alias("i_"), F.col("sid").alias("sid_")),
                     (F.col("i") == F.col("i_")) & F.col(sid).eqNullSafe(F.col("sid_"))).select("i", "a", "b", sid)
    kept = kept.toDF(*(fresh(docs, x) for x in ("i2", "a2", "b2")), sid)
    i2, a2, b2 = kept.columns[:3]
    one = (rows.join(kept, (F.col(doc_id) == F.col(i2)) & (F.col(a) == F.col(a2)) & (F.col(b) == F.col(b2)))
               .dropDuplicates([doc_id, sid]).select(*docs.columns))
    return out.unionByName(one)
