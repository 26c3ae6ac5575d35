"""Hard negatives: rotated one-bit codes with intervals that hold for certain, integer scores for what they leave.

Components become whole numbers, and a score is their inner product. A row x is coded in ``STAGES`` steps:
what is left of it, r, is rotated by a fixed random rotation, the signs are kept as one bit each, and the
alignment a = <r, u> with the unit vector u of these signs is stored; r - a u goes to the next step. So
x = a1 u1 + a2 u2 + ... + r, and the length of the last r is stored, too. For an anchor q

    <q, x> = a1 <q, u1> + a2 <q, u2> + ... + <q, r>,   |<q, r>| <= |q| |r|   (Cauchy-Schwarz)

where <q, u> comes from popcounts of the code with the bit planes of the rotated, quantised anchor, and what
quantising can change is added to the interval. A row whose interval can't reach what a question still
looks for is left out; all others are scored as integers. So results are exact, whatever the data; the
codes decide only how much is scored.

Anchors grow with the table, so they are taken in blocks of a fixed number of rows. A block goes to all
tasks; each meets its own rows, batch by batch, and returns its best few for each anchor. Rows stay where
they are; only these few are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import written

#: Anchors that are sent to the tasks at once; steps of a code; bits of a quantised anchor's component.
BLOCK_ROWS, STAGES, PLANES = 4_096, 4, 6
#: Rows met at once: few at first, until the best so far are known.
_FIRST, _ROWS, _ANCHORS = 256, 2_048, 512
#: Share of pairs up to which a stage meets only those that are left.
_FEW = 0.25
#: Above this sum of products doubles are no longer exact.
_EXACT = 2.0**52


def rotation(dim: int, stage: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, stage, 7]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Coder:
    """Codes of rows, and intervals of inner products with anchors."""

    def __init__(self, dim: int, stages: int = STAGES, planes: int = PLANES):
        self.dim, self.stages, self.planes, self.words = dim, stages, planes, -(-dim // 64)
        self.turns = [rotation(dim, s) for s in range(stages)]

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        """(rows, dim) of bits as (rows, words) of 64 bits."""
        wide = np.zeros((len(bits), self.words * 64), np.uint8)
        wide[:, : self.dim] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows (n, dim): codes (n, stages, words), alignments (n, stages), what is left after each stage (n, stages)."""
        left = x.astype(np.float64)
        codes, aligned, rest = np.empty((len(x), self.stages, self.words), np.uint64), np.empty((len(x), self.stages)), np.empty((len(x), self.stages))
        for s, turn in enumerate(self.turns):
            bits = left @ turn.T > 0
            u = np.where(bits, 1.0, -1.0) @ turn / np.sqrt(self.dim)
            a = (left * u).sum(1)
            left = left - a[:, None] * u
            codes[:, s], aligned[:, s], rest[:, s] = self._packed(bits), a, np.sqrt((left * left).sum(1))
        return codes, aligned, rest

    def questions(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of anchors (n, dim), for each stage: bit planes (n, planes, words), step, offset, and the most that quantising changes."""
        out = []
        for turn in self.turns:
            y = q.astype(np.float64) @ turn.T
            low = y.min(1, keepdims=True)
            step = np.maximum((y.max(1, keepdims=True) - low) / (2**self.planes - 1), 1e-30)
            k = np.rint((y - low) / step).astype(np.int64)
            off = np.abs(y - (low + step * k)).sum(1) / np.sqrt(self.dim)
            planes = np.stack([self._packed((k >> p) & 1) for p in range(self.planes)], 1)
            out.append((planes, step[:, 0], low[:, 0], off))
        return out

    def along(self, question: tuple, codes: np.ndarray) -> np.ndarray:
        """(anchors, rows) of the inner products of quantised anchors with the units of ``codes`` (rows, words), by popcounts."""
        planes, step, low, _ = question
        both = np.zeros((len(planes), len(codes)), np.uint16 if self.words << (self.planes + 6) < 65_536 else np.uint32)
        for p in range(self.planes):
            for w in range(self.words):
                both += np.multiply(np.bitwise_count(planes[:, p, w, None] & codes[None, :, w]), both.dtype.type(1 << p), dtype=both.dtype)
        return self._scaled(question, codes, both, (slice(None), None), (None, slice(None)))

    def along_pairs(self, question: tuple, codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same of the pairs (i, j) alone."""
        met = np.bitwise_count(question[0][i] & codes[j][:, None]).sum(2, dtype=np.int32)
        return self._scaled(question, codes, met @ (1 << np.arange(self.planes, dtype=np.int32)), i, j)

    def _scaled(self, question: tuple, codes: np.ndarray, both: np.ndarray, i, j) -> np.ndarray:
        planes, step, low, _ = question
        each = np.bitwise_count(planes).sum(2, dtype=np.int64) @ (1 << np.arange(self.planes, dtype=np.int64))
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        scale = 1 / np.sqrt(self.dim)
        return both * (2 * scale * step)[i] + ((-scale * step * each)[i] + (scale * low)[i] * (2 * ones - self.dim)[j])


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", noisy: Column | None = None) -> DataFrame:
    """(vec_id, label, c, codes, aligned, rest) of the rows that take part.

    Null labels, null vectors and any null or non-finite component leave a row out, so do null ids, which
    can be neither anchor nor answer. ``noisy`` tells the rows whose label first becomes (label + 1) % 10.
    Vectors of other lengths than the commonest (of several, the shortest) can't be compared and are left out.
    """
    x = F.col(vector_col)
    label = F.col(label_col).cast("long")
    if noisy is not None:
        label = F.when(noisy, F.pmod(label + 1, F.lit(10))).otherwise(label)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    taken = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~bad)
    whole = taken.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("c"))
    common = whole.groupBy(F.size("c").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    dim = common["n"] if common else 0
    whole = whole.filter(F.size("c") == dim)

    def run(batches):
        coder = Coder(dim)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                codes, aligned, rest = coder.code(_matrix(part.column(2), dim))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(v.reshape(len(v), -1))) for v in (codes.view(np.int64), aligned, rest))], ["vec_id", "label", "c", "codes", "aligned", "rest"])

    return whole.filter(F.lit(dim > 0)).mapInArrow(run, "vec_id long, label long, c array<long>, codes array<long>, aligned array<double>, rest array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Rows:
    """A batch of rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, coder: Coder):
        self.id, self.label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        self.c = _matrix(batch.column(2), coder.dim)
        self.codes = _matrix(batch.column(3), coder.stages * coder.words).view(np.uint64).reshape(len(self.id), coder.stages, coder.words)
        self.aligned, self.rest = (_matrix(batch.column(k), coder.stages) for k in (4, 5))


def integer_scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows i of ``q`` with the rows j of ``c``, whole numbers; sums must fit 64 bits."""
    if not len(i):
        return np.zeros(0, np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < _EXACT:
        q, c = q.astype(np.float64), c.astype(np.float64)
    return np.einsum("ij,ij->i", q[i], c[j]).astype(np.int64)


class Anchors:
    """A block of anchors: ids, labels and components by row, and what the codes need of them."""

    def __init__(self, id: np.ndarray, label: np.ndarray, c: np.ndarray, coder: Coder):
        self.id, self.label, self.c, self.coder = id, label, c, coder
        self.norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
        self.asked = coder.questions(c)

    def survivors(self, which: np.ndarray, rows: Rows, at: np.ndarray, low: np.ndarray, high: np.ndarray | None = None, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``which``, in ``at``) of the pairs whose interval meets one of the anchor's, after every stage.

        ``low``, ``high`` (anchors, some): what each anchor looks for; without ``high`` there is no upper end.
        ``apart``: only rows of other labels than the anchor's.
        Stages meet all pairs, by one test against the hull of what is looked for, until few are left.
        """
        slack = 1e-9 * self.norm[which, None] * (np.abs(rows.aligned[at]).sum(1) + rows.rest[at, -1])[None, :] + 1e-6
        middle, width = 0.0, slack
        i = j = None
        hull = low.min(1), None if high is None else high.max(1)
        for s in range(self.coder.stages):
            asked = tuple(x[which] for x in self.asked[s])
            codes, a, rest = np.ascontiguousarray(rows.codes[at, s]), rows.aligned[at, s], rows.rest[at, s]
            if i is None:
                middle = middle + a * self.coder.along(asked, codes)
                width = width + asked[3][:, None] * np.abs(a)
                last = width + self.norm[which, None] * rest
                keep = middle + last >= hull[0][:, None]
                if high is not None:
                    keep &= middle - last <= hull[1][:, None]
                if apart:
                    keep &= self.label[which][:, None] != rows.label[at]
                if np.count_nonzero(keep) <= _FEW * keep.size or s + 1 == self.coder.stages:
                    i, j = np.nonzero(keep)
                    middle, width = middle[i, j], width[i, j]
                continue
            middle = middle + a[j] * self.coder.along_pairs(asked, codes, i, j)
            width = width + np.abs(a[j]) * asked[3][i]
            last = width + self.norm[which[i]] * rest[j]
            keep = np.zeros(len(i), bool)
            for x in range(low.shape[1]):
                hit = middle + last >= low[i, x]
                keep |= hit if high is None else hit & (middle - last <= high[i, x])
            i, j, middle, width = i[keep], j[keep], middle[keep], width[keep]
        return i, j


def _best(question: np.ndarray, score: np.ndarray, id: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first ``n`` of each question, by falling score and rising id, and their ranks."""
    order = np.lexsort((id, -score, question))
    q = question[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < n], rank[rank < n]


class Found:
    """The best so far of each question: scores and ids that fall short are forgotten."""

    def __init__(self, questions: int, n: int):
        self.n, self.q, self.score, self.id = n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(questions, np.iinfo(np.int64).min)  # of the n-th best; anything goes until there are n

    def add(self, *new: np.ndarray) -> None:
        """Questions, scores and ids, any order; nothing, if there are none."""
        if not new or not len(new[0]):
            return
        q, score, id = new
        q, score, id = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, id)))
        at, rank = _best(q, score, id, self.n)
        self.q, self.score, self.id = q[at], score[at], id[at]
        last = rank == self.n - 1
        self.least[self.q[last]] = self.score[last]


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in stream:
        at = 0
        while at < batch.num_rows:
            n = _FIRST if first else _ROWS
            yield batch.slice(at, n)
            at, first = at + n, False


def _positives(rows: DataFrame, block: tuple, coder_args: tuple, n: int) -> DataFrame:
    """(anchor_id, positive_id, score) of a block: each task's ``n`` best of the anchor's label."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        coder = Coder(*coder_args)
        anchors = Anchors(*shared.value, coder)
        found = Found(len(anchors.id), n)
        by = {v: np.flatnonzero(anchors.label == v) for v in np.unique(anchors.label)}
        for batch in _batches(batches):
            part, new = Rows(batch, coder), []
            for v in np.unique(part.label):
                at = np.flatnonzero(part.label == v)
                for k in range(0, len(by.get(v, ())), _ANCHORS):
                    which = by[v][k : k + _ANCHORS]
                    i, j = anchors.survivors(which, part, at, found.least[which, None])  # equal scores may still win by id
                    i, j = which[i], at[j]
                    other = anchors.id[i] != part.id[j]
                    i, j = i[other], j[other]
                    new.append((i, integer_scores(anchors.c, part.c, i, j), part.id[j]))
            found.add(*map(np.concatenate, zip(*new)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.id[found.q], found.id, found.score)], ["anchor_id", "positive_id", "positive_score"])

    return rows.select("vec_id", "label", "c", "codes", "aligned", "rest").mapInArrow(run, "anchor_id long, positive_id long, positive_score long")


def _negatives(rows: DataFrame, block: tuple, coder_args: tuple, n: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_score, negative_id, negative_score) of a block: each task's ``n`` best of other labels in each window.

    ``block`` has a row for each anchor, and its distinct positive scores as (anchor's place, score).
    """
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        coder = Coder(*coder_args)
        id, label, c, owner, score = shared.value
        anchors = Anchors(id, label, c, coder)
        found = Found(len(owner), n)
        # 100 s between low p and high p, as whole numbers; p = 100 a + b keeps products small
        a, b = score // 100, score % 100
        floor, top = low * a - (-low * b) // 100, high * a + (high * b) // 100
        start = np.searchsorted(owner, np.arange(len(id)))
        times = np.bincount(owner, minlength=len(id))
        asking = np.flatnonzero(times)
        for batch in _batches(batches):
            part, new = Rows(batch, coder), []
            at = np.arange(len(part.id))
            for k in range(0, len(asking), _ANCHORS):
                which = asking[k : k + _ANCHORS]
                asked = start[which][:, None] + np.minimum(np.arange(times[which].max()), times[which][:, None] - 1)
                i, j = anchors.survivors(which, part, at, np.maximum(floor[asked], found.least[asked]), top[asked], apart=True)
                made = integer_scores(c, part.c, which[i], j)
                for x in range(asked.shape[1]):
                    q = asked[i, x]
                    good = (made >= np.maximum(floor[q], found.least[q])) & (made <= top[q]) & (x < times[which[i]])
                    new.append((q[good], made[good], part.id[j[good]]))
            found.add(*map(np.concatenate, zip(*new)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id[owner[found.q]], score[found.q], found.id, found.score)], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return rows.select("vec_id", "label", "c", "codes", "aligned", "rest").mapInArrow(run, "anchor_id long, positive_score long, negative_id long, negative_score long")


def _first(df: DataFrame, by: list[str], score: str, id: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, noisy: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor its ``positives`` best other rows of the same label; for each of these the ``negatives``
    best rows of other labels with low % to high % of the positive's score. Ties go by the smaller id. An
    anchor without positives, or a positive without negatives, has no row. ``prepared`` tells which rows take
    part; of rows with the same id one, with the least label and vector, does. Empty tables give an empty one.
    """
    one = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"), is_anchor.alias("a"), (F.lit(False) if noisy is None else noisy).alias("noisy"))
    made = written(prepared(one, noisy=F.col("noisy")), "rows")
    flags = one.filter("a").select("vec_id").distinct()
    if not made.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # else the vectors stay where they are
        made = written(made.groupBy("vec_id").agg(F.min(F.struct("label", "c", "codes", "aligned", "rest")).alias("x")).select("vec_id", "x.*"), "rows")
    anchors = written(made.select("vec_id", "label", "c").join(flags, "vec_id", "left_semi").withColumn("block", F.xxhash64("vec_id")), "anchors")
    n_anchors = anchors.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], schema)
    width = len(anchors.first()["c"])
    n_blocks = -(-n_anchors // block_rows)
    out = None
    for b in range(n_blocks):
        # about block_rows rows reach the driver at once; many anchors are many blocks
        got = anchors.filter(F.pmod("block", F.lit(n_blocks)) == b).select("vec_id", "label", "c").orderBy("vec_id").toArrow()
        if not got.num_rows:
            continue
        id, label = (got.column(k).to_numpy() for k in (0, 1))
        c = got.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        best = written(_first(_positives(made, (id, label, c), (width,), positives), ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
        asked = best.select("anchor_id", "positive_score").distinct().orderBy("anchor_id", "positive_score").toArrow()  # block_rows * positives at most
        owner, score = np.searchsorted(id, asked.column(0).to_numpy()), asked.column(1).to_numpy()
        some = _first(_negatives(made, (id, label, c, owner, score), (width,), negatives, low, high), ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
        block = written(best.join(some, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "found")
        out = block if out is None else out.union(block)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)
