"""Quality: a generalised additive model with pairwise interactions over dense features of the whole text.

Every feature is cut into bins; cyclic boosting visits the features in turn and adds to each one's table
what a shallow tree over its bins makes of the residuals. With the single tables fixed, the pairs of
features that explain most of what is left get tables over two bins, boosted in the same way. A score is
then a sum of table entries, looked up for whole batches at once.

The model is fitted on the features of a bounded sample of labelled rows; features and scores of all
documents are made where Spark reads them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholargraph.plans.cutpoints import written

#: Most labelled rows that a model is fitted on: those with the least hash of their id.
SAMPLE_ROWS = 20_000
NAMES = (
    "log_words", "word_length", "word_length_spread", "longest_word", "short_words", "distinct_words", "commonest_word", "word_entropy",
    "twin_words", "repeated_pairs", "repeated_windows", "repeated_lines", "words_per_line", "closed_lines",
    "upper", "digits", "symbols", "bars", "stops", "exclamations", "beyond_ascii", "byte_entropy",
)


def _entropy(counts: np.ndarray) -> float:
    counts = counts[counts > 0]
    if not len(counts):
        return 0.0
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _repeats(ids: np.ndarray, width: int) -> float:
    """Share of the words that lie in a window of ``width`` words found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0.0
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(times[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return float((np.cumsum(edge)[:-1] > 0).mean())


def text_features(text: str) -> list[float]:
    """The features named in NAMES; a text without words has zeros but for its bytes' shares."""
    raw = text.encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    times = Counter(words)
    number = dict(zip(times, range(len(times))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    long = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = np.fromiter(times.values(), np.float64, len(times))
    lines = [s for s in (x.strip() for x in raw.split(b"\n")) if s]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    return [
        float(np.log1p(len(words))), float(long.mean()), float(long.std()), float(np.log1p(long.max())), float((long <= 2).mean()) if words else 0.0,
        len(times) / n, float(counts.max()) / n if words else 0.0, _entropy(counts),
        float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0, _repeats(ids, 2), _repeats(ids, 5),
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), sum(s[-1] in b".!?" for s in lines) / max(1, len(lines)),
        upper / max(1, upper + lower), int(count[48:58].sum()) / size, int(count[[35, 36, 37, 38, 42, 60, 62]].sum()) / size, int(count[124]) / size,
        int(count[[44, 46, 58, 59, 63]].sum()) / size, int(count[33]) / size, int(count[128:].sum()) / size, _entropy(count),
    ]


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """0 to ``folds`` - 1, from the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders of at most ``bins`` bins of like size; a value goes to the first bin whose border isn't under it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf")) if len(values) else np.zeros(0)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, weight: float) -> np.ndarray:
    return g * g / (h + weight)


def grown(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, weight: float) -> np.ndarray:
    """A shallow tree over ordered bins: each bin's leaf value. Greedy: the best cut of all leaves, until none gains.

    ``g``, ``h``, ``n``: sums of residuals, of curvatures and rows of each bin; no leaf has under ``least`` rows.
    """
    cuts, (cg, ch, cn) = [0, len(g)], (np.concatenate(([0], np.cumsum(x))) for x in (g, h, n))
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            made = _gain(cg[m] - cg[a], ch[m] - ch[a], weight) + _gain(cg[b] - cg[m], ch[b] - ch[m], weight) - _gain(cg[b] - cg[a], ch[b] - ch[a], weight)
            made[(cn[m] - cn[a] < least) | (cn[b] - cn[m] < least)] = 0
            k = int(made.argmax())
            if made[k] > best:
                best, at = made[k], int(m[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + weight)
    return out


def grown_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, weight: float) -> tuple[np.ndarray, float]:
    """A tree of two levels over a grid of bins, cut along one side and then along the other: leaf values, and its gain over no cut."""
    best, out = 0.0, np.full(g.shape, g.sum() / (h.sum() + weight))
    whole = _gain(g.sum(), h.sum(), weight)
    for turned in (False, True):
        cg, ch, cn = (np.pad(np.cumsum(np.cumsum(x.T if turned else x, 0), 1), ((1, 0), (1, 0))) for x in (g, h, n))
        for a in range(1, cg.shape[0] - 1):
            total, cut = 0.0, []
            for lo, hi in ((0, a), (a, cg.shape[0] - 1)):
                rg, rh, rn = (x[hi] - x[lo] for x in (cg, ch, cn))
                made = _gain(rg, rh, weight) + _gain(rg[-1] - rg, rh[-1] - rh, weight)
                made[(rn < least) | (rn[-1] - rn < least)] = -np.inf
                k = int(made[1:-1].argmax()) + 1 if len(made) > 2 else 0
                if not k or made[k] == -np.inf:
                    k, score = len(made) - 1, _gain(rg[-1], rh[-1], weight)
                else:
                    score = made[k]
                total += score
                cut.append((lo, hi, k, rg, rh))
            if total - whole > best + 1e-9:
                best, table = total - whole, np.empty((cg.shape[0] - 1, cg.shape[1] - 1))
                for lo, hi, k, rg, rh in cut:
                    table[lo:hi, :k] = rg[k] / (rh[k] + weight)
                    table[lo:hi, k:] = (rg[-1] - rg[k]) / (rh[-1] - rh[k] + weight)
                out = table.T if turned else table
    return out, best


@dataclass
class Additive:
    """What ``fit`` returns. Without tables (no or one class in the sample) every score is that of ``base``."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features: the sum of their bins' entries."""
        f = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            f += table[np.searchsorted(edges, x[:, k])]
        for i, j, a, b, table in self.pairs:
            f += table[np.searchsorted(a, x[:, i]), np.searchsorted(b, x[:, j])]
        return f

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a score, 0 to 1, as ``name`` (a column of that name gives way); a null text is empty."""
        kept = [c for c in docs.columns if c != name]
        plain = docs.select(*[F.col(f"`{c}`") for c in kept])
        at, model = kept.index(text_col), self
        schema = T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType(), False)])

        def run(batches):
            for batch in batches:
                made = np.array([text_features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(model.log_odds(made)))], [*batch.schema.names, name])

        return plain.mapInArrow(run, schema)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(feature, other, above, other_above, added): every entry of the tables; a bin holds what is over ``above``, up to the next one's.

        ``other`` is null for single features. Borders of first bins are null.
        """
        low = lambda e, k: float(e[k - 1]) if k else None
        rows = [(NAMES[k], None, low(e, b), None, float(v)) for k, (e, t) in enumerate(zip(self.edges, self.tables)) for b, v in enumerate(t)]
        rows += [(NAMES[i], NAMES[j], low(a, p), low(b, q), float(t[p, q])) for i, j, a, b, t in self.pairs for p in range(t.shape[0]) for q in range(t.shape[1])]
        return spark.createDataFrame(rows, "feature string, other string, above double, other_above double, added double")


def boosted(x: np.ndarray, y: np.ndarray, check: np.ndarray, bins: int = 32, rounds: int = 200, rate: float = 0.1, leaves: int = 4, least: int = 8, weight: float = 1.0, n_pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 80, patience: int = 15) -> Additive:
    """The model of rows of features ``x`` and labels ``y`` (0, 1); rows where ``check`` is true tell when to stop."""
    learn = ~check if (~check).any() and len(np.unique(y[~check])) == 2 else np.ones(len(y), bool)
    share = (y[learn].sum() + 1) / (learn.sum() + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    f = np.full(len(y), model.base)

    def loss() -> float:
        at = check if check.any() else learn
        return float(np.logaddexp(0, np.where(y[at] > 0, -f[at], f[at])).mean())

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = _sigmoid(f[learn])
        return np.bincount(at[learn], y[learn] - p, size), np.bincount(at[learn], p * (1 - p), size), np.bincount(at[learn], minlength=size)

    def cycle(places: list[np.ndarray], tables: list[np.ndarray], step, rounds: int) -> list[np.ndarray]:
        """Rounds over all tables, one step each; back to the state of the least loss."""
        nonlocal f
        best, kept, kept_f, idle = loss(), [t.copy() for t in tables], f.copy(), 0
        for _ in range(rounds):
            for at, table in zip(places, tables):
                more = rate * step(*(s.reshape(table.shape) for s in sums(at, table.size)))
                table += more
                f = f + more.ravel()[at]
            now = loss()
            idle = idle + 1 if now > best - 1e-5 else 0
            if now < best:
                best, kept, kept_f = now, [t.copy() for t in tables], f.copy()
            if idle >= patience:
                break
        f = kept_f
        return kept

    model.edges = [_edges(x[learn, k], bins) for k in range(x.shape[1])]
    places = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]
    model.tables = cycle(places, [np.zeros(len(e) + 1) for e in model.edges], lambda g, h, n: grown(g, h, n, leaves, least, weight), rounds)
    coarse = [_edges(x[learn, k], pair_bins) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k]) for k, e in enumerate(coarse)]
    found = []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        if min(shape) > 1:
            g, h, n = (s.reshape(shape) for s in sums(at[i] * shape[1] + at[j], shape[0] * shape[1]))
            found.append((-grown_pair(g, h, n, least, weight)[1], i, j))
    chosen = [(i, j) for gain, i, j in sorted(found)[:n_pairs] if gain < 0]
    shapes = [(len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in chosen]
    made = cycle([at[i] * s[1] + at[j] for (i, j), s in zip(chosen, shapes)], [np.zeros(s) for s in shapes], lambda g, h, n: grown_pair(g, h, n, least, weight)[0], pair_rounds)
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, made)]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1) -> Additive:
    """Fits on labelled rows whose fold isn't ``held_out``; at most ``sample_rows`` of them, whatever the table's size.

    Null ids, null labels and labels without a document teach nothing. Of several labels of an id the
    greatest counts, of several texts the least.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & (fold(id_col, folds) != held_out)).select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y"))
    taken = usable.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = plain.join(F.broadcast(taken), plain["id"] == F.col("k")).groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches):
        for batch in batches:
            made = [text_features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = written(sample.select(F.col("id").cast("string").alias("id"), "text", "y").mapInArrow(run, "id string, y double, x array<double>"), "features")
    got = rows.withColumn("check", F.pmod(F.xxhash64("id"), F.lit(5)) == 0).orderBy("id").toPandas()  # sample_rows at most
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    return boosted(x, got["y"].to_numpy(np.float64), got["check"].to_numpy(bool))


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1: good).

    A null id counts as not held out; null and empty texts are scored as texts without words; repeated
    rows repeat theirs; very long texts are read whole. An empty table gives an empty one, and without
    labels of both kinds the labels' rate is every score.
    """
    model = fit(docs, labels, sample_rows)
    out = model.score(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
