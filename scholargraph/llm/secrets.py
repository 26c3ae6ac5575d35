"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are long runs of key characters that hold letters and digits. Each gets

- an inferred encoding (hex, base32, base62 or base64 by its characters),
- three tests of the hypothesis that its characters are independent and uniform over that alphabet:
  chi-squared, runs about the median, serial correlation; combined by Fisher's method,
- an e-value against ordinary text: its likelihood as uniform characters over its likelihood by the
  corpus's own character frequencies, counted over all documents. The alphabet is inferred from the run
  itself, so the uniform likelihood is that of an even mixture of all alphabets, at the least. The e-value
  grows with length, so short runs need more evidence a character.

Runs that the battery rejects are no secrets: their e-value is zero. Of all candidates of the whole corpus,
those included, the e-BH procedure keeps some. What holds: if the characters of an ordinary run are drawn
independently by the corpus's frequencies, the false-discovery rate is at most the given level, however the
runs depend on each other. Names and paths of real text are no such draws (their characters depend on
each other); against those stands the battery alone, and the level is a guide only.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import written

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_WORDS = ("passw", "secret", "token", "api")
_ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
_ALPHABETS = (
    ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
)
_WIDEST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees >= x): exact for even k, else the Wilson-Hilferty approximation."""
    if x <= 0:
        return 1.0
    if k % 2 == 0 and k <= 60:
        term = total = math.exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str) -> tuple[float, str]:
    """Fisher's combined p-value of the three tests, and the inferred alphabet."""
    name, alphabet = next(((n, a) for n, a in _ALPHABETS if set(run) <= set(a)), ("base64", _WIDEST))
    x = np.array([alphabet.index(c) for c in run], float)
    n, k = len(x), len(alphabet)
    seen = np.bincount(x.astype(int), minlength=k)
    bins = seen if n >= 2 * k else np.add.reduceat(seen, np.arange(0, k, -(-k // max(4, n // 5))))  # at least five a bin, about
    sizes = np.full(k, 1.0) if n >= 2 * k else np.add.reduceat(np.ones(k), np.arange(0, k, -(-k // max(4, n // 5))))
    expected = n * sizes / k
    p_chi = chi2_tail(float(((bins - expected) ** 2 / expected).sum()), len(bins) - 1)
    up = x > (k - 1) / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        runs, mean = 1 + int((up[1:] != up[:-1]).sum()), 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    else:
        p_runs = 2.0 ** (1 - n)
    dev = x - x.mean()
    power = float((dev**2).sum())
    r = float((dev[1:] * dev[:-1]).sum()) / power if power else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    joint = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return chi2_tail(joint, 6), name


def log_e(run: str, log_text: dict[str, float], name: str) -> float:
    """Log of the uniform likelihood over the text's likelihood; the alphabet's share of an even mixture."""
    size = next((len(a) for n, a in _ALPHABETS if n == name), len(_WIDEST))
    return sum(-math.log(size) - log_text[c] for c in run) - math.log(len(_ALPHABETS) + 1)


def random_runs(text: str, taken: list[tuple[int, int, str]], log_text: dict[str, float], level: float) -> tuple[list[tuple[int, int, float]], int]:
    """(start, end, log e-value) of candidates that overlap no fixed pattern and pass the battery; how many were tested."""
    out, tested = [], 0
    at = reach = 0  # fixed spans seen, and their furthest end
    for m in _RUN.finditer(text):
        run = m[0].rstrip("=")
        if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            continue
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start():
            continue
        tested += 1
        p, name = battery(run)
        if p >= level:
            out.append((m.start(), m.end(), log_e(run, log_text, name)))
    return out, tested


def character_logs(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Log frequency of each key character among the key characters of all texts."""
    schema = "byte int, n long"

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    total += np.bincount(np.frombuffer(text.as_buffer() or b"", np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("byte").agg(F.sum("n")).collect()  # 256 rows at most
    count = {chr(r[0]): r[1] + 1 for r in rows if r[0] < 128}
    total = sum(count.get(c, 1) for c in _WIDEST)
    return {c: math.log(count.get(c, 1) / total) for c in _WIDEST}


def e_threshold(counts: dict[int, int], fdr: float, tested: int) -> float:
    """The least log e-value kept by e-BH over ``tested`` candidates, from counts by floor of log e-value; others have zero."""
    m = max(tested, sum(counts.values()))
    kept, least = 0, math.inf
    for x in sorted(counts, reverse=True):
        kept += counts[x]
        if x >= math.log(m / (fdr * kept)):  # the floor is no more than the value
            least = float(x)
    return least


def scan(docs: DataFrame, fdr: float = 0.01, level: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points; kind ``random`` is the battery's. A null text is empty.
    Null and repeated ids keep a row each, repeated rows repeat it; other columns don't matter. A text is
    read whole, in time linear in its length; candidates keep their numbers only.
    """
    logs = character_logs(docs, text_col)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,rank:int,text:string>>, more array<struct<start:int,rank:int,text:string,e:double>>, tested long"
    span = [("start", pa.int32()), ("rank", pa.int32()), ("text", pa.string())]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("e", pa.float64())])), pa.int64()]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more", "tested"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                told = [f"{k}:{s}:{e}" for s, e, k in base]
                more, tested = random_runs(text, base, logs, level) if max(map(len, text.split()), default=0) >= 20 else ([], 0)
                row = (
                    doc, *(sum(k == x[2] for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(told).encode()).hexdigest(),
                    [{"start": s, "rank": _ORDER[k], "text": t} for (s, _, k), t in zip(base, told)],
                    [{"start": s, "rank": 3, "text": f"random:{s}:{e}", "e": v} for s, e, v in more],
                    tested,
                )
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(plain.mapInArrow(run, schema), "spans")
    e = F.least(F.floor("e"), F.lit(1000))
    counts = {r[0]: r[1] for r in found.select(F.explode("more.e").alias("e")).groupBy(e.alias("e")).count().collect()}  # whole numbers up to 1000
    least = e_threshold(counts, fdr, found.agg(F.sum("tested")).first()[0] or 0)
    kept = F.transform(F.filter("more", lambda x: x["e"] >= F.lit(least)), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["text"].alias("text")))
    spans = F.array_join(F.transform(F.sort_array(F.concat("base", kept)), lambda x: x["text"]), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))
