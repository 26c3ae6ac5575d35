"""Personal data: fixed patterns, and a semi-Markov conditional random field over spans.

The field scores whole candidate segments by features of the span (digit groups and their separators,
checks, edges, numbers and cue words beside it) for each type; what lies between entities has score zero.
A dynamic programme picks boundaries and types together. Weights are learned by maximum likelihood on
generated sentences, with a fixed seed (``learn``), and kept in ``pii_weights.json``.

Entities are bounded: eight groups of digits and 19 digits, or a mail address of some 64 characters a part.
So candidates are made while the text is read once, those without a positive score are dropped at once
(they can't be in the best segmentation), and the programme runs along with the reading. Every ``WINDOW``
candidates it decides what all segmentations that can still win have in common, which changes no result,
so memory does not grow with the text but by the spans found.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(TYPES)}
#: Most groups and digits of a number; most characters of an entity; candidates after which what is certain is decided.
GROUPS, DIGITS, LONGEST, WINDOW = 8, 19, 200, 4_096
#: Words before an entity that tell its type, or that a number is something else.
CUES = {
    "phone": "phone tel telephone call mobile cell fax contact whatsapp sms dial ring telefon handy anruf mobil appel appelez portable telefono llamar movil",
    "card": "card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta",
    "email": "mail email contact write correo courriel",
    "ip": "ip host server address ipv4 gateway",
    "other": "order invoice isbn issn version page pages id serial case ticket item ref reference code bestellung article build lot patent sku",
}
_CUE = {w: k for k, v in CUES.items() for w in v.split()}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # a local part can't hold @, so each match is found from its @
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= len(m[0]) and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]]))

_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\x20().+/-]{1,3}\Z")
_NEXT = re.compile(r"[\x20().+/-]{1,3}[0-9]")
_WORD = re.compile(r"[a-z0-9]+")
_RIGHT = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}")
_SPELT = re.compile(r"\x20?[\[(](?:at|AT|At)[\])]\x20?")
_SPELT_RIGHT = re.compile(r"[\w-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT|Dot)[\])]\x20?)[\w-]{1,63}){0,8}")
#: (start, end, key): ``key`` holds all that a candidate's features depend on.
Candidate = tuple[int, int, tuple]


def _cue(text: str, start: int) -> str:
    for w in reversed(_WORD.findall(text[max(0, start - 24) : start].lower())[-2:]):
        if w in _CUE:
            return _CUE[w]
    return "none"


def _edge(c: str, more: str) -> str:
    return "word" if c and (c.isalnum() or c in more) else "free"


def numbers(text: str) -> Iterator[Candidate]:
    """Candidates made of digit groups, by end; a bracket or plus before the first group may belong to them."""
    chain: list[tuple[int, int, str]] = []  # start, end of the last groups, and what stands before each
    last = -1
    for m in _GROUP.finditer(text):
        a, b = m.span()
        between = text[last:a] if 0 <= last and a - last <= 3 else ""
        if not (between and _BETWEEN.match(between)):
            chain.clear()
            between = ""
        chain.append((a, b, between))
        if len(chain) > GROUPS + 1:
            del chain[0]
        last = b
        n, seps, lens = 0, (), ()
        right = None
        for i in range(len(chain) - 1, max(-1, len(chain) - 1 - GROUPS), -1):
            s, e, before = chain[i]
            n += e - s
            if n > DIGITS:
                break
            lens = (min(e - s, 7), *lens)
            if n >= 7 or len(lens) == 4 and n >= 4 and seps == (".", ".", "."):
                if right is None:
                    after = text[b : b + 1]
                    right = "on" if _NEXT.match(text, b) else "goes_on" if after in (".", ",", ":") and text[b + 1 : b + 2].isalnum() else _edge(after, "_-@/%°")
                digits = _digits(text[s:b]) if 13 <= n else ""
                check = "luhn" if digits and luhn(digits) else "no_luhn" if digits else "quad" if seps == (".", ".", ".") and all(map(_small, text[s:b].split("."))) else ""
                first = text[s : s + 2]
                zero = "00" if first == "00" else "0" if first[0] == "0" else "1" if lens[0] == 1 and first[0] == "1" else ""
                sign = text[s - 1 : s] if s else ""
                for lead in ("", sign, "+(") if sign == "(" and s > 1 and text[s - 2] == "+" else ("", sign) if sign in ("+", "(") else ("",):
                    at = s - len(lead)
                    listed = bool(before) and not (lead and before.strip(" ") == lead)
                    c = text[at - 1 : at] if at else ""
                    left = "list" if listed else _edge(c, "._-+@#/$€£=,:(" if not lead else "._-+@#/$=")
                    yield at, b, ("number", n, lens, seps, lead, zero, left, right, check, "none" if listed and i else _cue(text, at))
            seps = (before, *seps)


def mails(text: str) -> Iterator[Candidate]:
    """Candidates around an at sign, written or spelt, by end."""
    return heapq.merge(_mails(text, re.compile("@"), _RIGHT, "sign"), _mails(text, _SPELT, _SPELT_RIGHT, "spelt"), key=lambda c: c[1])


def _mails(text: str, sign: re.Pattern, tail: re.Pattern, how: str) -> Iterator[Candidate]:
    for m in sign.finditer(text):
        right = tail.match(text, m.end())
        if not right:
            continue
        start, least = m.start(), max(0, m.start() - 64)
        while start > least and ((c := text[start - 1]).isalnum() or c in "._%+-"):
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        if start == m.start() or start == least and start and ((c := text[start - 1]).isalnum() or c in "._%+-"):  # a longer local part is none, it isn't cut
            continue
        local, domain = text[start : m.start()], re.sub(r"\x20?[\[(](?i:dot)[\])]\x20?", ".", right[0]).rstrip("-_.")
        end = m.end() + len(right[0].rstrip("-_."))
        top = domain.rpartition(".")[2]
        after = text[end : end + 1]
        yield start, end, ("mail", how, min(domain.count("."), 3), min(len(top), 7) if top.isalpha() else 0, local.isdigit(), (local + domain).isascii(), _edge(text[start - 1 : start] if start else "", "@/:"), _edge(after, "_@/"), _cue(text, start))


def features(key: tuple) -> list[str]:
    """Names of a candidate's features."""
    if key[0] == "mail":
        _, how, dots, top, digits, ascii_only, left, right, cue = key
        return ["mail", f"m_{how}", f"m_dots{dots}", f"m_top{top}", f"m_digits{digits}", f"m_ascii{ascii_only}", f"m_left_{left}", f"m_right_{right}", f"m_cue_{cue}"]
    _, n, lens, seps, lead, zero, left, right, check, cue = key
    f = ["number", f"n{n}", f"g{len(lens)}", f"first{lens[0]}", f"last{lens[-1]}", f"lead{lead}", f"zero{zero}", f"left_{left}", f"right_{right}", f"check_{check}", f"cue_{cue}"]
    marks = {x.strip(" ") or x for x in seps}
    f += [f"sep{x}" for x in sorted(marks)] or ["whole"]
    f.append("even" if len(marks) <= 1 else "mixed")
    if len(lens) <= 6 and n <= 16:
        f.append("lens" + "-".join(map(str, lens)))
    opened = lead.count("(") + sum(x.count("(") for x in seps)
    f.append("closed" if opened == sum(x.count(")") for x in seps) else "unclosed")
    if len(lens) >= 4 and set(lens[:-1]) == {4}:
        f.append("fours")
    return f


class Field:
    """Scores candidates by weights of their features; equal keys are scored once."""

    def __init__(self, columns: dict[str, int], weights: np.ndarray):
        self.columns, self.weights, self.known = columns, weights, {}

    def best_type(self, key: tuple) -> tuple[float, int]:
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= 50_000:
                self.known.clear()
            scores = self.weights[[self.columns[f] for f in features(key) if f in self.columns]].sum(axis=0)
            found = self.known[key] = (float(scores.max()), int(scores.argmax()))
        return found

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities that overlap none of ``taken`` (by start)."""
        out: list[tuple[int, int, str]] = []
        best = Segments()
        starts = [x[0] for x in taken]
        furthest = np.maximum.accumulate([x[1] for x in taken]).tolist() if taken else []
        for start, end, key in heapq.merge(numbers(text), mails(text), key=lambda c: c[1]):
            score, kind = self.best_type(key)
            if score <= 0 or end - start > LONGEST:
                continue
            k = bisect_right(starts, end - 1) - 1
            if k >= 0 and furthest[k] > start:
                continue
            if len(best.ends) > best.patience:
                out += best.settled(end - LONGEST)
            best.add(start, end, score, kind)
        return out + best.settled(len(text))


class Segments:
    """The best segmentation so far up to each end, of candidates that come by end.

    What all segmentations that can still be followed have in common is decided as the text goes by, so
    few states are kept; the result is that of one decision over the whole text.
    """

    def __init__(self, patience: int | None = None):
        self.ends, self.value, self.back = [0], [0.0], [(-1, None)]
        self.least = self.patience = patience or WINDOW

    def add(self, start: int, end: int, score: float, kind: int) -> None:
        before = bisect_right(self.ends, start) - 1
        if before >= 0 and self.value[before] + score > self.value[-1]:
            self.back.append((before, (start, end, TYPES[kind])))
            self.ends.append(end)
            self.value.append(self.value[before] + score)

    def settled(self, start: int) -> list[tuple[int, int, str]]:
        """The entities that are certain if all later candidates start at ``start`` or after it."""
        live = range(max(0, bisect_right(self.ends, start) - 1), len(self.ends))
        heads, kept = [-x for x in live], set(live)
        heapq.heapify(heads)
        while len(heads) > 1:  # back from the latest until all ways are one
            x = self.back[-heapq.heappop(heads)][0]
            if x not in kept:
                kept.add(x)
                heapq.heappush(heads, -x)
        at = -heads[0]
        out, x = [], at
        while self.back[x][1] is not None:
            out.append(self.back[x][1])
            x = self.back[x][0]
        order = sorted(k for k in kept if k >= at)
        place = {k: i for i, k in enumerate(order)}
        self.back = [(-1, None), *((place[self.back[k][0]], self.back[k][1]) for k in order[1:])]
        self.ends, self.value = [self.ends[k] for k in order], [self.value[k] for k in order]
        self.patience = max(self.least, 2 * len(order))
        return out[::-1]


def _chosen(cluster: list[tuple[int, int, float, int]]) -> list[tuple[int, int, str]]:
    """The set of segments with the highest sum, none overlapping; ``cluster`` is by end."""
    best = Segments()
    for c in cluster:
        best.add(*c)
    return best.settled(max((c[1] for c in cluster), default=0))


def expected(candidates: list[Candidate], score: np.ndarray) -> np.ndarray:
    """(candidates, types): probabilities, by the forward and backward sums over all segmentations."""
    points = sorted({x for c in candidates for x in c[:2]})
    place = {p: i for i, p in enumerate(points)}
    spans = [(place[s], place[e]) for s, e, _ in candidates]
    whole = np.logaddexp.reduce(score, axis=1)
    by_end, by_start = [[] for _ in points], [[] for _ in points]
    for k, (a, b) in enumerate(spans):
        by_end[b].append(k)
        by_start[a].append(k)
    fore, rear = np.zeros(len(points)), np.zeros(len(points))
    for i in range(1, len(points)):
        fore[i] = np.logaddexp.reduce([fore[i - 1], *(fore[spans[k][0]] + whole[k] for k in by_end[i])])
    for i in range(len(points) - 2, -1, -1):
        rear[i] = np.logaddexp.reduce([rear[i + 1], *(rear[spans[k][1]] + whole[k] for k in by_start[i])])
    return np.array([np.exp(np.minimum(0.0, fore[a] + score[k] + rear[b] - fore[-1])) for k, (a, b) in enumerate(spans)])


def sentence(rnd: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated text and its entities; over half of its numbers are none."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda a=2, b=9: "".join(rnd.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rnd.randint(a, b)))
    of = lambda kind: rnd.choice(CUES[kind].split())

    def card(good: bool) -> str:
        n = rnd.choice((13, 15, 16, 16, 16, 16, 19))
        body = rnd.choice("3456") + d(n - 2)
        digits = body + next(c for c in "0123456789" if luhn(body + c) == good)
        if n == 15:
            cut = (digits[:4], digits[4:10], digits[10:])
        else:
            cut = tuple(digits[k : k + 4] for k in range(0, n, 4))
        return rnd.choice(("", "", " ", "-", ".", " - ")).join(cut)

    area, mid, line = str(rnd.randint(200, 999)), d(3), d(4)
    phones = (
        f"({area}) {mid}-{line}", f"({area}){mid}-{line}", f"({area}) {mid} {line}", f"{area}-{mid}-{line}", f"{area}.{mid}.{line}", f"+1 ({area}) {mid}-{line}", f"+{rnd.randint(20, 99)} {d(3)} {d(7)}", f"+{rnd.randint(20, 99)} {d(2)} {d(4)} {d(4)}",
        f"+1-{area}-{mid}-{line}", f"1 ({area}) {mid}-{line}", f"1-{area}-{mid}-{line}", f"00{rnd.randint(20, 99)} {d(3)} {d(7)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{rnd.randint(20, 99)}{d(9)}",
    )
    top = rnd.choice(("com", "org", "net", "de", "fr", "info", "io"))
    host = f"{w()}.{top}"
    user = rnd.choice((w(), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}+{w(2, 4)}", f"{w()}ü{w()}"))
    mails_ = (f"{user}@{host}", f"{user}@{w()}.{host}", f"{w()} (at) {host}", f"{w()}[at]{w()}[dot]{top}", f"{w()}@{w()}é{w()}.{top}")
    ips = (".".join(str(rnd.randint(0, 255)) for _ in range(4)),)
    count = rnd.randint(3, 9)
    size = rnd.randint(1, 9)
    start = rnd.randint(10 ** (size - 1), 10**size)
    none = (
        d(rnd.randint(1, 6)), str(rnd.randint(1900, 2030)), f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"${d(2)},{d(3)}.{d(2)}", f"{d(2)}:{d(2)}", card(False),
        "".join(rnd.choice("0123456789abcdef") for _ in range(40)), f"{d(3)} {d(2)}", f"{rnd.randint(300, 999)}.{d(3)}.{d(3)}.{d(3)}", f"@{w()}", f"{w()}@{w()}", f"{w()}{d(rnd.randint(3, 12))}", f"{d(5)}-{d(5)}", f"v{d(1)}.{d(2)}.{d(2)}.{d(1)}.{d(1)}", f"{d(3)}%", f"#{d(rnd.randint(4, 10))}",
        f"{d(3)}/{d(3)}-{d(4)}/{d(2)}", d(rnd.randint(7, 12)), d(rnd.randint(7, 12)), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(8)}-{d(4)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)}", f"0.{d(9)}", f"{d(3)}.{d(8)}", f"{of('other')} {d(rnd.randint(7, 16))}", f"{of('other')} {d(4)}-{d(4)}-{d(4)}",
        " ".join(str(start + k) for k in range(count)), " ".join(d(size) for _ in range(count)), " ".join(d(rnd.randint(1, 7)) for _ in range(count)), "-".join(d(rnd.randint(2, 5)) for _ in range(count)), ".".join(d(rnd.randint(1, 4)) for _ in range(count)), "/".join(d(rnd.randint(1, 4)) for _ in range(count)), f"{d(4)}–{d(4)}", f"({d(4)}) {d(4)}", f"{d(3)}-{d(2)}-{d(4)}",
    )
    out, spans = "", []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.choice((*TYPES, "none", "none", "none", "none", "none"))
        out += " ".join(w() for _ in range(rnd.randint(0, 3)))
        out += rnd.choice(("", " ")) if not out else rnd.choice((" ", " ", ". ", ", ", "\n"))
        if kind != "none" and rnd.random() < 0.4:
            out += of(kind) + rnd.choice((" ", ": ", " "))
        pick = card(True) if kind == "card" else rnd.choice({"phone": phones, "email": mails_, "ip": ips, "none": none}[kind])
        if kind != "none":
            spans.append((len(out), len(out) + len(pick), kind))
        out += pick + rnd.choice(("", "", "", ".", ",", " ."))
        out += rnd.choice((" ", " " + w() + " ", " " + w() + " "))
    return out, spans


def learn(sentences: int = 2_500, rounds: int = 8, seed: int = 11, decay: float = 1e-3) -> dict[str, list[float]]:
    """Weights of each feature by type, by stochastic gradient ascent on the likelihood."""
    rnd = random.Random(seed)
    columns: dict[str, int] = {}
    data = []
    for _ in range(sentences):
        text, spans = sentence(rnd)
        found = [*numbers(text), *mails(text)]
        rows = [[columns.setdefault(f, len(columns)) for f in features(c[2])] for c in found]
        gold = {(s, e): _RANK[k] for s, e, k in spans}
        target = np.array([[gold.get(c[:2]) == t for t in range(len(TYPES))] for c in found], float)
        if found:
            data.append((found, rows, target))
    weights, power = np.zeros((len(columns), len(TYPES))), np.full((len(columns), len(TYPES)), 1e-2)
    for _ in range(rounds):
        rnd.shuffle(data)
        for found, rows, target in data:
            flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            score = np.zeros((len(rows), len(TYPES)))
            np.add.at(score, owner, weights[flat])
            step = target - expected(found, score)
            at, where = np.unique(flat, return_inverse=True)
            g = np.zeros((len(at), len(TYPES)))
            np.add.at(g, where, step[owner])
            g -= decay * weights[at]
            power[at] += g * g
            weights[at] += 0.3 * g / np.sqrt(power[at])
    return {c: [round(float(x), 3) for x in weights[i]] for c, i in columns.items() if np.abs(weights[i]).max() > 0.1}


@lru_cache(maxsize=1)
def shipped() -> tuple[dict[str, int], np.ndarray]:
    """Columns and weights as ``learn`` gave them; ``python -m scholargraph.llm.pii`` writes them anew."""
    kept = json.loads(resources.files("scholargraph.llm").joinpath("pii_weights.json").read_text())
    return {c: i for i, c in enumerate(kept)}, np.array(list(kept.values()))


def field_spans(text: str, field: Field, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The field's entities that overlap no fixed span."""
    return field.spans(text, taken)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, by start. A null text is empty. Null and repeated ids keep
    a row each, repeated rows repeat it; other columns don't matter. Texts are read whole in linear time,
    very long ones too: what is kept of a text is its spans.
    """
    columns, weights = shipped()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2
    told = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], _RANK[x[2]])))

    def run(batches):
        field, empty = Field(columns, weights), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                more = field_spans(text, field, base)
                row = (doc, *(sum(k == x[2] for x in base) for k in TYPES), hashlib.sha256(told(base).encode()).hexdigest() if base else empty, told(base + more))
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


if __name__ == "__main__":
    (Path(__file__).parent / "pii_weights.json").write_text(json.dumps(learn(), indent=0, ensure_ascii=False) + "\n")
