"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Method (linear grouping scheme). Large lengths, sorted downwards, are cut into groups of equal
cardinality and rounded up to the largest of their group. The few sizes that result are packed by an
optimised mix of configurations (a linear program solved by column generation). Actual lengths then
take the places of the rounded ones, and what room remains is filled by best fit with the rest of the
large and then with the small lengths, longest first.

Lengths are whole numbers up to the capacity, so the histogram has at most ``capacity`` rows however
many documents there are. Only it reaches the driver; the plan is a table of places, in runs, which
Spark joins with the ranks of the pieces within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.tokenizing import words_of
from scholargraph.plans.cutpoints import maybe_broadcast, written

#: Bytes of ids that a task hands on at once.
_HELD = 32_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut only where longer than ``capacity``.

    A null text is empty: one piece that holds the end id. Null ids and repeated rows are kept; other
    columns don't matter. With ``keep_ids`` each piece has its token ids as ``ids``.
    """
    cut, tail = 4 * capacity, end_id.to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches):
        words = words_of(tokenizer)
        for batch in batches:
            out, held = [[] for _ in fields], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "") + tail
                for k, at in enumerate(range(0, len(ids), cut)):
                    part = ids[at : at + cut]
                    for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4"))):
                        col.append(v)
                held += keep_ids * len(ids)
                if held > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields)], [n for n, _ in fields])
                    out, held = [[] for _ in fields], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields)], [n for n, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces) of packed pieces that kept their ids: the training sequences, at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.count("*").alias("n_pieces"))


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 300) -> list[tuple[float, np.ndarray]]:
    """(times, units of each size) of the linear program's best mix, by column generation."""
    n = len(sizes)
    columns = [np.eye(n)[i] * (capacity // sizes[i]) for i in range(n)]
    basis, need = list(range(n)), np.array(demand, float)
    for _ in range(rounds):
        matrix = np.array([columns[j] for j in basis]).T
        x, duals = np.linalg.solve(matrix, need), np.linalg.solve(matrix.T, np.ones(n))
        new = _best_fill(sizes, duals, capacity)
        if duals @ new <= 1 + 1e-9:
            break
        step = np.linalg.solve(matrix, new)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        columns.append(new)
        basis[int(ratio.argmin())] = len(columns) - 1
    x = np.linalg.solve(np.array([columns[j] for j in basis]).T, need)
    return [(float(v), columns[j]) for v, j in zip(x, basis) if v > 1e-9]


def _best_fill(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """Units of each size that fit the capacity and are worth most together."""
    best, took = np.zeros(capacity + 1), []
    for s, w in zip(sizes, worth):
        units = np.zeros(capacity + 1, np.int32)
        if w > 0:
            base = best.copy()
            for k in range(1, capacity // s + 1):
                gain = base[: capacity + 1 - k * s] + k * w
                where = gain > best[k * s :]
                best[k * s :][where] = gain[where]
                units[k * s :][where] = k
        took.append(units)
    out, room = np.zeros(len(sizes)), int(best.argmax())
    for i in reversed(range(len(sizes))):
        out[i] = took[i][room]
        room -= int(out[i]) * sizes[i]
    return out


class _Plan:
    """Sequences in runs with equal room, and the places given to each length, by rank."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self.rank: dict[int, int] = defaultdict(int)

    def put(self, length: int, times: int, first: int, each: int, offset: int) -> None:
        at = self.rank[length]
        self.places.append((length, at, at + times, first, each, offset))
        self.rank[length] = at + times

    def leave(self, room: int, first: int, end: int) -> None:
        if first < end and room > 0:
            if not self.runs[room]:
                bisect.insort(self.rooms, room)
            self.runs[room].append((first, end))

    def best_fit(self, length: int, times: int) -> None:
        """Places equal lengths where the least room remains; the same sequence first, as long as they fit."""
        while times:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                new = -(-times // (self.capacity // length))
                self.leave(self.capacity, self.bins, self.bins + new)
                self.bins += new
                continue
            room = self.rooms[k]
            first, end = self.runs[room].pop()
            if not self.runs[room]:
                self.rooms.pop(k)
            each, offset = room // length, self.capacity - room
            whole = min(end - first, times // each)
            if whole:
                self.put(length, whole * each, first, each, offset)
                self.leave(room - each * length, first, first + whole)
                times, first = times - whole * each, first + whole
            if times and first < end:
                n = min(times, each)
                self.put(length, n, first, n, offset)
                self.leave(room - n * length, first, first + 1)
                times, first = times - n, first + 1
            self.leave(room, first, end)


def plan(histogram: dict[int, int], capacity: int, groups: int = 48, large: float = 1 / 6) -> _Plan:
    """Places for ``histogram`` (length: count) in sequences of ``capacity``; see the module's text."""
    out = _Plan(capacity)
    if full := histogram.get(capacity, 0):
        out.put(capacity, full, 0, 1, 0)
        out.bins = full
    big = [[x, histogram[x]] for x in sorted(histogram, reverse=True) if capacity * large < x < capacity and histogram[x]]
    total = sum(n for _, n in big)
    left: dict[int, int] = defaultdict(int)
    if total >= 4 * groups:
        queues, sizes, demand = [], [], []
        bounds = [total * k // groups for k in range(groups + 1)]
        row, used = 0, 0
        for k in range(groups):
            want, queue = bounds[k + 1] - bounds[k], []
            while want:
                n = min(want, big[row][1] - used)
                queue.append([big[row][0], n])
                want, used = want - n, used + n
                if used == big[row][1]:
                    row, used = row + 1, 0
            if sizes and sizes[-1] == queue[0][0]:  # one length may fill several groups
                queues[-1] += queue
                demand[-1] += sum(n for _, n in queue)
            else:
                queues.append(queue)
                sizes.append(queue[0][0])
                demand.append(sum(n for _, n in queue))
        for times, units in _configurations(sizes, demand, capacity):
            times = int(times + 1e-6)
            if not times:
                continue
            runs = [(out.bins, out.bins + times, 0)]
            out.bins += times
            for g in (g for g in range(len(sizes)) for _ in range(int(units[g]))):
                runs = _substitute(out, runs, queues[g])
            for first, end, used in runs:
                out.leave(capacity - used, first, end)
        for queue in queues:
            for x, n in queue:
                left[x] += n
    else:
        for x, n in big:
            left[x] += n
    for x in sorted(left, reverse=True):
        out.best_fit(x, left[x])
    for x in sorted((x for x in histogram if 0 < x <= capacity * large), reverse=True):
        out.best_fit(x, histogram[x])
    return out


def _substitute(out: _Plan, runs: list[tuple[int, int, int]], queue: list[list[int]]) -> list[tuple[int, int, int]]:
    """One place per sequence of ``runs`` for the next actual lengths of a group, largest first."""
    after = []
    for first, end, used in runs:
        while first < end and queue:
            x, n = queue[0]
            take = min(n, end - first)
            out.put(x, take, first, 1, used)
            after.append((first, first + take, used + x))
            first += take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
        if first < end:
            after.append((first, end, used))
    return after


PLACES = "length long, rank_from long, rank_to long, first long, each long, at long"


def pack(parts: DataFrame, capacity: int, salts: int | None = None) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset; no row is dropped or cut.

    Ranks within a length come from (length, salt) windows and the counts of the salts before, so a
    length that a third of all pieces have is ranked by many tasks. An empty table gives an empty one.
    ``parts`` is read twice and should be a written table.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    made = plan(histogram, capacity)
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")
    places = spark.createDataFrame(made.places, PLACES)
    at = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["rank_from"]) & (ranked["rank"] < places["rank_to"])
    within = F.col("rank") - F.col("rank_from")
    return ranked.join(maybe_broadcast(places, len(made.places)), at).select(
        *[ranked[c] for c in parts.columns],
        (F.col("first") + F.expr("(rank - rank_from) div each")).alias("sequence_id"),
        (F.col("at") + within % F.col("each") * ranked["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and ids with ``keep_ids``.

    Null texts are empty, null ids and repeated rows are kept, a very long text makes many pieces, an
    empty table gives an empty one.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces"), capacity)
