"""Best-fit packing of documents into sequences by linear grouping.

Only how many pieces there are of each length is needed to plan: one row per length, at most as many as a sequence has
tokens, whatever the size of the data. The plan is made from these counts on the driver:

1. Long lengths that many pieces share are sizes of their own. The others, in falling order, are cut into groups of equal
   cardinality, and each group is rounded up to its longest.
2. For these few sizes, configurations (how many of each size share a sequence) are found by column generation: the
   fractional optimum over all configurations, a knapsack giving the next one to enter. Whole parts are taken; what is left
   over, a few pieces per size, is packed best fit by hand.
3. The real pieces take the places of their group, longest first, so each sequence has room beyond what was planned.
4. Short lengths, longest first, go to the fullest sequence that still takes them, or open new ones.

Which lengths count as long is tried at several limits, and the plan with the fewest sequences is taken.

The plan is a table of runs: pieces ``first`` to ``last`` of a length go to consecutive sequences at a common offset. Its
size is bounded by the lengths and configurations, so it is broadcast. Pieces get a rank among those of their length,
counted in two levels so that a length which a third of all pieces share is split over tasks, and look up their run.

Cases: a null or empty text is one piece with the end id only; texts longer than a sequence are cut, others never; repeated
rows are packed one by one; an empty table gives no rows. Input columns named like an output are replaced by it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import packed, unpacked, written
from tidemark.llm.tokens import END, VOCABULARY, pieces

CAPACITY = 4096
#: Lengths from capacity / LONG on are planned by configurations, in about GROUPS groups; ``fewest`` tries all of LONGS.
#: Rounding costs room that only short pieces can fill; with LONG 2 the plan comes within 0.01 % of total / capacity on the
#: test data, with 4 within 0.4 %. On a few heavy lengths it is the other way round.
LONG, LONGS, GROUPS, ENTERING = 2, (2, 4, 8), 64, 3000


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, pieces)]), sizes falling: lengths with a group's pieces or more by themselves, the others in
    groups of equal cardinality."""
    share = -(-sum(counts.values()) // groups)
    exact = [(length, [(length, n)]) for length, n in counts.items() if n >= share]
    rest = {length: n for length, n in counts.items() if n < share}
    return sorted(exact + equal_groups(rest, groups), key=lambda g: -g[0])


def equal_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    total = sum(counts.values())
    out, open_, room = [], [], -(-total // groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, room)
            open_.append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append((open_[0][0], open_))
                open_, room = [], -(-total // groups)
    if open_:
        out.append((open_[0][0], open_))
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, members in out:  # groups of one length are one
        if merged and merged[-1][0] == size and all(n == size for n, _ in members + merged[-1][1]):
            merged[-1][1].extend(members)
        else:
            merged.append((size, members))
    return merged


def best_knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration, any number of each size.

    For one size the rooms it links form chains; along a chain the best is a running maximum less what the size earns.
    """
    worth = [np.zeros(capacity + 1)]
    for size, value in zip(sizes.tolist(), values.tolist(), strict=True):
        rows = -(-(capacity + 1) // size)
        chains = np.full(rows * size, -np.inf)
        chains[: capacity + 1] = worth[-1]
        earned = value * np.arange(rows)[:, None]
        worth.append((np.maximum.accumulate(chains.reshape(rows, size) - earned, axis=0) + earned).ravel()[: capacity + 1])
    config, room = np.zeros(len(sizes), int), capacity
    for k in range(len(sizes) - 1, -1, -1):
        while worth[k + 1][room] > worth[k][room] + 1e-12:
            config[k] += 1
            room -= sizes[k]
    return float(config @ values), config


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, pieces of each size) that take up the demand exactly, close to the fewest sequences."""
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(ENTERING):
        prices = np.linalg.solve(basis.T, np.ones(len(size)))
        value, config = best_knapsack(size, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        amounts, change = np.linalg.solve(basis, need), np.linalg.solve(basis, config.astype(float))
        steps = np.where(change > 1e-9, np.maximum(amounts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(steps))] = config
    amounts = np.linalg.solve(basis, need)
    out, left = [], np.array(demand)
    for k in np.argsort(-amounts):
        config = basis[:, k].astype(int)
        times = int(amounts[k] + 1e-9)
        for j in np.flatnonzero(config):
            times = min(times, int(left[j] // config[j]))
        if times > 0:
            out.append((times, tuple(config.tolist())))
            left = left - times * config
    # What is left over, best fit, longest first; left has a few pieces of each size.
    rooms: list[list] = []
    for j in range(len(size)):
        for _ in range(int(left[j])):
            fitting = [r for r in rooms if r[0] >= size[j]]
            if fitting:
                best = min(fitting, key=lambda r: r[0])
            else:
                rooms.append(best := [capacity, [0] * len(size)])
            best[0] -= int(size[j])
            best[1][j] += 1
    return out + [(1, tuple(r[1])) for r in rooms]


class Plan:
    """Runs (length, first, last, sequence, per_sequence, offset): rank r of a length goes to sequence
    ``sequence + (r - first) // per_sequence`` at ``offset + (r - first) % per_sequence * length``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, long: int = LONG, groups: int = GROUPS):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.next_rank: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first sequence, sequences)
        self.rooms: list[int] = []
        whole = counts.get(capacity, 0)
        if whole:
            self.place(capacity, whole, self.new(whole), 1, 0)
        long_ = {n: c for n, c in counts.items() if capacity // long <= n < capacity}
        if long_:
            self.substitute(grouped(long_, groups))
        for length in sorted((n for n in counts if n < capacity // long), reverse=True):
            self.best_fit(length, counts[length])

    def new(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences

    def place(self, length: int, pieces: int, sequence: int, per: int, offset: int) -> None:
        first = self.next_rank[length]
        self.next_rank[length] = first + pieces
        self.runs.append((length, first, first + pieces, sequence, per, offset))

    def free(self, room: int, sequence: int, sequences: int) -> None:
        if room and sequences:
            if not self.room[room]:
                heapq.heappush(self.rooms, room)
            self.room[room].append((sequence, sequences))

    def substitute(self, groups: list[tuple[int, list[tuple[int, int]]]]) -> None:
        """Real pieces in the places of the configurations; sequences whose pieces have equal lengths go together."""
        queues = [[list(m) for m in members] for _, members in groups]
        demand = [sum(n for _, n in members) for _, members in groups]
        for times, config in configurations([size for size, _ in groups], demand, self.capacity):
            slots = []
            for queue, each in zip(queues, config, strict=True):
                for _ in range(each):
                    need, lengths = times, []
                    while need:
                        take = min(need, queue[0][1])
                        lengths.append((queue[0][0], take))
                        queue[0][1] -= take
                        need -= take
                        if not queue[0][1]:
                            queue.pop(0)
                    slots.append(lengths)
            ends = sorted({int(e) for s in slots for e in np.cumsum([n for _, n in s])})
            at = self.new(times)
            for first, last in zip([0, *ends[:-1]], ends, strict=True):
                used = 0
                for s in slots:
                    if not s[0][1]:
                        s.pop(0)
                    self.place(s[0][0], last - first, at + first, 1, used)
                    used += s[0][0]
                    s[0] = (s[0][0], s[0][1] - (last - first))
                self.free(self.capacity - used, at + first, last - first)

    def best_fit(self, length: int, pieces: int) -> None:
        skipped = []
        while pieces:
            while self.rooms and self.rooms[0] < length:
                skipped.append(heapq.heappop(self.rooms))
            if self.rooms:
                room = self.rooms[0]
                sequence, sequences = self.room[room].pop()
                if not self.room[room]:
                    heapq.heappop(self.rooms)
            else:
                room, sequences = self.capacity, -(-pieces // (self.capacity // length))
                sequence = self.new(sequences)
            per = room // length
            full = min(sequences, pieces // per)
            if full:
                self.place(length, full * per, sequence, per, self.capacity - room)
                self.free(room - per * length, sequence, full)
                pieces -= full * per
            if full < sequences and pieces:
                self.place(length, pieces, sequence + full, pieces, self.capacity - room)
                self.free(room - pieces * length, sequence + full, 1)
                pieces, full = 0, full + 1
            self.free(room, sequence + full, sequences - full)
        for room in skipped:
            heapq.heappush(self.rooms, room)


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences; the first of equals."""
    least, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for long in LONGS:
        plan = Plan(counts, capacity, long)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def ranked(rows: DataFrame, counts: DataFrame, cell_rows: int) -> DataFrame:
    """``rank`` of each row among those of its length, from 0. ``counts``: (length, n)."""
    parts = counts.filter(F.col("n") > cell_rows).select("length", F.ceil(F.col("n") / cell_rows).alias("parts"))
    hashed = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.coalesce("parts", F.lit(1)))
    # At most one row for each length of a sequence: of bounded size.
    cut = rows.join(F.broadcast(parts), "length", "left").withColumn("part", hashed).drop("parts")
    along = Window.partitionBy("length").orderBy("part")
    starts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    starts = starts.select("length", "part", (F.sum("n").over(along) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    nth = cut.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["length", "part"])
    return nth.withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")


def pack(rows: DataFrame, capacity: int = CAPACITY, cell_rows: int = 100_000) -> DataFrame:
    """Rows (id, piece, length, ids_crc32, and any others) with ``sequence_id`` and ``offset``."""
    counts = written(rows.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    # One row per length, at most ``capacity`` of them.
    plan = fewest({r.length: r.n for r in counts.collect()}, capacity)
    kind = "at_length int, first long, last long, sequence long, per int, at long"
    runs = rows.sparkSession.createDataFrame([tuple(map(int, r)) for r in plan.runs], kind)
    found = ranked(rows, counts, cell_rows).join(
        F.broadcast(runs),
        (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")),
    )
    nth = F.col("rank") - F.col("first")
    return found.withColumns(
        {
            "sequence_id": F.col("sequence") + F.floor(nth / F.col("per")),
            "offset": (F.col("at") + nth % F.col("per") * F.col("length")).cast("long"),
        }
    ).drop("rank", *runs.columns)


def packed_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    vocabulary: str = VOCABULARY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the carried columns, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` if asked for,
    ``sequence_id`` and ``offset``."""
    cut = docs.select(
        packed(docs, carry), F.col(id_col).alias("id"), F.explode(pieces(capacity, vocabulary, end, with_ids)(F.col(text_col))).alias("p")
    ).select("row", "id", "p.*")
    table = written(cut if with_ids else cut.drop("ids"), "pieces")
    outputs = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return unpacked(pack(table, capacity).withColumn("length", F.col("length").cast("long")), *outputs)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, ids), pieces in their places. A sequence is at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped_ = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p.getField("ids")))
    return grouped_.select("sequence_id", joined.alias("ids"))
