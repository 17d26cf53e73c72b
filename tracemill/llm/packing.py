"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own; all
others are dealt at random to cells of about ``CELL`` pieces, and every cell is packed on several
islands. An individual is a set of bins. Crossover injects well-filled bins of one parent whole
into the other, removes the bins that hold duplicates, and places the displaced pieces by best
fit, longest first. After each epoch an island's best individual migrates to the next island of
its cell. The best individual of a cell wins; pieces of its poorly filled bins are pooled over many
cells and packed once more, so cells cost next to nothing in sequences.

Defined results: NULL and empty texts are one piece that holds the end token alone. Every row is
packed, repeated rows and rows without doc_id too. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.encode import encoder
from tracemill.session import materialise

CAPACITY = 2048
END_ID = 0
#: Pieces of a cell; cells whose poor bins are pooled for the second packing.
CELL, POOL = 512, 32
ISLANDS_PER_TASK = 16
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 6
#: A bin filled to this share is worth injecting, and is not packed again.
WELL = 0.97

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, spread long"


def _pieces(path: str, pattern: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, pattern).encode
        context = TaskContext.get()
        rng = np.random.default_rng(context.partitionId() if context else 0)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                start, end, piece = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["spread"] = rng.integers(0, 1 << 62, len(frame))
            yield frame

    return run


def best_fit(bins: list[list[int]], free: list[int], items: list[int], lengths: list[int], capacity: int) -> None:
    """Place items, longest first, each into the bin that it fills best; opens bins as needed."""
    room = sorted((f, k) for k, f in enumerate(free))
    for item in sorted(items, key=lambda i: -lengths[i]):
        need = lengths[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[k].append(item)
        free[k] = left - need
        insort(room, (left - need, k))


class Island:
    """A population of packings of one cell."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)

    def load(self, pack: list[list[int]]) -> list[int]:
        return [sum(self.lengths[i] for i in b) for b in pack]

    def worth(self, pack: list[list[int]]) -> tuple[int, int]:
        """Fewer bins first, then bins filled as unevenly as can be."""
        return len(pack), -sum(x * x for x in self.load(pack))

    def fresh(self, noise: float) -> list[list[int]]:
        """Best fit in nearly falling order."""
        bins: list[list[int]] = []
        room: list[tuple[int, int]] = []
        lengths = self.lengths
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + noise * self.rng.random()))
        for i in order:
            at = bisect_left(room, (lengths[i], -1))
            left, k = room.pop(at) if at < len(room) else (self.capacity, len(bins))
            if k == len(bins):
                bins.append([])
            bins[k].append(i)
            insort(room, (left - lengths[i], k))
        return bins

    def cross(self, mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        well = WELL * self.capacity
        good = [b for b, x in zip(father, self.load(father)) if x >= well]
        if not good:
            return mother
        injected = self.rng.sample(good, self.rng.randint(1, len(good)))
        taken = {i for b in injected for i in b}
        bins, displaced = [list(b) for b in injected], []
        for b in mother:
            if taken.isdisjoint(b):
                bins.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        # The emptiest bin is opened too: only so can the number of bins fall.
        if len(bins) > len(injected):
            load = self.load(bins)
            poor = min(range(len(injected), len(bins)), key=load.__getitem__)
            displaced += bins.pop(poor)
        free = [self.capacity - x for x in self.load(bins)]
        best_fit(bins, free, displaced, self.lengths, self.capacity)
        return bins

    def evolve(self, guests: list[list[list[int]]]) -> list[list[int]]:
        least = -(-sum(self.lengths) // self.capacity)
        people = [*guests, self.fresh(0.0)]
        people += [self.fresh(0.2) for _ in range(POPULATION - len(people))]
        people.sort(key=self.worth)
        for _ in range(GENERATIONS):
            if len(people[0]) == least:
                break
            children = [self.cross(*self.rng.sample(people, 2)) for _ in range(2)]
            people = sorted([*people, *children], key=self.worth)[:POPULATION]
        return people[0]


def _numbers(pack: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(pack):
        for i in b:
            out[i] = k
    return out


def _groups(numbers) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return out


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packs, counts, squares = [], [], []
            for cell, island, lengths, guests in zip(
                batch["cell"], batch["island"], batch["lengths"], batch["guests"]
            ):
                own = Island([int(x) for x in lengths], capacity, hash((int(cell), int(island), epoch)))
                best = own.evolve([_groups(list(g)) for g in guests])
                n, s = own.worth(best)
                packs.append(_numbers(best, len(lengths)))
                counts.append(n)
                squares.append(s)
            yield pd.DataFrame(
                {"cell": batch["cell"], "island": batch["island"], "pack": packs, "n_bins": counts, "squares": squares}
            )

    return run


def _solve(rows: DataFrame, capacity: int, name: str, n_cells: int) -> DataFrame:
    """Pack rows (cell, piece columns): adds ``bin`` and ``offset`` within the cell, and ``load``."""
    piece = [c for c in rows.columns if c != "cell"]
    cells = materialise(
        rows.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("spread", *[c for c in piece if c != "spread"]))).alias("items")),
        f"{name}-cells",
    )
    lengths = cells.select("cell", F.col("items.length").alias("lengths"))
    none = F.array().cast("array<array<int>>")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = lengths.select("cell", "lengths", islands, none.alias("guests"))
    # Evolving takes long for its bytes: a fixed number of tasks, which is never merged by size.
    tasks = max(1, -(-n_cells * ISLANDS // ISLANDS_PER_TASK))
    elite = None
    for epoch in range(EPOCHS):
        # Island and cell together: the islands of a cell are not tied to one task.
        elite = materialise(
            state.repartition(tasks, "cell", "island").mapInPandas(
                _epoch(capacity, epoch), "cell long, island int, pack array<int>, n_bins int, squares long"
            ),
            f"{name}-elite",
        )
        moved = elite.select(
            "cell", "pack", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island")
        )
        guests = moved.groupBy("cell", "island").agg(F.collect_list("pack").alias("guests"))
        state = guests.join(lengths, "cell").select("cell", "lengths", "island", "guests")
    best = elite.groupBy("cell").agg(
        F.min(F.struct("n_bins", "squares", "island", "pack")).alias("best")
    ).select("cell", F.col("best.pack").alias("pack"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            offsets, loads = [], []
            for lengths, pack in zip(batch["lengths"], batch["pack"]):
                used = [0] * (max(pack, default=-1) + 1)
                own = []
                for n, k in zip(lengths, pack):
                    own.append(used[k])
                    used[k] += int(n)
                offsets.append(own)
                loads.append([used[k] for k in pack])
            yield pd.DataFrame(
                {"cell": batch["cell"], "pack": batch["pack"], "offsets": offsets, "loads": loads}
            )

    placed = lengths.join(best, "cell").mapInPandas(
        place, "cell long, pack array<int>, offsets array<int>, loads array<int>"
    )
    return (
        cells.join(placed, "cell")
        .select("cell", F.explode(F.arrays_zip("items", "pack", "offsets", "loads")).alias("x"))
        .select("cell", "x.items.*", F.col("x.pack").alias("bin"), F.col("x.offsets").alias("offset"), F.col("x.loads").alias("load"))
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece (columns of ``PIECE``, written before)."""
    partial = pieces.where(F.col("length") < capacity)
    n_cells = max(1, -(-partial.count() // CELL))
    first = materialise(
        _solve(partial.withColumn("cell", F.pmod("spread", F.lit(n_cells))), capacity, "pack", n_cells), "packed"
    )
    done = (F.col("load") >= WELL * capacity) | F.lit(n_cells == 1)
    again = first.where(~done).select(*pieces.columns, "cell")
    pools = -(-n_cells // POOL)
    # Other random bits than those that chose the cell.
    pooled = _solve(
        again.withColumn("cell", F.pmod(F.xxhash64("spread"), F.lit(pools))), capacity, "pool", pools
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def numbered(rows: DataFrame, family: int) -> DataFrame:
        number = (F.col("cell") * (1 << 20) + F.col("bin")) * 4 + family
        return rows.select(*columns, number.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))

    full = pieces.where(F.col("length") >= capacity).select(
        *columns, (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    both = numbered(first.where(done), 0).unionByName(numbered(pooled, 1)).unionByName(full)
    return both.withColumn("length", F.col("length").cast("long"))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; see the module's text."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _pieces(path, pattern, capacity), PIECE
    )
    return pack_pieces(materialise(pieces, "pieces"), capacity)
