"""Hard negatives by cover trees over norm-augmented candidates.

Vectors of whole numbers c get one more coordinate sqrt(M^2 - |c|^2), M being the largest norm, so
that all candidates lie on a sphere. For an anchor q (with 0 there) the distance D to a node's centre
and the node's covering radius r bound every inner product below it, twice over:

    q.c - |q| r  <=  q.x  <=  q.c + |q| r            (Cauchy)
    D - r  <=  distance(q, x)  <=  D + r,  with  q.x = (|q|^2 + M^2 - distance^2) / 2

The top level of the tree is global: bounded many pivots, chosen far apart from a bounded sample, with
the covering radius of each cell over all candidates. Cells are cut into parts of bounded size; each
part grows the lower levels in one task. Anchors go to the parts of those cells only whose bounds
leave a chance, descend best node first, skip nodes outside what they look for, and verify leaves by
exact integer products. Three passes: positives in the most promising cell, positives in all cells
that may still beat these, then negatives in all cells that meet a window.

Of candidates with equal label and vector only the ``WINNERS`` smallest ids can be in any result (five
and the anchor itself); the others leave first, which Spark does map-side, so copies are no hot spot.

Defined results: rows take part as the contract says. Rows with equal id, label and vector count
once; a NULL id is the largest. Vectors are only compared with vectors of the same length. Components
beyond 2^24 after scaling count as 2^24, so that scores fit 64 bits. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import group_starts
from tracemill.session import materialise

POSITIVES = 5
NEGATIVES = 5
WINNERS = 6
#: Candidates of one tree, anchors of one task, candidates for each pivot, and the most pivots.
PART_ROWS = 4096
BLOCK_ROWS = 65_536
CELL_ROWS = 8192
PIVOTS = 1024
#: Anchors that descend a tree together.
TOGETHER = 256
#: Rows from which pivots are chosen, for each pivot.
SAMPLED = 8
LEAF = 48
FAN = 32
_LIMIT = float(1 << 24)
_NO_ID = (1 << 63) - 1
_FAR = -(1 << 62)


# ---- candidates -------------------------------------------------------------------------


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """(id, label, vec, dims) of the rows that take part, labels moved and components whole."""
    usable = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        embeddings.select(
            F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"),
            "label",
            F.col("embedding").cast("array<double>").alias("vec"),
        )
        .where(F.col("label").isNotNull() & F.col("vec").isNotNull())
        .where(usable)
    )
    moved = F.when((F.col("id") % 7 == 0) & (F.col("id") != _NO_ID), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(
        "vec", lambda x: F.greatest(F.least(F.floor(x * 256).cast("double"), F.lit(_LIMIT)), F.lit(-_LIMIT)).cast("int")
    )
    return rows.select("id", moved.cast("long").alias("label"), whole.alias("vec"), F.size("vec").alias("dims"))


def candidates(rows: DataFrame) -> DataFrame:
    """Of rows with equal label and vector the ``WINNERS`` smallest ids."""
    # Ranked map-side first, so a vector with very many copies sends a few rows for each task.
    same = Window.partitionBy("label", "vec").orderBy("id")
    ranked = rows.withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= WINNERS).drop("_n")
    return ranked.dropDuplicates(["id", "label", "vec"])


# ---- the global level -------------------------------------------------------------------


def _stack(vectors) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (
        np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres)[None, :] - 2.0 * x @ centres.T
    )
    return np.sqrt(np.maximum(square, 0.0))


def _far_apart(x: np.ndarray, count: int, shrink: float = 0.0) -> list[int]:
    """Rows of ``x``, each the farthest from those before, until all lie within ``shrink`` of the first radius."""
    chosen, gap, first = [0], _distances(x, x[:1])[:, 0], None
    while len(chosen) < count:
        at = int(gap.argmax())
        first = gap[at] if first is None else first
        if gap[at] <= shrink * first or gap[at] == 0.0:
            break
        chosen.append(at)
        gap = np.minimum(gap, _distances(x, x[at : at + 1])[:, 0])
    return chosen


def _slack(q_norm, top: float):
    """What floating point may lose in a bound."""
    return 1e-9 * (q_norm * q_norm + top * top) + 1e-6


def _bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor (row) with the points of each node (column)."""
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
    inner = q @ centres[:, :-1].T
    half = (norm * norm + top * top) / 2.0
    distance = np.sqrt(np.maximum(2.0 * (half - inner), 0.0))
    high = np.minimum(inner + norm * radii, half - np.maximum(distance - radii, 0.0) ** 2 / 2.0)
    low = np.maximum(inner - norm * radii, half - (distance + radii) ** 2 / 2.0)
    slack = _slack(norm, top)
    return low - slack, high + slack


class _Level:
    """The global level of one dimension: pivots and, once known, the covering radii of their cells."""

    def __init__(self, vectors: list[list[int]], top: float, count: int):
        sample = _augmented(np.array(vectors, dtype=np.float64).reshape(len(vectors), -1), top)
        self.top = top
        self.pivots = sample[_far_apart(sample, count)]
        self.radii = np.zeros(len(self.pivots))
        self.parts = np.zeros(len(self.pivots), dtype=np.int64)


def _levels(rows: DataFrame, cell_rows: int) -> dict[int, _Level]:
    """Pivots of each dimension from the rows with the smallest hashes: ``SAMPLED`` for each pivot.

    At most ``PIVOTS`` pivots, so a bounded number of vectors comes to the driver for a dimension.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).collect()
    levels = {}
    for size in sizes:
        count = max(1, min(PIVOTS, -(-size.n // cell_rows)))
        drawn = rows.where(F.col("dims") == size.dims).orderBy(F.xxhash64("id", "label"), "id").limit(count * SAMPLED)
        vectors = [r.vec for r in drawn.select("vec").collect()]
        # A little more, so that rounding never makes a rest negative.
        levels[size.dims] = _Level(vectors, float(size.top) * (1 + 1e-12) + 1e-9, count)
    return levels


def _by_dims(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch["dims"].to_numpy()
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _assign(levels: dict[int, _Level]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, gap = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for dims, at in _by_dims(batch):
                level = levels[dims]
                far = _distances(_augmented(_stack(batch["vec"].iloc[at]), level.top), level.pivots)
                cell[at] = far.argmin(axis=1)
                gap[at] = far.min(axis=1)
            yield batch.assign(cell=cell, gap=gap)

    return run


def _with_cells(rows: DataFrame, levels: dict[int, _Level], part_rows: int) -> DataFrame:
    """Candidates with their cell and part; sets the covering radii and numbers of parts."""
    placed = rows.mapInPandas(_assign(levels), "id long, label long, vec array<int>, dims int, cell int, gap double")
    placed = materialise(placed, "candidates-in-cells")
    # One row for each pivot.
    for cell in placed.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect():
        level = levels[cell.dims]
        level.radii[cell.cell] = cell.r + _slack(0.0, level.top) ** 0.5
        level.parts[cell.cell] = -(-cell.n // part_rows)
    counts = {(d, k): int(p) for d, level in levels.items() for k, p in enumerate(level.parts)}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = np.array([counts[d, c] for d, c in zip(batch["dims"], batch["cell"])], dtype=np.uint64)
            mixed = batch["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mixed >> np.uint64(33)) % np.maximum(n, np.uint64(1))).astype(np.int32)
            yield batch[["id", "label", "vec", "dims", "cell"]].assign(part=part)

    return placed.mapInPandas(part, "id long, label long, vec array<int>, dims int, cell int, part int")


# ---- the lower levels -------------------------------------------------------------------


class CoverTree:
    """Cover tree over the candidates of one part.

    The children of a node are points far apart that cover it; a child's radius is that of its own
    points, at most half the node's where ``FAN`` children are enough for that.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float):
        self.ids, self.labels, self.vectors, self.top = ids, labels, vectors, top
        self._points = _augmented(vectors, top)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.members: list[np.ndarray | None] = []
        self._grow(np.arange(len(ids)))
        self._centres, self._radii = np.array(self.centres), np.array(self.radii)
        largest = float(np.abs(vectors).max(initial=0.0))
        self._exact = largest * top * vectors.shape[1] < 2.0**52
        self._whole = vectors.astype(np.int64)

    def _node(self, centre: np.ndarray, radius: float) -> int:
        self.centres.append(centre)
        # Distances of equal points come out as rounding errors.
        self.radii.append(radius + _slack(0.0, self.top) ** 0.5)
        self.children.append((0, 0))
        self.members.append(None)
        return len(self.centres) - 1

    def _grow(self, everything: np.ndarray) -> None:
        gap = _distances(self._points[everything], self._points[everything[:1]])[:, 0]
        waiting = [(self._node(self._points[everything[0]], float(gap.max())), everything)]
        while waiting:
            node, members = waiting.pop()
            if len(members) > LEAF:
                points = self._points[members]
                chosen = _far_apart(points, FAN, 0.5)
                if len(chosen) > 1:
                    far = _distances(points, points[chosen])
                    nearest = far.argmin(axis=1)
                    first = len(self.centres)
                    for k, at in enumerate(chosen):
                        own = nearest == k
                        if own.any():
                            child = self._node(points[at], float(far[own, k].max()))
                            waiting.append((child, members[own]))
                    self.children[node] = (first, len(self.centres))
                    continue
            self.members[node] = members

    def products(self, q: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Exact inner products of anchors (rows) with some candidates (columns)."""
        if self._exact:
            return (q @ self.vectors[members].T).astype(np.int64)
        return q.astype(np.int64) @ self._whole[members].T

    def leaves(self, q: np.ndarray, wanted) -> tuple[np.ndarray, ...]:
        """(anchor, leaf, low, high) of the leaves that are left when the levels are descended.

        ``wanted(low, high)`` says which bounds, one row for each anchor, leave a chance; nodes that it
        refuses are skipped with all that is below them.
        """
        nodes, active = np.array([0]), np.ones((len(q), 1), dtype=bool)
        found = []
        while len(nodes):
            low, high = _bounds(q, self._centres[nodes], self._radii[nodes], self.top)
            active = active & wanted(low, high)
            leaf = np.array([self.members[n] is not None for n in nodes])
            anchor, at = np.nonzero(active & leaf)
            found.append((anchor, nodes[at], low[anchor, at], high[anchor, at]))
            go = np.flatnonzero(active.any(axis=0) & ~leaf)
            spans = [self.children[n] for n in nodes[go]]
            nodes = np.concatenate([np.arange(*span) for span in spans]) if spans else np.zeros(0, dtype=int)
            active = active[:, np.repeat(go, [last - first for first, last in spans])]
        return tuple(np.concatenate(column) for column in zip(*found))


def _rank_in(group: np.ndarray) -> np.ndarray:
    """Place of each entry of a sorted array among its equals."""
    first = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, dtype=bool)
    return np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))


class _Search:
    """The first ``count`` candidates in every window [least, most] of a block of anchors.

    Highest score first, then smallest id. ``least`` rises to the last of the first ``count`` as they
    are found, so that the later leaves of an anchor, which are taken best bound first, fall away.
    """

    def __init__(self, tree: CoverTree, q, ids, labels, least, most, same: bool, count: int):
        self._tree, self._q, self._ids, self._labels = tree, q, ids, labels
        self._least, self._most, self._same, self._count = least, most, same, count
        nothing = np.zeros(0, dtype=np.int64)
        self.slots, self.scores, self.found = nothing, nothing, nothing

    def _wanted(self, low: np.ndarray, high: np.ndarray, anchor=slice(None)) -> np.ndarray:
        """For bounds of one row, or one entry, for each of ``anchor``."""
        chance = np.zeros(low.shape, dtype=bool)
        for w in range(self._least.shape[1]):
            least, most = self._least[anchor, w], self._most[anchor, w]
            if low.ndim == 2:
                least, most = least[:, None], most[:, None]
            chance |= (low <= most) & (high >= least)
        return chance

    def run(self) -> None:
        anchor, leaf, low, high = self._tree.leaves(self._q, self._wanted)
        order = np.lexsort((-high, anchor))
        anchor, leaf, low, high = anchor[order], leaf[order], low[order], high[order]
        rank, first, size = _rank_in(anchor), 0, 2
        while first <= rank.max(initial=-1):
            now = np.flatnonzero((rank >= first) & (rank < first + size))
            now = now[self._wanted(low[now], high[now], anchor[now])]
            self._verify(anchor[now], leaf[now])
            first, size = first + size, size * 3

    def _verify(self, anchor: np.ndarray, leaf: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        anchor, leaf = anchor[order], leaf[order]
        new = [(self.slots, self.scores, self.found)]
        for group in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            if not len(group):
                continue
            a, members = anchor[group], self._tree.members[leaf[group[0]]]
            scores, ids = self._tree.products(self._q[a], members), self._tree.ids[members]
            good = (self._labels[a][:, None] == self._tree.labels[members]) == self._same
            good &= ids != self._ids[a][:, None]
            for w in range(self._least.shape[1]):
                hit = good & (scores <= self._most[a, w][:, None]) & (scores >= self._least[a, w][:, None])
                row, column = np.nonzero(hit)
                new.append((a[row] * self._least.shape[1] + w, scores[row, column], ids[column]))
        slots, scores, found = (np.concatenate(c) for c in zip(*new))
        order = np.lexsort((found, -scores, slots))
        slots, scores, found = slots[order], scores[order], found[order]
        rank = _rank_in(slots)
        keep = rank < self._count
        self.slots, self.scores, self.found = slots[keep], scores[keep], found[keep]
        full = rank == self._count - 1
        least = self._least.reshape(-1)
        least[slots[full]] = np.maximum(least[slots[full]], scores[full])


def _windows(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of negatives for positive scores p: 80 p <= 100 n is n >= ceil(4 p / 5). Short rows get empty ones."""
    most = np.full((len(scores), max((len(s) for s in scores), default=0)), -1, dtype=np.int64)
    for k, s in enumerate(scores):
        most[k, : len(s)] = s
    return np.where(most < 0, 0, -(-4 * most // 5)), most


FOUND = "anchor long, positive_id long, id long, score long, positive_score long"


def _search_block(tree: CoverTree, rows: pd.DataFrame, negatives: bool, count: int) -> pd.DataFrame:
    q = _stack(rows["vec"])
    if negatives:
        least, most = _windows(rows["pos_scores"].to_list())
    else:
        least, most = rows["bar"].to_numpy(dtype=np.int64)[:, None].copy(), np.full((len(rows), 1), _NO_ID)
    search = _Search(tree, q, rows["id"].to_numpy(), rows["label"].to_numpy(), least, most, not negatives, count)
    search.run()
    anchor, window = np.divmod(search.slots, max(1, least.shape[1]))
    out = pd.DataFrame({"anchor": rows["anchor"].to_numpy()[anchor], "id": search.found, "score": search.scores})
    if negatives:
        places = list(zip(anchor, window))
        out["positive_id"] = np.array([rows["pos_ids"].iloc[a][w] for a, w in places], dtype=np.int64)
        out["positive_score"] = most[anchor, window]
    else:
        out["positive_id"] = out["positive_score"] = np.int64(0)
    return out[[column.split()[0] for column in FOUND.split(", ")]]


def _descend(negatives: bool, tops: dict[int, float], count: int):
    keys = ["dims", "cell", "part", "block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, tree = None, [], None
        for batch in batches:
            edges = group_starts(batch, [*keys, "asked"]) if len(batch) else [0]
            for first, last in zip(edges, edges[1:]):
                rows = batch.iloc[first:last]
                here = tuple(rows[keys].iloc[0])
                if here != cell:
                    cell, held, tree = here, [], None
                if not rows["asked"].iloc[0]:
                    held.append(rows[["id", "label", "vec"]])
                    continue
                if tree is None:
                    points = pd.concat(held)
                    tree = CoverTree(
                        points["id"].to_numpy(), points["label"].to_numpy(), _stack(points["vec"]), tops[here[0]]
                    )
                    held = []
                for at in range(0, len(rows), TOGETHER):
                    yield _search_block(tree, rows.iloc[at : at + TOGETHER], negatives, count)

    return run


# ---- passes -----------------------------------------------------------------------------


def _route(levels: dict[int, _Level], home_only: bool, windows: bool):
    """Cells that an anchor has to visit: ``cells`` of (cell, parts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.empty(len(batch), dtype=object)
            for dims, at in _by_dims(batch):
                level = levels[dims]
                low, high = _bounds(_stack(batch["vec"].iloc[at]), level.pivots, level.radii, level.top)
                filled = level.parts > 0
                homes = np.where(filled, high, -np.inf).argmax(axis=1)
                if windows:
                    least, most = _windows(batch["pos_scores"].iloc[at].to_list())
                    meets = np.zeros(high.shape, dtype=bool)
                    for w in range(least.shape[1]):
                        some = (least[:, w] <= most[:, w])[:, None]
                        meets |= some & (high >= least[:, [w]]) & (low <= most[:, [w]])
                else:
                    meets = high >= batch["bar"].to_numpy()[at][:, None]
                    # The first pass goes home, the second everywhere else.
                    at_home = np.zeros(high.shape, dtype=bool)
                    at_home[np.arange(len(at)), homes] = True
                    meets = meets & (at_home if home_only else ~at_home)
                for k, row in enumerate(at):
                    cells[row] = [{"cell": int(c), "parts": int(level.parts[c])} for c in np.flatnonzero(meets[k] & filled)]
            yield batch.assign(cells=list(cells))

    return run


_ANCHOR = (
    "anchor long, id long, label long, vec array<int>, dims int, bar long, pos_ids array<long>, pos_scores array<long>"
)


def _nobody():
    return [F.lit(None).cast("array<long>").alias(c) for c in ("pos_ids", "pos_scores")]


def _pass(parts, anchors, levels, count, *, home_only=False, windows=False, blocks=1) -> DataFrame:
    """Send anchors to the parts of their cells and search there."""
    routed = anchors.mapInPandas(_route(levels, home_only, windows), f"{_ANCHOR}, cells array<struct<cell: int, parts: int>>")
    columns = ["dims", "cell", "part", "block", "asked", "anchor", "id", "label", "vec", "bar", "pos_ids", "pos_scores"]
    visits = (
        routed.withColumn("c", F.explode("cells"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)))
        .withColumn("cell", F.col("c.cell"))
        .withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
        .withColumn("asked", F.lit(True))
        .select(*columns)
    )
    # No NULL numbers: pandas would turn the column into floating point.
    zeros = [F.lit(0).cast("long").alias(c) for c in ("anchor", "bar")]
    there = parts.select("*", F.lit(False).alias("asked"), *zeros, *_nobody(), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(*columns)
    cell = ["dims", "cell", "part", "block"]
    # Candidates come first and grow the tree.
    met = there.union(visits).repartition(*cell).sortWithinPartitions(*cell, "asked")
    tops = {d: level.top for d, level in levels.items()}
    return met.mapInPandas(_descend(windows, tops, count), FOUND)


def hard_negatives(
    embeddings: DataFrame,
    *,
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    part_rows: int = PART_ROWS,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The hardest negatives of each anchor and positive; anchors have ids divisible by ``every``."""
    if positives >= WINNERS or negatives >= WINNERS:
        raise ValueError(f"at most {WINNERS - 1} positives and negatives")
    usable = usable_rows(embeddings)
    rows = materialise(candidates(usable), "candidates")
    levels = _levels(rows, cell_rows)
    parts = materialise(_with_cells(rows, levels, part_rows), "candidate-parts")
    # Anchors are few enough to be numbered by hash: two vectors may share an id.
    asking = usable.where((F.col("id") % every == 0) & (F.col("id") != _NO_ID)).distinct()
    anchors = asking.select(
        F.xxhash64("id", "label", "vec").alias("anchor"), "id", "label", "vec", "dims",
        F.lit(_FAR).cast("long").alias("bar"), *_nobody(),
    )
    anchors = materialise(anchors, "anchors")
    blocks = max(1, -(-anchors.count() // block_rows))
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")

    def first(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("_n", F.row_number().over(by_anchor)).where(F.col("_n") <= positives)
        return ranked.drop("_n")

    near = first(_pass(parts, anchors, levels, positives, home_only=True, blocks=blocks))
    near = materialise(near, "near-positives")
    full = near.groupBy("anchor").agg(F.min("score").alias("_bar"), F.count(F.lit(1)).alias("_n"))
    barred = anchors.join(full, "anchor", "left").withColumn(
        "bar", F.when(F.col("_n") == positives, F.col("_bar")).otherwise(F.col("bar"))
    )
    far = _pass(parts, barred.select(*anchors.columns), levels, positives, blocks=blocks)
    best = first(near.unionByName(far))
    pairs = best.groupBy("anchor").agg(F.collect_list(F.struct("score", "id")).alias("p"))
    pairs = pairs.select("anchor", F.col("p.id").alias("pos_ids"), F.col("p.score").alias("pos_scores"))
    looking = materialise(anchors.drop("pos_ids", "pos_scores").join(pairs, "anchor").select(*anchors.columns), "looking")
    found = _pass(parts, looking, levels, negatives, windows=True, blocks=blocks)
    of_pair = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(of_pair)).where(F.col("rank") <= negatives)

    def shown(c: str):
        return F.when(F.col(c) != _NO_ID, F.col(c))

    return ranked.join(looking.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id",
        shown("positive_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        shown("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
