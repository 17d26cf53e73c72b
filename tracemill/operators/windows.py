"""A user's tokenizer over windows of a text, so that one trajectory is spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import PLAIN, Template
from tracemill.operators.ordering import running
from tracemill.operators.tokens import Encoder, encode_texts, overlaps
from tracemill.session import materialise

WINDOW = 65_536
OVERLAP = 4_096
AGREE = 8
#: Characters of the windows that one task has side by side, or one window if that is longer.
RUN_CHARS = 1 << 20
_WIDEN = 4
_FAR = 1 << 62
_ENCODED = (
    "trajectory_id string, run bigint, window bigint, n bigint, before bigint, failed boolean, single boolean, "
    "input_ids array<int>, tok_starts array<bigint>, tok_ends array<bigint>, loss_mask array<int>"
)
_ARROW = (pa.int32(), pa.int64(), pa.int64(), pa.int32())


class Tokens(NamedTuple):
    """Tokens near borders: the number of the border, offsets in the whole text, ids."""

    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray


def _slices(parts: DataFrame, window: int, overlap: int, template: Template) -> DataFrame:
    """(trajectory_id, window, base, last, start, end, spoken, is_spoken, piece): what each window has of each part.

    Parts are cut into pieces of at most ``overlap`` characters first, so a long part is read once,
    not once for each window.
    """
    follows = F.col("char_start") > 0
    gap = F.when(follows, F.lit(len(template.separator))).otherwise(0)
    text = F.concat(F.when(follows, F.lit(template.separator)).otherwise(F.lit("")), F.col("part"))
    top = F.floor((F.col("n_chars") - 1) / window)
    pieces = parts.select(
        "trajectory_id",
        top.alias("_top"),
        (F.col("char_start") - gap).alias("_from"),
        F.when(F.col("role") == "assistant", F.col("char_start")).alias("_spoken"),
        F.posexplode(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{overlap}}}"), F.lit(0))).alias("_i", "_piece"),
    ).withColumn("_from", F.col("_from") + F.col("_i") * overlap)
    until = F.col("_from") + F.length("_piece")
    lowest = F.greatest(F.floor((F.col("_from") - overlap) / window), F.lit(0))
    highest = F.least(F.floor((until - 1 + overlap) / window), F.col("_top"))
    dealt = pieces.select("*", F.explode(F.sequence(lowest, highest)).alias("window"))
    low = F.greatest(F.col("window") * window - overlap, F.lit(0))
    high = (F.col("window") + 1) * window + overlap
    start = F.greatest(F.col("_from"), low)
    return dealt.select(
        "trajectory_id",
        "window",
        low.alias("base"),
        (F.col("window") == F.col("_top")).alias("last"),
        start.alias("start"),
        F.least(until, high).alias("end"),
        # The separator before an assistant part is not spoken.
        F.greatest(F.col("_spoken"), start).alias("spoken"),
        F.col("_spoken").isNotNull().alias("is_spoken"),
        F.substring("_piece", (start - F.col("_from") + 1).cast("int"), (F.least(until, high) - start).cast("int")).alias("piece"),
    ).where("end > start")


def text_windows(parts: DataFrame, window: int, overlap: int, template: Template = PLAIN) -> DataFrame:
    """(trajectory_id, window, base, last, text, spans) from a parts table.

    Window w holds the characters from w * window - overlap to (w + 1) * window + overlap, as far
    as the text goes; ``base`` is where it starts. ``spans`` are the ranges of assistant parts in
    it, counted from ``base``; ``last`` marks a trajectory's last window.
    """
    slices = _slices(parts, window, overlap, template)
    entry = F.struct("start", "end", "spoken", "is_spoken", "piece")
    grouped = (
        slices.repartition("trajectory_id", "window")
        .groupBy("trajectory_id", "window")
        .agg(F.first("base").alias("base"), F.first("last").alias("last"), F.sort_array(F.collect_list(entry)).alias("_s"))
    )
    spans = F.zip_with(
        F.filter("_s", lambda s: s["is_spoken"] & (s["spoken"] < s["end"])),
        F.array_repeat("base", F.size("_s")),
        lambda s, base: F.struct((s["spoken"] - base).alias("start"), (s["end"] - base).alias("end")),
    )
    return grouped.select(
        "trajectory_id",
        "window",
        "base",
        "last",
        F.array_join(F.transform("_s", lambda s: s["piece"]), "").alias("text"),
        F.filter(spans, lambda s: s["start"].isNotNull()).alias("spans"),
    )


def _cuts(border: np.ndarray, sides: Sequence[Tokens], agree: int) -> np.ndarray:
    """Where the window before each border ends and the one behind it begins; -1 if they never agree.

    ``sides`` are the tokens near the borders as the window before and the one behind have them, with the
    number of their border.
    """
    side = np.repeat([0, 1], [len(t.at) for t in sides])
    at, start, end, ids = (np.concatenate(x) for x in zip(*((t.at, t.start, t.end, t.ids) for t in sides)))
    order = np.lexsort((ids, end, start, at))
    side, at, start, end, ids = (x[order] for x in (side, at, start, end, ids))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (ids[1:] != ids[:-1])
    token = np.cumsum(new) - 1
    at, start = at[new], start[new]
    both = (np.bincount(token[side == 0], minlength=len(at)) > 0) & (np.bincount(token[side == 1], minlength=len(at)) > 0)
    # The stretch of agreement around the border, between the last odd token before it and the first behind.
    behind = start >= border[at]
    low, high = np.full(len(border), -1), np.full(len(border), _FAR)
    np.maximum.at(low, at[~both & ~behind], start[~both & ~behind])
    np.minimum.at(high, at[~both & behind], start[~both & behind])
    agreed = both & (start > low[at]) & (start < high[at])
    first, top = np.full(len(border), _FAR), np.full(len(border), -1)
    np.minimum.at(first, at[agreed & behind], start[agreed & behind])
    np.maximum.at(top, at[agreed], start[agreed])
    enough = np.bincount(at[agreed], minlength=len(border)) >= agree
    return np.where(enough, np.where(first < _FAR, first, top), -1)


class _Cutter:
    """Windows of whole runs, encoded and cut; ``window``, ``overlap`` and ``agree`` as in ``windowed_tokens``."""

    def __init__(self, encoder: Encoder, window: int, overlap: int, agree: int, per_run: int):
        self.encoder, self.window, self.overlap, self.agree, self.per_run = encoder, window, overlap, agree, per_run

    def rows(self, slices: pa.Table) -> Iterator[pa.RecordBatch]:
        """The windows of runs whose slices are complete and in order; up to ``RUN_CHARS`` at once, or one run."""
        run, name = slices["run"].to_numpy(), slices["trajectory_id"].to_pylist()
        new_run = np.ones(len(run), bool)
        new_run[1:] = (run[1:] != run[:-1]) | np.array([a != b for a, b in zip(name[1:], name)], bool)
        edges = np.append(np.flatnonzero(new_run), len(run))
        chars = np.append(0, np.cumsum(pc.utf8_length(slices["piece"]).to_numpy()))[edges]
        at = 0
        while at < len(edges) - 1:
            stop = max(at + 1, int(np.searchsorted(chars, chars[at] + RUN_CHARS, "right")) - 1)
            a, b = int(edges[at]), int(edges[stop])
            yield self._block(slices.slice(a, b - a), name[a:b], new_run[a:b])
            at = stop

    def _block(self, slices: pa.Table, name: list[str], new_run: np.ndarray) -> pa.RecordBatch:
        run, window, start, spoken, last = (slices[c].to_numpy() for c in ("run", "window", "start", "spoken", "last"))
        piece = slices["piece"].to_pylist()
        new = new_run.copy()
        new[1:] |= window[1:] != window[:-1]
        edges = [*np.flatnonzero(new).tolist(), len(run)]
        texts = ["".join(piece[a:b]) for a, b in zip(edges, edges[1:])]
        first = np.array(edges[:-1])
        group = np.cumsum(new_run)[first] - 1
        window, run, last, of = window[first], run[first], last[first], np.cumsum(new) - 1
        base = np.maximum(window * self.window - self.overlap, 0)
        # Spans of assistant parts, counted from where their window starts.
        end = start + np.array([len(p) for p in piece], np.int64)
        said = spoken < end
        said_in, opened, closed = of[said], spoken[said] - base[of[said]], end[said] - base[of[said]]

        counts, ids, starts, ends = encode_texts(self.encoder, texts)
        at = np.repeat(np.arange(len(texts)), counts)
        mask = overlaps(at, starts, ends, said_in, opened, closed)
        real = ends > 0
        starts, ends = (np.where(real, x + base[at], 0) for x in (starts, ends))
        wide = ends > starts

        border = np.flatnonzero((group[1:] == group[:-1]) & (window[1:] == window[:-1] + 1)) + 1
        number = np.full(len(texts) + 1, -1)
        number[border] = np.arange(len(border))

        def near(of_token: np.ndarray) -> Tokens:
            line = number[of_token]
            edge = window[border][line] * self.window if len(border) else line
            chosen = wide & (line >= 0) & (starts >= edge - self.overlap) & (starts < edge + self.overlap)
            return Tokens(line[chosen], starts[chosen], ends[chosen], ids[chosen])

        cut = _cuts(window[border] * self.window, [near(at + 1), near(at)], self.agree)
        begin, until = np.full(len(texts), -1), np.full(len(texts), _FAR)
        begin[border], until[border - 1] = cut, cut
        failed = np.bincount(group[border[cut < 0]], minlength=group[-1] + 1)[group] > 0

        place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        # Special tokens are those of the first window's start and the last window's end.
        special = np.where(place * 2 < counts[at], window[at] == 0, last[at])
        kept = np.where(wide, (starts >= begin[at]) & (starts < until[at]), special)
        own = (window // self.per_run == run) & ~failed
        kept &= own[at]
        n = np.bincount(at[kept], minlength=len(texts))
        before = np.cumsum(n) - n
        before -= np.maximum.accumulate(np.where(np.diff(group, prepend=-1) > 0, before, 0))
        whole = np.bincount(group[last & (run == 0) & (window < self.per_run)], minlength=group[-1] + 1)[group] > 0
        # Of a run that failed one row is left.
        own |= failed & (np.diff(group, prepend=-1) > 0)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n[own]))).astype(np.int32))
        lists = (ids, starts, ends, mask)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name[k] for k in first[own].tolist()], pa.string()),
                *(pa.array(x[own]) for x in (run, window, n, before, failed, whole)),
                *(pa.ListArray.from_arrays(offsets, pa.array(x[kept], kind)) for x, kind in zip(lists, _ARROW)),
            ],
            names=[f.split(" ")[0] for f in _ENCODED.split(", ")],
        )

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, runs = batch["trajectory_id"], batch["run"]
            # Where the batch's last run begins.
            open_at = batch.num_rows
            key = (names[-1].as_py(), runs[-1].as_py())
            while open_at and (names[open_at - 1].as_py(), runs[open_at - 1].as_py()) == key:
                open_at -= 1
            if held and (open_at or (held[-1]["trajectory_id"][-1].as_py(), held[-1]["run"][-1].as_py()) != key):
                yield from self.rows(pa.Table.from_batches([*held, batch.slice(0, open_at)]))
                held = []
            elif open_at:
                yield from self.rows(pa.Table.from_batches([batch.slice(0, open_at)]))
            held.append(batch.slice(open_at))
        if held:
            yield from self.rows(pa.Table.from_batches(held))


def windowed_tokens(
    parts: DataFrame,
    make_encoder: Callable[[], Encoder],
    *,
    window: int = WINDOW,
    overlap: int = OVERLAP,
    agree: int = AGREE,
    template: Template = PLAIN,
) -> DataFrame:
    """Tokens of a user's tokenizer, one row per window of a text.

    (trajectory_id, window, first_pos, input_ids, tok_starts, tok_ends, loss_mask), offsets and
    positions counted over the whole text. No row holds more than ``window + 2 * overlap``
    characters or their tokens. Neighbouring windows share 2 * ``overlap`` characters; they are cut
    at a token near their border inside a stretch of ``agree`` tokens or more (same offsets, same
    ids) on which both agree. Trajectories with a border without such a stretch, say inside a token
    as long as the overlap, are cut again into windows and overlaps four times as long, until
    a window holds the whole text.

    The result is that of the whole text for tokenizers whose tokens depend on the text around
    them only, such as all that split words first; a window must hide no context of more than
    ``overlap`` characters. Special tokens (offset (0, 0)) are kept at the start of the first and
    the end of the last window. Trajectories without parts have no row. The parts table is read
    once for each width, so pass a stored one.
    """
    if overlap < 1 or window < 2 * overlap:
        raise ValueError("a window must be at least twice as long as the overlap, which must be positive")
    done: DataFrame | None = None
    left = parts
    while True:
        encoded = materialise(_encoded(left, make_encoder, window, overlap, agree, template), "windows")
        failed = encoded.where("failed").select("trajectory_id", "run")
        again = not failed.isEmpty()
        kept = encoded.where("not failed")
        if again:
            # A text of one run that failed has no other rows.
            failed = failed.select("trajectory_id").distinct()
            kept = kept.where("single").unionByName(kept.where("not single").join(failed, "trajectory_id", "left_anti"))
        done = kept if done is None else done.unionByName(kept)
        if not again:
            break
        left = left.join(failed, "trajectory_id", "left_semi")
        window, overlap = window * _WIDEN, overlap * _WIDEN
    # Runs behind the first of their text begin where those before end.
    sizes = done.where("not single").groupBy("trajectory_id", "run").agg(F.sum("n").alias("_n"))
    bases = running(sizes, ["trajectory_id"], "run", before={"_base": ("sum", F.col("_n"))}).drop("_n")
    columns = ["input_ids", "tok_starts", "tok_ends", "loss_mask"]
    placed = done.where("not single").join(bases, ["trajectory_id", "run"])
    placed = placed.select("trajectory_id", "window", (F.col("_base") + F.col("before")).alias("first_pos"), *columns)
    alone = done.where("single").select("trajectory_id", "window", F.col("before").alias("first_pos"), *columns)
    return alone.unionByName(placed)


def _encoded(
    parts: DataFrame, make_encoder: Callable[[], Encoder], window: int, overlap: int, agree: int, template: Template
) -> DataFrame:
    """Windows with their tokens between their cuts, dealt in runs of neighbouring windows.

    A run has the window before its first and the one behind its last too, so that it knows all its cuts,
    and meets in one task. ``before`` counts its tokens before a window. ``failed`` marks the only row of a
    run with a border without a cut, ``single`` the windows of texts of one run.
    """
    per_run = max(1, RUN_CHARS // window)
    number = F.col("window")
    own = F.floor(number / per_run)
    runs = F.array(
        own,
        F.when((number % per_run == 0) & (number > 0), own - 1),
        F.when((number % per_run == per_run - 1) & ~F.col("last"), own + 1),
    )
    slices = _slices(parts, window, overlap, template).select(
        "trajectory_id",
        F.explode(F.array_compact(runs)).alias("run"),
        "window",
        "last",
        "start",
        F.when(F.col("is_spoken"), F.col("spoken")).otherwise(_FAR).alias("spoken"),
        "piece",
    )
    ordered = slices.repartition("trajectory_id", "run").sortWithinPartitions("trajectory_id", "run", "window", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _Cutter(make_encoder(), window, overlap, agree, per_run).run(batches)

    return ordered.mapInArrow(run, _ENCODED)
