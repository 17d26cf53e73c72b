"""Repeated passages: recurring windows of words, found by automata and removed.

A window is ``WINDOW`` consecutive words of one text. It recurs if the same words also start
anywhere else, in the same text or another one.

1. Equal word sequences become one text with a count. Texts are stored bucketed by the digest of
   their words and never shuffled again; all windows of a text that occurs twice recur.
2. Every window is tied to one phrase of ``PHRASE`` words, the one whose hash is smallest, so equal
   windows have equal phrases wherever they stand. Consecutive windows with one phrase are a run.
   Runs are counted by phrase; a phrase with one run has no recurring window.
3. The words of the other runs (segments, 62 words at most) are reduced to distinct ones, and
   their windows are counted by 128-bit digests. Those counted twice are the confirmed patterns.
4. Patterns are compiled into Aho-Corasick automata, sharded by phrase, and all distinct segments
   of a shard go through its automaton, which locates every confirmed window. There are as many
   shards as keep each small; a phrase with very many patterns or segments is dealt over several
   parts and salts.
5. The windows found go back to the texts, which lose the words they cover.

Work and shuffles are linear in the text: a window takes part in one run, a run in one segment, and
a segment meets the automaton of its own phrase only. Nothing is broadcast or collected.

Defined results: NULL counts as empty. Repeated rows count as two occurrences each of their windows.
Texts with fewer words than a window stay. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SPACE
from tracemill.session import materialise
from tracemill.sources.clustered import write_clustered

WINDOW = 35
PHRASE = 8
#: Patterns of one automaton and segments that it sees, on average over the shards; a phrase with more
#: than ``LARGE`` times as many is dealt over parts and salts. Small automata are faster, as the
#: library searches the first words of its patterns one by one.
PATTERNS = 512
SEGMENTS = 2048
LARGE = 16

_CHUNK_BYTES = 4_000_000
_POSITION_BITS = 31
_RANDOM = np.random.default_rng(20_011)
_BYTE_WEIGHTS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_WORD_WEIGHTS = _RANDOM.integers(1, 1 << 63, PHRASE, dtype=np.uint64) | np.uint64(1)


def plain_words(text: Column) -> Column:
    """The words of a text joined by single blanks; empty for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    # Single blanks, nearly all of the white space, are not matched.
    return F.regexp_replace(trimmed, r"\x20?[\x09-\x0D]" + SPACE + r"*|\x20" + SPACE + "+", " ")


def digest_of(words: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(words, 256), 1, 32))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, words, n_words, n_rows) of every word sequence, bucketed by key."""
    words = docs.select(plain_words(F.col("text")).alias("words"))
    # Copies are dropped by the reading tasks already.
    texts = words.select(digest_of(F.col("words")).alias("key"), "words").groupBy("key").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n_rows")
    )
    blanks = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("words") == "", 0).otherwise(blanks + 1).cast("long")
    return write_clustered(texts.select("key", "words", n_words.alias("n_words"), "n_rows"), ["key"], name="texts")


# ---- runs: windows by phrase ------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _phrase_hashes(texts: list[bytes], phrase: int) -> np.ndarray:
    """Hash of the phrase that starts at each word of the texts put one after another."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(joined == 32)
    starts = np.append(0, ends[:-1] + 1)
    inside = np.arange(len(joined)) - np.repeat(starts, ends - starts + 1)
    weighed = _BYTE_WEIGHTS[inside & 63] * (joined.astype(np.uint64) + np.uint64(1))
    words = _mix(np.add.reduceat(weighed, starts))
    hashes = np.zeros(len(words) - phrase + 1, dtype=np.uint64)
    for k in range(phrase):
        hashes += words[k : k + len(hashes)] * _WORD_WEIGHTS[k]
    return _mix(hashes)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done, least = 1, values
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return least


def runs_of(texts: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, ...]:
    """(text number, phrase hash, first window, number of windows) of every run.

    Texts are words joined by single blanks, with ``window`` words at least.
    """
    hashes = _phrase_hashes(texts, phrase)
    sizes = np.array([t.count(b" ") + 1 for t in texts])
    firsts = np.append(0, np.cumsum(sizes)[:-1])
    # The smallest hash of a window, the leftmost of equal ones, with its place in the low bits.
    places = np.arange(len(hashes), dtype=np.uint64)
    keyed = ((hashes >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS)) | places
    chosen = _sliding_min(keyed, window - phrase + 1) & np.uint64((1 << _POSITION_BITS) - 1)
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    local = np.arange(counts.sum()) - np.repeat(np.append(0, np.cumsum(counts)[:-1]), counts)
    place = chosen[firsts[owner] + local].astype(np.int64)
    new = np.append(True, place[1:] != place[:-1])
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(place)))
    return owner[at], hashes[place[at]].view(np.int64), local[at], lengths


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > _CHUNK_BYTES:
            yield slice(first, k)
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def _runs(window: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["key"].to_numpy(), [t.encode() for t in batch["words"]]
            for part in _chunks(texts):
                owner, phrases, start, n = runs_of(texts[part], window, phrase)
                yield pd.DataFrame({"phrase": phrases, "key": keys[part][owner], "start": start, "n": n})

    return run


def recurring_runs(texts: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(key, runs) of the texts with runs whose phrase has another run."""
    long_enough = texts.where(F.col("n_words") >= window).select("key", "words")
    runs = long_enough.mapInPandas(_runs(window, phrase), "phrase long, key binary, start int, n int")
    runs = materialise(runs, "runs")
    twice = runs.groupBy("phrase").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("phrase")
    # Written, so that the join has two plain exchanges and a hot phrase can be split.
    kept = runs.join(materialise(twice, "phrases"), "phrase", "left_semi")
    # One list for each text, no longer than the text.
    lists = kept.groupBy("key").agg(F.collect_list(F.struct("start", "n", "phrase")).alias("runs"))
    return lists.select("key", *(F.col(f"runs.{c}").alias(c) for c in ("start", "n", "phrase")))


# ---- segments and patterns --------------------------------------------------------------


def _bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32), len(text))
    return np.append(0, ends[:-1] + 1), ends


def _short_digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _segments(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: list[bytes] = []
            for words, start, n in zip(batch["words"], batch["start"], batch["n"]):
                text = words.encode()
                starts, ends = _bounds(text)
                first, last = starts[start].tolist(), ends[start + n + (window - 2)].tolist()
                parts += [text[a:b] for a, b in zip(first, last)]
            counts = [len(x) for x in batch["start"]]
            yield pd.DataFrame(
                {
                    "key": np.repeat(batch["key"].to_numpy(), counts),
                    "start": np.concatenate(batch["start"].to_list()) if parts else [],
                    "phrase": np.concatenate(batch["phrase"].to_list()) if parts else [],
                    "seg": [_short_digest(p) for p in parts],
                    "segment": [p.decode() for p in parts],
                }
            )

    return run


#: Bits of a place code that hold the window of a segment; the others are the segment's own.
_AT_BITS = 6


def _place_code(seg: bytes) -> int:
    return int.from_bytes(seg[:8], "big", signed=True) >> _AT_BITS << _AT_BITS


def _windows(window: int):
    """Digests and places of the windows of distinct segments, with the count of the segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, codes, digest = [], [], []
            for seg, segment in zip(batch["seg"], batch["segment"]):
                text = segment.encode()
                starts, ends = _bounds(text)
                n = len(starts) - window + 1
                code = _place_code(seg)
                sizes.append(n)
                codes += range(code, code + n)
                digest += [_short_digest(text[a:b]) for a, b in zip(starts[:n].tolist(), ends[window - 1 :].tolist())]
            repeated = {c: np.repeat(batch[c].to_numpy(), sizes) for c in ("phrase", "c")}
            yield pd.DataFrame({**repeated, "win": digest, "code": codes})

    return run


def confirmed_patterns(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, code): one place for each recurring window.

    A place code is a digest of the segment and the window's number in it. It names the segment
    among those of its phrase.
    """
    found = distinct.select("phrase", "seg", "segment", "c").mapInPandas(
        _windows(window), "phrase long, c long, win binary, code long"
    )
    # Counted map-side first: a window that is everywhere sends one row for each task.
    counted = found.groupBy("phrase", "win").agg(F.sum("c").alias("c"), F.min("code").alias("code"))
    return counted.where("c > 1").select("phrase", "code")


# ---- automata ---------------------------------------------------------------------------


def _masks(segments: list[tuple[bytes, str, bool]], codes: list[int], window: int) -> Iterator[tuple[bytes, int]]:
    """Windows of the segments to scan that are patterns, found by the automaton of the patterns."""
    places: dict[int, list[int]] = {}
    for code in codes:
        places.setdefault(code >> _AT_BITS << _AT_BITS, []).append(code & ((1 << _AT_BITS) - 1))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    # Words that are in no pattern are 0 and match nothing.
    ids: dict[str, int] = {}
    for seg, segment, _ in segments:
        if found := places.get(_place_code(seg)):
            words = tuple([ids.setdefault(w, len(ids) + 1) for w in segment.split(" ")])
            for at in found:
                automaton.add_word(words[at : at + window])
    if not len(automaton):
        return
    automaton.make_automaton()
    for seg, segment, scan in segments:
        if scan:
            mask = 0
            for end, _ in automaton.iter(tuple(map(ids.get, segment.split(" "), repeat(0)))):
                mask |= 1 << (end - window + 1)
            if mask:
                yield seg, mask


def _locate(window: int):
    columns = ["shard", "part", "salt", "code", "seg", "segment", "scan"]

    def frame(found: list[tuple[bytes, int]]) -> pd.DataFrame:
        return pd.DataFrame({"seg": [f[0] for f in found], "mask": np.array([f[1] for f in found], dtype=np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, segments, codes = None, [], []
        for batch in batches:
            found: list[tuple[bytes, int]] = []
            for shard, part, salt, code, seg, segment, scan in zip(*(batch[c] for c in columns)):
                if (shard, part, salt) != cell:
                    found += _masks(segments, codes, window)
                    cell, segments, codes = (shard, part, salt), [], []
                if seg is None:
                    codes.append(code)
                else:
                    segments.append((seg, segment, scan))
            yield frame(found)
        yield frame(list(_masks(segments, codes, window)))

    return run


def locate(
    patterns: DataFrame,
    distinct: DataFrame,
    *,
    window: int = WINDOW,
    per_automaton: int = PATTERNS,
    per_salt: int = SEGMENTS,
) -> DataFrame:
    """(seg, mask): the windows of every distinct segment that are patterns, as bits."""
    n_patterns, n_segments = patterns.count(), distinct.count()
    shards = max(1, -(-n_patterns // per_automaton), -(-n_segments // per_salt))
    sizes = (
        patterns.groupBy("phrase").agg(F.count(F.lit(1)).alias("p"), F.lit(0).alias("s"))
        .union(distinct.groupBy("phrase").agg(F.lit(0), F.count(F.lit(1))))
        .groupBy("phrase")
        .agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
        .where((F.col("p") > LARGE * per_automaton) | (F.col("s") > LARGE * per_salt))
    )

    def pieces(rows: str, size: int):
        return F.ceil(F.greatest(F.col(rows), F.lit(1)) / size).cast("int")

    # Hardly ever any rows; written, so that its size is known when the joins are planned.
    large = materialise(
        sizes.select("phrase", pieces("p", per_automaton).alias("parts"), pieces("s", per_salt).alias("salts")),
        "large-phrases",
    )

    def cell(part, salt, scan):
        return F.struct(part.cast("int").alias("part"), salt.cast("int").alias("salt"), scan.alias("scan"))

    def dealt(rows: DataFrame, code, streamed: bool) -> DataFrame:
        """Patterns, and the segments they stand in, go to their part in each salt; segments to be
        scanned go to their salt in each part. Phrases that are not large have one of each.
        """
        name = F.shiftright(code, _AT_BITS)
        part = F.pmod(F.xxhash64(name), F.col("parts"))
        cells = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: cell(part, k, F.lit(False)))
        if streamed:
            salt = F.pmod(F.xxhash64(name, F.lit(1)), F.col("salts"))
            own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: cell(k, salt, F.lit(True)))
            cells = F.concat(cells, own)
        whole = F.array(cell(F.lit(0), F.lit(0), F.lit(True)))
        shard = F.pmod(F.xxhash64("phrase"), F.lit(shards)).alias("shard")
        spread = rows.join(large, "phrase", "left").select(
            shard, "code", "seg", "segment", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(cells)).alias("c")
        )
        return spread.select("shard", "c.part", "c.salt", "code", "seg", "segment", "c.scan")

    nothing = [F.lit(None).cast("binary").alias("seg"), F.lit(None).cast("string").alias("segment")]
    rules = dealt(patterns.select("phrase", "code", *nothing), F.col("code"), False)
    # The first 8 bytes of the digest as a number, as in a place code.
    head = F.conv(F.hex(F.substring("seg", 1, 8)), 16, -10).cast("long")
    stream = dealt(distinct.select("phrase", head.alias("code"), "seg", "segment"), F.col("code"), True)
    ordered = rules.union(stream).repartition("shard", "part", "salt").sortWithinPartitions("shard", "part", "salt")
    masks = ordered.mapInPandas(_locate(window), "seg binary, mask long")
    # Parts of one phrase find different windows of a segment.
    return masks.groupBy("seg").agg(F.bit_or("mask").alias("mask"))


# ---- removal ----------------------------------------------------------------------------


def _removal(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.arange(63, dtype=np.int64)
        for batch in batches:
            removed, kept, spans = [], [], []
            for words, n_words, n_rows, found in zip(batch["words"], batch["n_words"], batch["n_rows"], batch["found"]):
                if n_rows > 1 and n_words >= window:
                    removed.append(n_words)
                    kept.append("")
                    spans.append([{"start": 0, "stop": n_words}])
                    continue
                if found is None:
                    removed.append(0)
                    kept.append(words)
                    spans.append([])
                    continue
                depth = np.zeros(n_words + 1, dtype=np.int64)
                for f in found:
                    at = f["start"] + np.flatnonzero((f["mask"] >> bits) & 1)
                    depth[at] += 1
                    depth[at + window] -= 1
                covered = np.cumsum(depth[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                removed.append(int(covered.sum()))
                kept.append(" ".join([w for w, gone in zip(words.split(" "), covered) if not gone]))
            yield batch[["key", "n_words"]].assign(n_removed=removed, spans=spans, kept=kept)

    return run


def without_passages(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    phrase: int = PHRASE,
    per_automaton: int = PATTERNS,
    per_salt: int = SEGMENTS,
) -> DataFrame:
    """Every distinct word sequence without its recurring passages.

    (key, n_words, n_removed, spans of removed words, kept words). ``window - phrase + 1`` windows
    at most share a phrase, which must fit into 63 bits.
    """
    if window - phrase + 1 > 63:
        raise ValueError("at most 63 windows may share a phrase")
    texts = distinct_texts(docs)
    runs = recurring_runs(texts, window, phrase)
    segments = texts.select("key", "words").join(runs, "key").select("key", "words", "start", "n", "phrase").mapInPandas(
        _segments(window), "key binary, start int, phrase long, seg binary, segment string"
    )
    segments = materialise(segments, "segments")
    distinct = segments.groupBy("phrase", "seg", "segment").agg(F.count(F.lit(1)).alias("c"))
    distinct = materialise(distinct, "distinct-segments")
    patterns = materialise(confirmed_patterns(distinct, window), "patterns")
    masks = locate(patterns, distinct, window=window, per_automaton=per_automaton, per_salt=per_salt)
    # A segment that stands in very many texts is a hot key here: two plain exchanges again.
    masks = materialise(masks, "masks")
    found = (
        segments.select("key", "start", "seg")
        .join(masks, "seg")
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    )
    return texts.join(found, "key", "left").select("key", "words", "n_words", "n_rows", "found").mapInPandas(
        _removal(window),
        "key binary, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string",
    )


def remove_passages(docs: DataFrame, columns: list[Column] | None = None, **settings) -> DataFrame:
    """``columns`` of ``without_passages`` for every document, by default all but the key.

    Choose narrow columns where documents have many copies: each gets its own row.
    """
    chosen = columns or [F.col(c) for c in ("n_words", "n_removed", "spans", "kept")]
    # Written, so that the join has two plain exchanges and a text with very many copies is split.
    results = materialise(without_passages(docs, **settings).select("key", *chosen), "without-passages")
    keyed = docs.select("doc_id", digest_of(plain_words(F.col("text"))).alias("key"))
    return keyed.join(results, "key").drop("key")
