"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. A sketch has one coordinate for each of 128 bins. In round i every shingle is hashed to a bin
   with value (i, hash) and each bin keeps its least value; after as many rounds as bins, round
   128 + j puts all shingles into bin j, so every coordinate is filled. Coordinates of two sets
   agree with probability equal to their Jaccard similarity, with the concentration of
   independent trials.
2. Texts with equal shingle sets are one class from here on. Four coordinates make a band, 32
   bands; classes that share a band's key meet in its bucket. A pair at similarity 0.75 shares
   no band with probability 5e-6, at 0.8 with 5e-8.
3. Bucket mates whose sketches agree in at least 55% of the coordinates (at similarity 0.75 an
   agreement below that is five standard deviations off) join one cluster. Only a spanning
   forest of each bucket leaves its task; large buckets are cut into blocks that meet in pairs.
4. Inside a cluster links are confirmed on whole shingle sets, again block by block and as
   spanning forests: first each block with the cluster's hub, then, only where that left more
   than one component, the rest against all blocks. No list of pairs is ever made.

Defined results: NULL and texts without words have no shingles and are linked with nothing.
Copies are linked. A row without doc_id is linked with nothing and has no component. Repeated rows
have the same result each. Texts that share a doc_id are documents of their own. Shingles are
compared by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import free_name, group_starts, whole_groups
from tracemill.llm.components import components
from tracemill.session import materialise

SHINGLE = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Coordinates that bucket mates must share to be verified.
AGREE = int(0.55 * BINS)
#: Members of one block of a cluster, and of a bucket, whose rows are far smaller. Every pair of
#: blocks of a bucket gives a forest, so fewer blocks give fewer links.
BLOCK, BUCKET_BLOCK = 128, 512

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, 2 * BINS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_WORD = _mix(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)
_ROW = _mix(np.arange(201, 201 + ROWS, dtype=_U)) | _U(1)
_BAND = _mix(np.arange(301, 301 + BANDS, dtype=_U))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, _U)
    for k in range(min(SHINGLE, len(words))):
        total += hashes[k : k + n] * _WORD[k]
    return np.unique(_mix(total))


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes."""
    out = np.full(BINS, np.iinfo(_U).max, _U)
    done = 0
    while done < 2 * BINS and (out == np.iinfo(_U).max).any():
        # About as many rounds as it takes to fill all bins, at least one.
        most = max(1, (7 * BINS) // len(items))
        rounds = np.arange(done, min(done + most, BINS if done < BINS else 2 * BINS))
        x = _mix(items[None, :] + _SEEDS[rounds][:, None])
        value = (x & _U(0xFFFFFFFF)) | (rounds.astype(_U) << _U(32))[:, None]
        if done < BINS:
            place = ((x >> _U(32)) * _U(BINS)) >> _U(32)
            np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        else:
            np.minimum.at(out, rounds - BINS, value.min(axis=1))
        done = int(rounds[-1]) + 1
    return out


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, sizes, bands, marks = [], [], [], []
        for text in batch["text"]:
            items = shingles(text)
            sizes.append(len(items))
            keys.append(xxhash.xxh3_128_digest(items.tobytes()))
            if len(items):
                s = sketch(items)
                rows = (s.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=_U)
                bands.append(_mix(rows + _BAND).view(np.int64))
                marks.append((_mix(s) >> _U(56)).astype(np.uint8).tobytes())
            else:
                bands.append(np.empty(0, np.int64))
                marks.append(b"")
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "text_key": batch["text_key"],
                "n_shingles": sizes,
                "set_key": keys,
                "bands": bands,
                "marks": marks,
            }
        )


def text_key(text: Column) -> Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def describe(docs: DataFrame) -> DataFrame:
    """Set size, set key, band keys and one byte of each coordinate, for every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    rows = narrow.mapInPandas(
        _describe, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, marks binary"
    )
    return materialise(rows, "sketches")


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest position that each position reaches, from a symmetric matrix of links."""
    n = len(linked)
    labels = np.arange(n)
    np.fill_diagonal(linked, True)
    while True:
        least = np.where(linked, labels[None, :], n).min(axis=1)
        if (least == labels).all():
            return labels
        labels = least[least]


def _forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to the first id that each id reaches; in sorted ids the smallest, on which many groups agree."""
    labels = _labels(linked)
    off = labels != np.arange(len(ids))
    return ids[off], ids[labels[off]]


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["key", "i", "j"]
    for frame in whole_groups(batches, keys):
        ids = frame["id"].to_numpy()
        marks = np.frombuffer(b"".join(frame["marks"]), np.uint8).reshape(len(ids), BINS)
        starts = group_starts(frame, keys)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        two = two[(marks[two] == marks[two + 1]).sum(axis=1) >= AGREE]
        left, right = [ids[two]], [ids[two + 1]]
        for a, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
            own = marks[a : a + n]
            same = np.stack([(own == row).sum(axis=1) >= AGREE for row in own])
            u, v = _forest(ids[a : a + n], same)
            left.append(u)
            right.append(v)
        yield pd.DataFrame({"u": np.concatenate(left), "v": np.concatenate(right)})


def _in_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """Every row once for each pair of blocks (i, j) of its group that its own block is in."""
    blocks = F.ceil(size / F.lit(BUCKET_BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")),
    )
    return rows.select("*", F.explode(pairs).alias("_p")).select("*", "_p.i", "_p.j").drop("_p")


def clusters(classes: DataFrame) -> DataFrame:
    """(node, root): classes that may be linked, by buckets and agreement of sketches."""
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialise(buckets, "buckets")
    shared = materialise(members.join(buckets, "key"), "members")
    blocks = _in_blocks(shared, F.col("size")).select("id", "key", "i", "j")
    rows = blocks.join(classes.select("id", "marks"), "id")
    links = (
        rows.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "id")
        .mapInPandas(_bucket_links, "u long, v long")
    )
    return components(links)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        items = [shingles(t).tobytes() for t in batch["text"]]
        yield pd.DataFrame({"cluster": batch["root"], "id": batch["id"], "items": items})


def _meets(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    width = 8192
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        slab = np.zeros((len(sets), width), np.float32)
        slab[owner[a:b], column[a:b] - start] = 1
        out += slab @ slab.T
    return out


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["cluster", "i", "j"]
    for frame in whole_groups(batches, keys):
        starts = group_starts(frame, keys)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(starts, starts[1:]):
            part = frame.iloc[a:b].drop_duplicates("id")
            name = part["part"].to_numpy()
            sets = [np.frombuffer(x, _U) for x in part["items"]]
            sizes = np.array([len(s) for s in sets], np.float64)
            both = _meets(sets)
            linked = 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)
            u, v = _forest(np.arange(len(part)), linked)
            new = name[u] != name[v]
            left.append(name[u[new]])
            right.append(name[v[new]])
        yield pd.DataFrame({"u": np.concatenate(left), "v": np.concatenate(right)})


def _confirm(rows: DataFrame) -> DataFrame:
    """Links between parts, where ``part`` names what is known to be connected."""
    return (
        rows.select("cluster", "i", "j", "id", "part", "items")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "id")
        .mapInPandas(_confirmed, "u long, v long")
    )


def confirmed(docs: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): classes joined by links that hold on whole sets, inside the given clusters.

    ``classes`` says where a class has its text: (id, doc_id, text_key).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    members = classes.join(roots.select(F.col("node").alias("id"), "root"), "id")
    # Members grow with the corpus: one plan at every size, never a broadcast that stops to fit.
    found = texts.join(members.hint("merge"), ["doc_id", "text_key"]).select("root", "id", "text")
    sets = materialise(
        found.mapInPandas(_sets, "cluster long, id long, items binary"), "sets"
    )
    ids = sets.select("cluster", "id").distinct()
    sizes = materialise(
        ids.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("hub")), "sizes"
    )
    rows = sets.join(sizes, "cluster")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(11)), blocks).cast("int")
    everywhere = F.sequence(F.lit(0), blocks - 1)
    first = rows.select(
        "cluster",
        "id",
        F.col("id").alias("part"),
        "items",
        F.explode(F.when(F.col("id") == F.col("hub"), everywhere).otherwise(F.array(own))).alias("i"),
        F.lit(-1).alias("j"),
    )
    known = materialise(components(_confirm(first)), "known")

    # Only clusters of several blocks can have links between blocks that are still unknown.
    large = sizes.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return known
    labelled = (
        ids.join(large.select("cluster", "size"), "cluster")
        .join(known.select(F.col("node").alias("id"), "root"), "id", "left")
        .select("cluster", "id", F.coalesce("root", "id").alias("part"))
    )
    parts = materialise(
        labelled.groupBy("cluster", "part").agg(F.count("*").alias("n")), "parts"
    )
    best = parts.groupBy("cluster").agg(
        F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")
    )
    best = materialise(
        best.where("parts > 1").select(
            "cluster",
            F.col("top.part").alias("top"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("r"),
            F.ceil(F.col("top.n") / BLOCK).cast("int").alias("b"),
        ),
        "largest",
    )
    # Blocks 0..r-1 hold the rest, r..r+b-1 the largest part; a rest block meets every block.
    spread = F.xxhash64("id", F.lit(13))
    rest = F.col("part") != F.col("top")
    mine = F.when(rest, F.pmod(spread, F.col("r"))).otherwise(F.col("r") + F.pmod(spread, F.col("b")))
    partners = F.sequence(F.lit(0), F.when(rest, F.col("r") + F.col("b") - 1).otherwise(F.col("r") - 1))
    placed = labelled.join(best, "cluster").select(
        "cluster", "id", "part", mine.cast("int").alias("own"), F.explode(partners).alias("k")
    )
    second = placed.select(
        "id", "part", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j")
    ).join(sets, "id")
    return components(known.union(_confirm(second)))


def _components(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the key of each text."""
    rows = describe(docs)
    sets = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # One row for each class, also where a row is repeated many times.
    described = F.min_by(F.struct("bands", "marks", "text_key"), F.struct("doc_id", "text_key")).alias("d")
    firsts = sets.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), described)
    # Numbers of their own, fixed by the write: two texts may share a doc_id.
    firsts = firsts.select(
        F.monotonically_increasing_id().alias("id"), "set_key", "doc_id", "d.text_key", "d.bands", "d.marks"
    )
    firsts = materialise(firsts, "classes")
    roots = confirmed(docs, firsts.select("id", "doc_id", "text_key"), clusters(firsts.select("id", "bands", "marks")))
    rooted = firsts.select("id", "set_key", "doc_id").join(
        roots.select(F.col("node").alias("id"), "root"), "id", "left"
    ).select("set_key", "doc_id", F.coalesce("root", "id").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    named = materialise(rooted.join(least, "root").select("set_key", "component_id"), "named")
    plain = rows.select("doc_id", "text_key", "n_shingles", "set_key")
    linked = plain.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).join(named, "set_key")
    alone = plain.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0))
    columns = ["doc_id", "text_key", "n_shingles", "component_id"]
    return (
        linked.select(*columns)
        .unionByName(alone.withColumn("component_id", F.col("doc_id")).select(*columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Set size and component of every document."""
    return _components(docs).drop("text_key")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``."""
    kept_id, kept_text = free_name(docs, "_kept_id"), free_name(docs, "_kept_text")
    kept = _components(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_text)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept[kept_id]) & (text_key(docs["text"]) == kept[kept_text])
    return docs.join(kept, same, "left_semi")
