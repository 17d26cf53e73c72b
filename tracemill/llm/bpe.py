"""Byte-level BPE as a streaming transducer with bounded lookahead.

Encoding. A piece (what the pretokenizer's pattern cuts out) is merged by rank, leftmost first.
Bytes that follow can undo a token only through a chain of merges: a merge at one boundary takes
the right half away from the next merge to the left, whose rank must be higher, and so on. The
longest such chain, measured in bytes, is the merge list's *sufficient lookahead*; it is worked
out once, from the merges. Short pieces are merged in one go and remembered. Of a long piece only
a window is held: tokens that end further from the window's end than the lookahead are final and
leave it.

The text itself is cut into blocks the same way: pieces that end well before a block's end do not
depend on what follows. So whatever the length of a text, memory holds one block, one window and
a cache of bounded size.

Decoding. Token ids are turned into bytes and then to text by an incremental UTF-8 machine that
holds at most three bytes of an unfinished character; broken bytes become U+FFFD.

Ids equal those of the public ``tokenizers`` file; its special tokens are recognised in the text.
Defined results: NULL and empty texts have no ids and decode to the empty text. Repeated rows have
the same result each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block, and bytes of a window besides the lookahead.
BLOCK_CHARS = 1 << 16
WINDOW_BYTES = 1 << 12
#: Longer pieces go through the window; shorter ones are remembered, twice so many at most.
SHORT_BYTES = 256
CACHE_PIECES = 500_000


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes that decide whether a token boundary stays: the longest chain of merges.

    ``merges`` are (left, right, merged) in order of rank; ``size`` are the tokens' lengths. A
    merge (L, R) can be changed by an earlier one whose left half begins R, at any depth.
    """
    begins = {merged: left for left, _, merged in merges}
    longest: dict[int, int] = {}
    for left, right, _ in merges:
        best, token = 0, right
        while token is not None:
            best = max(best, longest.get(token, 0))
            token = begins.get(token)
        longest[left] = max(longest.get(left, 0), best + size[left])
    # A window also holds the token at its end, of which any part may be missing.
    return max(longest.values(), default=0) + max(size.values(), default=1)


class Transducer:
    """Encoder and decoder of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self._first = [vocab[bytes([b])] for b in range(256)]
        self._bytes = {v: k for k, v in vocab.items()}
        self._bytes |= {v: k.encode() for k, v in self.special.items()}
        merges = []
        for pair in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        self._shift = max(self._bytes).bit_length()
        self._rank = {a << self._shift | b: rank for rank, (a, b, _) in enumerate(merges)}
        self._new = [new for _, _, new in merges]
        self.lookahead = sufficient_lookahead(merges, {k: len(v) for k, v in self._bytes.items()})
        self._pattern = regex.compile(pattern)
        self._cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._cache: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._most = cache
        # Ids are handled as decimal texts: a block's ids are then one join.
        self._text_bytes = {str(k): v for k, v in self._bytes.items()}

    def merge_ranks(self) -> dict[bytes, int]:
        """Tokens and their ids; the ids must rise with the merges' ranks."""
        assert all(a < b for a, b in zip(self._new, self._new[1:]))
        return {k: v for v, k in self._bytes.items() if v not in self.special.values()}

    def merge_short(self, data: bytes) -> list[int]:
        """Ids of a short piece: the best pair, leftmost first, is merged until none is left."""
        first, rank, new, shift = self._first, self._rank.get, self._new, self._shift
        ids = [first[b] for b in data]
        none = len(new)
        ranks = [rank(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            merged = new[best]
            ids[k : k + 2] = [merged]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] << shift | merged, none)
            if k < len(ranks):
                ranks[k] = rank(merged << shift | ids[k + 1], none)
        return ids

    def merge_window(self, data: bytes) -> list[int]:
        """The same for long data, by a heap over the pairs."""
        ids = [self._first[b] for b in data]
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        ranks, new, shift = self._rank, self._new, self._shift
        heap = []

        def offer(k: int) -> None:
            n = after[k]
            if n >= 0 and (rank := ranks.get(ids[k] << shift | ids[n])) is not None:
                heapq.heappush(heap, (rank, k, ids[k], ids[n]))

        for k in range(len(ids) - 1):
            offer(k)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            n = after[k]
            if ids[k] != left or n < 0 or ids[n] != right:
                continue
            ids[k], ids[n] = new[rank], -1
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [x for x in ids if x >= 0]

    def stream_piece(self, parts: Iterator[bytes]) -> Iterator[list[int]]:
        """Ids of one piece that comes in parts; holds a window and the lookahead."""
        held = b""
        for part in parts:
            held += part
            if len(held) < WINDOW_BYTES + self.lookahead:
                continue
            ids, end, final = self.merge_window(held), 0, len(held) - self.lookahead
            out = []
            for x in ids:
                if end + len(self._bytes[x]) > final:
                    break
                end += len(self._bytes[x])
                out.append(x)
            held = held[end:]
            yield out
        yield self.merge_window(held)

    def _miss(self, piece: str) -> str:
        if found := self._older.get(piece):
            return self._remember(piece, found)
        data = piece.encode("utf-8", "surrogatepass")
        ids = self.merge_short(data) if len(data) <= 48 else self.merge_window(data)
        found = ",".join(map(str, ids))
        return self._remember(piece, found) if len(data) <= SHORT_BYTES else found

    def _remember(self, piece: str, found: str) -> str:
        """Two generations: when the younger is full it becomes the older one."""
        if len(self._cache) >= self._most:
            self._cache, self._older = {}, self._cache
        self._cache[piece] = found
        return found

    def _pieces(self, pieces: list[str]) -> str:
        known, miss = self._cache.get, self._miss
        return ",".join([known(p) or miss(p) for p in pieces])

    def _stretch(self, text: str) -> Iterator[str]:
        """Ids of a stretch without special tokens, block by block, as decimal text."""
        start = 0
        while start < len(text):
            block = text[start : start + BLOCK_CHARS]
            pieces = self._pattern.findall(block)
            if start + len(block) < len(text):
                # Pieces near the block's end may go on, or look beyond it.
                end = len(block)
                while pieces and end > len(block) - 4:
                    end -= len(pieces.pop())
                if pieces and len(pieces) > 1:
                    yield self._pieces(pieces)
                    start += end
                    continue
                stop = self._pattern.match(text, start).end()
                parts = (
                    text[k : min(k + 1024, stop)].encode("utf-8", "surrogatepass")
                    for k in range(start, stop, 1024)
                )
                for ids in self.stream_piece(parts):
                    if ids:
                        yield ",".join(map(str, ids))
                start = stop
            else:
                yield self._pieces(pieces)
                start += len(block)

    def encode_blocks(self, text: str) -> Iterator[str]:
        """Ids of a text, block by block, as decimal numbers between commas."""
        start = 0
        for m in self._cut.finditer(text) if self._cut else ():
            if m.start() > start:
                yield from self._stretch(text[start : m.start()])
            yield str(self.special[m[0]])
            start = m.end()
        if start < len(text):
            yield from self._stretch(text[start:] if start else text)

    def encode(self, text: str) -> list[int]:
        return [int(x) for block in self.encode_blocks(text) for x in block.split(",")]

    def decode_blocks(self, blocks: Iterator[str]) -> Iterator[str]:
        """Text of blocks of ids."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        known = self._text_bytes
        for block in blocks:
            yield machine.decode(b"".join([known[x] for x in block.split(",")]))
        yield machine.decode(b"", True)

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids and of the decoded text."""
        ids_digest, text_digest, n = hashlib.sha256(), hashlib.sha256(), 0

        def blocks() -> Iterator[str]:
            nonlocal n
            for block in self.encode_blocks(text):
                ids_digest.update(block.encode() if not n else b"," + block.encode())
                n += block.count(",") + 1
                yield block

        for part in self.decode_blocks(blocks()):
            text_digest.update(part.encode("utf-8", "surrogatepass"))
        return n, ids_digest.hexdigest(), text_digest.hexdigest()


@lru_cache(maxsize=2)
def transducer(path: str, pattern: str) -> Transducer:
    """One transducer for each Python worker; its cache lasts from batch to batch."""
    return Transducer(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text, for every document.

    ``path`` must be readable on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path, pattern)
        for batch in batches:
            rows = [machine.round_trip(t or "") for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
