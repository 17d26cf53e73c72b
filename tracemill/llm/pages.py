"""Main text of web pages, with a suffix array of each host for boilerplate.

1. Markup gives the visible blocks of a page, in order. Menus, headers, footers, sidebars,
   notices, adverts, forms, comments, scripts and styles are left out by element, role, class
   and id, whose names count as wholes and drop nothing that is or holds the article. If the page marks its article, only blocks inside count.
2. The token streams of a host's pages are concatenated and their suffixes sorted. Suffixes that
   agree in at least ``LONG`` tokens and come from enough distinct pages of the host cover
   boilerplate: a block whose tokens are all covered is removed. Outside a marked article the runs
   inside other blocks are removed too, and the rest of the block stays. Inside a marked article "enough" is half of the pages and at least five, so that copies of an article are not
   taken for boilerplate; elsewhere it is a fifth and at least three. Pages with the same blocks
   count as one page.

Sorting the first ``LONG`` tokens of each suffix by doubling is enough, as longer repeats are
covered by their parts. Hosts of more than ``PAGES`` pages are cut into chunks of about that many by
hash, whose suffixes are sorted apart; counts are those of the whole host. A page whose copies lie in
several chunks counts in one of them. Each chunk reports its runs of ``LONG`` tokens that stand on a
``REPORT``-th of its pages or more, by 64-bit hash. What the chunks without a report could add at most
is known, so a run that might stand on enough pages of the host, but maybe on some that were not reported, is
counted again in all of them. The chunks are shuffled once and read for each of these steps.

Defined results: NULL and empty html give the empty text. A cut-off page gives what is there, without
an unfinished tag. Pages without url form one nameless host. Repeated rows are pages of their own.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import group_starts, whole_groups
from tracemill.session import materialise

LONG = 8
PAGES = 128
REPORT = 20

#: Elements without visible prose, elements of the page's frame, and elements that
#: end a block.
HIDDEN = set("script style noscript template head title svg math iframe object canvas select option textarea button datalist".split())
FRAME = set("nav footer aside form menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in class or id that name a part of the frame.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login sidebar side aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments discussion replies respond disqus share sharing social related "
    "recommended recommendations widget pagination pager toolbar skip".split()
)
#: Words that may stand beside these in a name, and names of reader comments.
BESIDE = set(
    "site page main primary secondary global top bottom left right list area box block wrap wrapper container inner section "
    "bar posts items links".split()
).union(NAMES)
COMMENTS = set("comment comments discussion replies respond disqus".split())
#: Headings and elements inside a line, which are never dropped for their name.
INSIDE = set(
    "h1 h2 h3 h4 h5 h6 a abbr b bdi bdo cite code del dfn em i ins kbd label mark q s samp small span strong sub sup time u var".split()
)
CONTAINERS = {"article", "main"}
SHOWN, DROPPED, NAMED, COMMENTED = range(4)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _named(names: str) -> int:
    """What class and id say of an element.

    A name counts as a whole: it is one of ``NAMES``, or made up of such and of words that may stand
    beside them (``site-footer``, but not ``has-sidebar`` or ``ad-hoc``).
    """
    kind = SHOWN
    for name in names.split():
        words = set(_SPLIT.split(_CAMEL.sub(" ", name).lower())) - {""}
        if words <= BESIDE and not NAMES.isdisjoint(words):
            if not COMMENTS.isdisjoint(words):
                return COMMENTED
            kind = NAMED
    return kind


class Blocks(HTMLParser):
    """Visible blocks of a page as (inside an article, text).

    What is dropped for its name alone is taken back where an article starts inside it, unless it
    holds reader comments. An article itself, a heading or an element inside a line is not dropped
    for its name, but for an article that is a comment.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []
        self.blocks: list[tuple[bool, str]] = []
        self._text: list[str] = []
        self._dropped = self._inside = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        if text:
            self.blocks.append((self._inside > 0, text))
        self._text = []

    def _frame(self, tag: str, attrs: list[tuple[str, str | None]], holds: bool) -> int:
        if tag in HIDDEN or tag in FRAME or (tag == "header" and not self._inside):
            return DROPPED
        values = {k: v or "" for k, v in attrs}
        if values.get("role", "").lower() in ROLES or "hidden" in values:
            return DROPPED
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
            return DROPPED
        if tag in ("html", "body") or tag in INSIDE:
            return SHOWN
        kind = _named(f"{values.get('class', '')} {values.get('id', '')}")
        return kind if kind != NAMED or not holds else SHOWN

    def _take_back(self) -> None:
        """An article starts: the open elements that only a name speaks against are shown."""
        if any(frame == COMMENTED for _, frame, _ in self.open):
            return
        for k, (tag, frame, inside) in enumerate(self.open):
            if frame == NAMED:
                self.open[k] = (tag, SHOWN, inside)
                self._dropped -= 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        if tag == "p":
            self._close("p", until=BLOCKS)
        elif tag == "li":
            self._close("li", until={"ul", "ol", "menu"})
        if tag in VOID:
            self._text.append(" ")
            return
        inside = tag in CONTAINERS or any(
            (k == "role" and v == "main") or (k == "itemprop" and v == "articleBody") for k, v in attrs
        )
        frame = self._frame(tag, attrs, inside)
        if inside and frame == SHOWN:
            self._take_back()
        self.open.append((tag, frame, inside and frame == SHOWN))
        self._dropped += frame != SHOWN
        self._inside += inside and frame == SHOWN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self) -> None:
        _, frame, inside = self.open.pop()
        self._dropped -= frame != SHOWN
        self._inside -= inside

    def _close(self, tag: str, until: set[str]) -> None:
        """Close the nearest open ``tag`` unless one of ``until`` is in between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in until:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        self._close(tag, until=set())

    def handle_data(self, data):
        if not self._dropped:
            self._text.append(data)


def visible_blocks(html: str | None) -> list[tuple[bool, str]]:
    """Blocks of a page; only those inside the marked article if there is one."""
    html = html or ""
    # An unfinished tag at the end of a cut-off page is not text.
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<[a-zA-Z/!]", html[cut : cut + 2]):
        html = html[:cut]
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser._flush()
    inside = [b for b in parser.blocks if b[0]]
    return inside or parser.blocks


def repeated(tokens: np.ndarray, pages: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pages that share the ``long`` tokens from each position, and the suffix array.

    ``tokens`` are numbers; ``pages`` says whose they are, in order. Ranks are doubled until they
    cover ``long`` tokens (a power of two); a suffix that reaches into the next page is alone.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < long:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        same = np.zeros(n, bool)
        same[: max(0, n - width)] = pages[width:] == pages[: max(0, n - width)]
        after[~same] = -1
        rank = np.unique((rank << 32) | (after + 1), return_inverse=True)[1].astype(np.int64)
        width *= 2
    order = np.lexsort((pages, rank))
    new_rank = np.r_[True, rank[order][1:] != rank[order][:-1]]
    new_page = new_rank | np.r_[True, pages[order][1:] != pages[order][:-1]]
    run = np.cumsum(new_rank) - 1
    distinct = np.bincount(run, weights=new_page)
    shared = np.empty(n, np.int64)
    shared[order] = distinct[run]
    short = np.ones(n, bool)
    short[: max(0, n - long + 1)] = pages[long - 1 :] != pages[: max(0, n - long + 1)]
    shared[short] = 1
    return shared, order


def _covered(hits: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` tokens lie in the runs of ``LONG`` tokens that start at ``hits``."""
    depth = np.zeros(n + LONG + 1, np.int64)
    np.add.at(depth, hits, 1)
    np.add.at(depth, hits + LONG, -1)
    return np.cumsum(depth)[:n] > 0


def _words(pages: list[list[tuple[bool, str]]]) -> tuple[list, list[str], np.ndarray]:
    """Words of each page with the number of their block, all words in order, and whose they are."""
    words = [[(k, w) for k, (_, text) in enumerate(p) for w in text.split(" ")] for p in pages]
    return words, [w for p in words for _, w in p], np.repeat(np.arange(len(pages)), [len(p) for p in words])


def _runs(codes: np.ndarray, distinct: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which ``LONG`` words of one page follow, and the hashes of these words."""
    n = max(0, len(codes) - LONG + 1)
    word = pd.util.hash_array(distinct.astype(object), categorize=False)[codes]
    run = np.zeros(n, np.uint64)
    for k in range(LONG):
        run = run * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    whole = np.flatnonzero(owner[LONG - 1 :] == owner[:n])
    return whole, run[whole].view(np.int64)


def reported_runs(pages: list[list[tuple[bool, str]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the runs of a chunk that stand on enough of its different pages, on how many, and the limit."""
    least = max(1, len(pages) // REPORT)
    _, flat, owner = _words(pages)
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64), least
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    shared, _ = repeated(codes, owner)
    whole, run = _runs(codes, distinct, owner)
    enough = shared[whole] >= least
    hashes, first = np.unique(run[enough], return_index=True)
    return hashes, shared[whole][enough][first].astype(np.int64), least


def wanted_runs(pages: list[list[tuple[bool, str]]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the runs ``wanted`` that a chunk's different pages hold, and on how many they stand."""
    _, flat, owner = _words(pages)
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    whole, run = _runs(codes, distinct, owner)
    found = np.isin(run, wanted)
    pairs = pd.DataFrame({"run": run[found], "page": owner[whole][found]}).drop_duplicates()
    return np.unique(pairs["run"].to_numpy(np.int64), return_counts=True)


def unique_blocks(
    pages: list[list[tuple[bool, str]]], often: np.ndarray | None = None, mostly: np.ndarray | None = None
) -> list[str]:
    """Texts of pages without what is covered by repeats: runs, or whole blocks in an article.

    The pages are all of a host, or those of a chunk with the hashes of the runs that stand on enough
    pages of the host outside (``often``) and inside (``mostly``) an article. Pages with the same
    blocks count as one: a page's copies do not make its text boilerplate.
    """
    names = [tuple(p) for p in pages]
    if len(distinct := list(dict.fromkeys(names))) < len(pages):
        texts = dict(zip(distinct, unique_blocks([list(p) for p in distinct], often, mostly)))
        return [texts[name] for name in names]
    words, flat, owner = _words(pages)
    if not flat or (len(pages) < 3 if often is None else not len(often)):
        return ["\n".join(text for _, text in p) for p in pages]
    tokens, different = pd.factorize(np.array(flat, dtype=object))
    repeats = {}
    if often is None:
        shared, _ = repeated(tokens, owner)
        repeats = {False: shared >= max(3, len(pages) / 5), True: shared >= max(5, len(pages) / 2)}
    else:
        whole, run = _runs(tokens, different, owner)
        for inside, runs in ((False, often), (True, mostly)):
            repeats[inside] = np.zeros(len(flat), bool)
            repeats[inside][whole[np.isin(run, runs)]] = True
    out = []
    start = 0
    for p, own in zip(pages, words):
        end = start + len(own)
        kinds = [inside for inside, _ in p]
        block = np.array([k for k, _ in own], np.int64)
        gone = np.zeros(len(own), bool)
        for inside in set(kinds):
            hits = np.flatnonzero(repeats[bool(inside)][start:end])
            if not len(hits):
                continue
            covered = _covered(hits, len(own))
            whole = (np.bincount(block, weights=~covered, minlength=len(p)) == 0)[block]
            # What follows a repeat by chance belongs to another block, so runs of a part lie inside one.
            within = hits[block[hits] == block[hits + LONG - 1]]
            covered = whole if inside else whole | _covered(within, len(own))
            gone |= covered & (np.array(kinds)[block] == inside)
        texts: list[list[str]] = [[] for _ in p]
        for (k, w), g in zip(own, gone):
            if not g:
                texts[k].append(w)
        out.append("\n".join(" ".join(ws) for ws in texts if ws))
        start = end
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages = [visible_blocks(x) for x in batch["html"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"].astype("Int64"),
                "url": batch["url"],
                "host": batch["host"],
                "chunks": batch["chunks"],
                "inside": [bool(p and p[0][0]) for p in pages],
                "blocks": [[t for _, t in p] for p in pages],
            }
        )


_CHUNK = ["host", "chunk"]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Lists of whole groups from batches that are sorted by ``keys``."""
    for frame in whole_groups(batches, keys):
        starts = group_starts(frame, keys)
        yield [frame.iloc[a:b] for a, b in zip(starts, starts[1:])]


def _blocks(part: pd.DataFrame) -> list[list[tuple[bool, str]]]:
    return [[(i, t) for t in ts] for i, ts in zip(part["inside"], part["blocks"])]


def _different(part: pd.DataFrame) -> list[list[tuple[bool, str]]]:
    """The different pages that count in this chunk."""
    return _blocks(part[part["counts"]].drop_duplicates("digest"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for parts in _groups(batches, ["host"]):
        texts = [text for part in parts for text in unique_blocks(_blocks(part))]
        frame = pd.concat(parts)
        yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts})


def _chunk_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for parts in _groups(batches, _CHUNK):
        texts: list[str] = []
        for part in parts:
            # The first row of a chunk has the runs.
            runs = [np.empty(0, np.int64) if x is None else np.asarray(x, np.int64) for x in part[["often", "mostly"]].iloc[0]]
            texts += unique_blocks(_blocks(part), *runs)
        frame = pd.concat(parts)
        yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["host", "chunk", "digest"]].drop_duplicates()


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A chunk's runs with their pages; and a row without a run for the chunk itself, with its pages."""
    for parts in _groups(batches, _CHUNK):
        for part in parts:
            pages = _different(part)
            hashes, counts, least = reported_runs(pages)
            runs = pd.array([None, *hashes.tolist()], dtype="Int64")
            yield pd.DataFrame({"host": part["host"].iloc[0], "run": runs, "n": [len(pages), *counts], "slack": least - 1})


def _recounts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for parts in _groups(batches, _CHUNK):
        for part in parts:
            hashes, counts = wanted_runs(_different(part), np.asarray(part["wanted"].iloc[0], np.int64))
            yield pd.DataFrame({"host": part["host"].iloc[0], "run": hashes, "n": counts, "n_pages": part["n_pages"].iloc[0]})


def _first_only(rows: DataFrame, *names: str) -> DataFrame:
    """Rows sorted by chunk, with the columns ``names`` in the first row of each only."""
    first = F.row_number().over(Window.partitionBy(*_CHUNK).orderBy(*_CHUNK)) == 1
    return rows.withColumn("_first", first).withColumns({name: F.when(F.col("_first"), F.col(name)) for name in names}).drop("_first")


def _large_texts(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """Texts of the pages of hosts of more than one chunk; ``dealt`` is partitioned by chunk.

    All columns of ``dealt`` go into each step, so that Spark reads one shuffle for all of them.
    """
    held = dealt.mapInPandas(_digests, "host string, chunk int, digest long").groupBy("host", "digest")
    held = held.agg(F.min("chunk").alias("owner"), F.collect_set("chunk").alias("at"))
    elsewhere = (
        held.select("host", "digest", F.explode(F.array_remove("at", F.col("owner"))).alias("chunk"))
        .groupBy(*_CHUNK)
        .agg(F.collect_list("digest").alias("elsewhere"))
    )
    counts = ~F.coalesce(F.array_contains("elsewhere", F.col("digest")), F.lit(False))
    counted = dealt.join(elsewhere, _CHUNK, "left").withColumn("counts", counts).drop("elsewhere")
    reports = counted.sortWithinPartitions(*_CHUNK).mapInPandas(_reports, "host string, run long, n long, slack long")
    summed = reports.groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))

    def of_host(name):
        return F.sum(F.when(F.col("run").isNull(), F.col(name))).over(Window.partitionBy("host"))

    placed = summed.select("*", of_host("n").alias("n_pages"), of_host("slack").alias("all_slack"))
    least = F.greatest(F.lit(3.0), F.col("n_pages") / 5)
    possible = placed.where(F.col("run").isNotNull() & (F.col("n") + F.col("all_slack") - F.col("slack") >= least))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    unsure = possible.where("slack < all_slack").groupBy("host").agg(F.collect_list("run").alias("wanted"), F.max("n_pages").alias("n_pages"))
    wanted = unsure.join(large, "host").select("host", every, "wanted", "n_pages")
    again = _first_only(counted.join(wanted, _CHUNK), "wanted").mapInPandas(_recounts, "host string, run long, n long, n_pages long")
    again = again.groupBy("host", "run").agg(F.sum("n").alias("n"), F.max("n_pages").alias("n_pages"))
    sure = possible.where("slack = all_slack").select("host", "run", "n", "n_pages").unionByName(again).where(F.col("n") >= least)
    most = F.col("n") >= F.greatest(F.lit(5.0), F.col("n_pages") / 2)
    # At most five times the runs of a mean page of the host.
    runs = sure.groupBy("host").agg(F.collect_list("run").alias("often"), F.collect_list(F.when(most, F.col("run"))).alias("mostly"))
    runs = runs.join(large, "host").select("host", every, "often", "mostly")
    return _first_only(dealt.join(runs, _CHUNK, "left"), "often", "mostly").mapInPandas(
        _chunk_texts, "page_id long, url string, text string"
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    # Only hosts of more than one chunk. Written, so that their size decides how they are joined.
    chunks = F.ceil(F.count("*") / F.lit(PAGES)).cast("int")
    large = materialise(rows.groupBy("host").agg(chunks.alias("chunks")).where("chunks > 1"), "hosts")

    def parsed(rows):
        return rows.mapInPandas(
            _parse, "page_id long, url string, host string, chunks int, inside boolean, blocks array<string>"
        )

    small = parsed(rows.join(large, "host", "left_anti").withColumn("chunks", F.lit(1)))
    texts = small.repartition("host").sortWithinPartitions("host").mapInPandas(_texts, "page_id long, url string, text string")
    if not large.isEmpty():
        spread = F.pmod(F.xxhash64("page_id", "url", F.lit(17)), F.col("chunks")).cast("int")
        dealt = parsed(rows.join(large, "host")).select(
            # Never NULL, so that no join filters on it and gets a shuffle of its own.
            F.coalesce("host", F.lit("")).alias("host"),
            F.coalesce(spread, F.lit(0)).alias("chunk"),
            F.xxhash64("inside", "blocks").alias("digest"),
            "page_id",
            "url",
            "inside",
            "blocks",
        )
        texts = texts.unionByName(_large_texts(dealt.repartition(*_CHUNK), large))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
