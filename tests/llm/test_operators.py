"""Every corpus operator against brute force, on awkward rows and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import bpe, components, counts, exact, licenses, near, packing, pages, quality, quotes, shards
from tracemill.session import fresh_path

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


# ---- quality ----------------------------------------------------------------------------


def base(text):
    ws = words(text)
    windows = defaultdict(list)
    for k in range(len(ws) - 7):
        windows[tuple(ws[k : k + 8])].append(k)
    covered = {k + d for ks in windows.values() if len(ks) > 1 for k in ks for d in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, awkward):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (docs, awkward):
        want = Counter((i, *base(t)) for i, t in texts_of(df))
        got = quality.quality_rules(df).collect()
        assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_distance(spark):
    p, q = [3, 0, 5, 2], [10, 4, 1, 5]
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]

    def part(x, y):
        return sum(i * math.log2(2 * i / (i + j)) for i, j in zip(x, y) if i)

    want = math.sqrt((part(a, b) + part(b, a)) / 2)
    df = spark.createDataFrame([(p,)], "c array<long>").select(quality.js_distance(F.col("c"), [q, [1, 0, 0, 90]]))
    assert df.first()[0] == pytest.approx(want)


def test_quality_keeps_clean_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    kept = {r.quality: (r.n, r.k) for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()}
    assert kept[1][0] == kept[1][1] and kept[0][1] < kept[0][0] / 2


def test_quality_keeps_other_languages(spark):
    en = "the cat and the dog of that house went to the garden in the morning and no one came near".split()
    other = {
        "pl": "wczoraj wieczorem siostra wraca do domu przez stary park gdzie dzieci graja w pilke obok rzeki pod mostem".split(),
        "ru": "вчера вечером сестра шла домой через старый парк где дети играли в мяч у реки под мостом".split(),
        None: "tegnap este az orcsapat hazafele ment hegyi uton ahol sok gyerek labdazott folyo mellett hid alatt".split(),
    }

    def text(words, k):
        rng = random.Random(k)
        return ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(15))

    rows = [(k, text(en, k), "en") for k in range(20)]
    rows += [(100 * (m + 1) + k, text(w, k), lang) for m, (lang, w) in enumerate(other.items()) for k in range(20)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 80 and all(not r.base_failed and r.class_distance is not None for r in got)
    assert [r.doc_id for r in got if not r.kept] == []
    assert all((r.word_distance is None) == (r.doc_id >= 100) for r in got)


def brute_quality(rows):
    """Verdicts in plain Python: references of distinct texts, without the judged one."""
    scale = quality.SCALE

    def hists(t):
        n = len(t)
        c = [
            sum("A" <= x <= "Z" for x in t), sum(x in ".,;:!?'\"()-" for x in t), sum(x in " \t\n\x0b\x0c\r" for x in t),
            sum(x in "#*$%&|<>" for x in t), len(t.encode()) - n,
        ]
        w = [sum(x == k for x in words(t)) for k in quality.COMMON_WORDS]
        return [*c, max(0, n - sum(c))], [*w, len(words(t)) - sum(w)]

    def shares(h):
        return [x * scale // sum(h) for x in h]

    def distance(h, ref):
        p, q = [x / sum(h) for x in h], [x / sum(ref) for x in ref]

        def part(x, y):
            return sum(i * math.log2(2 * i / (i + j)) for i, j in zip(x, y) if i)

        return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    texts = defaultdict(set)
    for _, t, lang in rows:
        if words(t or ""):
            texts[lang].add(t)
    texts = {k: v for k, v in texts.items() if len(v) >= quality.MIN_TEXTS and sum(map(len, v)) >= quality.MIN_REFERENCE_CHARS}
    sums = {
        k: [[sum(col) for col in zip(*[shares(hists(t)[side]) for t in v])] for side in (0, 1)] for k, v in texts.items()
    }
    out = {}
    for i, t, lang in rows:
        t = t or ""
        n, _, _, _, repeated = base(t)
        h, ok = hists(t), not (n < 20 or 100 * repeated > 30 * n)
        if ok and len(t) >= quality.MIN_CHARS and sums:
            if lang in sums:
                near = distance(h[0], [a - b for a, b in zip(sums[lang][0], shares(h[0]))])
            else:
                near = min(distance(h[0], s[0]) for s in sums.values())
            ok = near <= quality.MAX_CLASS_DISTANCE + quality.CLASS_NOISE / math.sqrt(len(t))
            if lang in sums and lang in quality.LANGUAGES and n >= quality.MIN_COMMON:
                refs = [s[1] for k, s in sums.items() if k in quality.LANGUAGES and k != lang]
                near = min(distance(h[1], r) for r in [*refs, [a - b for a, b in zip(sums[lang][1], shares(h[1]))]])
                ok = ok and near <= quality.MAX_WORD_DISTANCE + quality.WORD_NOISE / math.sqrt(n)
        out[i] = ok
    return out


def test_quality_verdicts(spark, docs):
    """Against brute force; junk that is alone in its language, or often repeated there, is no reference."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    junk = ["".join(rng.choice("#*$%&|<>ABC") for _ in range(9)) for _ in range(300)]
    rows += [(10_000_000, " ".join(junk), "zz"), (10_000_001, " ".join(junk), "en")]
    rows += [(10_000_100 + k, " ".join(junk[::-1]), "yy") for k in range(40)]
    rows += [(10_000_200, None, None), (10_000_201, "", "zz")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert kept == brute_quality(rows)
    assert not any(v for k, v in kept.items() if k >= 10_000_000)


def test_quality_plan_is_native(docs):
    plan = quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- sharding ---------------------------------------------------------------------------


def test_shards(docs, awkward):
    for df in (docs, awkward):
        rows = shards.shard_documents(df).collect()
        want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of(df))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_split_hot_groups(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a hot text of some words").alias("text"))
    others = spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 5)).alias("text"))
    sizes = [r.n for r in shards.shard_documents(copies.union(others)).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)


# ---- pages ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>one<p>two &amp; three", "one\ntwo & three"),
        ("<nav>menu</nav><article><h1> A  title</h1><p>Text\n more<br>here</p></article><footer>f</footer>", "A title\nText more here"),
        ("<body><div class='cookie-notice'>c</div><div id=sidebar>s</div><p>main</p><form>f</form></body>", "main"),
        ("<article><p>kept</p><div class='comments'><p>first!</p></div><aside>a</aside></article><p>out", "kept"),
        ("<article><p>cut off<a hre", "cut off"),
        ("<script>var t='<p>no</p>'</script><style>p{}</style><p>yes</p>", "yes"),
        ("<p>a<b>b</b>c</p>", "abc"),
    ],
)
def test_visible_blocks(html, want):
    assert "\n".join(t for _, t in pages.visible_blocks(html)) == want


def test_repeats_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    owner = np.sort(rng.integers(0, 9, 400))
    tokens = rng.integers(0, 2, 400)
    shared, order = pages.repeated(tokens, owner)
    runs = defaultdict(set)
    for k in range(400 - 7):
        if owner[k] == owner[k + 7]:
            runs[tuple(tokens[k : k + 8])].add(owner[k])
    for k in range(400):
        whole = k + 7 < 400 and owner[k] == owner[k + 7]
        assert shared[k] == (len(runs[tuple(tokens[k : k + 8])]) if whole else 1)
    assert sorted(order) == list(range(400))


def test_repeated_blocks_go_and_articles_stay(spark):
    notice = "Please read our terms before you use any of this site today"
    rows = [(k, f"http://h.example/{k}", f"<div><p>{notice}</p><p>Page {k} says {' '.join(f'w{k}x{j}' for j in range(9))}</p></div>") for k in range(10)]
    rows += [(10, "http://o.example/1", f"<p>{notice}</p>"), (11, None, None), (11, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("bucket", F.lit(1))
    got = pages.main_texts(df).collect()
    assert len(got) == 13
    texts = {r.page_id: r.text for r in got}
    assert all(texts[k].startswith(f"Page {k} says") for k in range(10)) and texts[10] == notice and texts[11] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.main_texts(df.limit(0)).count() == 0


def test_covered_runs_go_and_unique_words_of_the_block_stay():
    notice = "Please read our terms before you use any of this site today"

    def blocks(inside):
        own = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(10)]
        return own, [[(inside, f"{notice} n{k}"), (inside, own[k])] for k in range(10)]

    own, outside = blocks(False)
    assert pages.unique_blocks(outside) == [f"n{k}\n{own[k]}" for k in range(10)]
    own, article = blocks(True)
    assert pages.unique_blocks(article) == [f"{notice} n{k}\n{own[k]}" for k in range(10)]


def test_chunks_of_a_host_do_not_depend_on_others(spark):
    # Two hosts that share one of 16,384 buckets by hash.
    hosts = spark.range(1000).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("host"))
    pairs = hosts.groupBy(F.pmod(F.xxhash64("host"), F.lit(1 << 14))).agg(F.sort_array(F.collect_set("host")).alias("hosts"))
    small, hot = min(r.hosts for r in pairs.where(F.size("hosts") > 1).collect())[:2]
    notice = "Please read our terms before you use any of this site today"
    page = F.concat(F.lit("<p>"), F.lit(notice), F.lit("</p><p>Page "), "id", F.lit(" says "), F.md5(F.col("id").cast("string")), F.lit("</p>"))
    every = spark.range(1506).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") < 6, small).otherwise(hot), F.lit("/"), "id").alias("url"), page.alias("html")
    )
    got = {r.page_id: r.text for r in pages.main_texts(every).collect()}
    assert len(got) == 1506 and not any(notice in t for t in got.values())
    assert {r.page_id: r.text for r in pages.main_texts(every.where("page_id < 6")).collect()} == {k: got[k] for k in range(6)}


def test_copies_of_a_page_are_no_boilerplate():
    block = "A text of more than eight words that stands on every copy of this page"
    other = [[(True, f"Page {k} says {' '.join(f'w{k}x{j}' for j in range(9))}")] for k in range(3)]
    for inside in (True, False):
        got = pages.unique_blocks([[(inside, block)]] * 20 + other)
        assert got == [block] * 20 + [p[0][1] for p in other]


def _host_of_chunks(spark, n):
    """Chunks of the pages 0 to n of one host, as ``main_texts`` deals them."""
    url = F.concat(F.lit("http://h.example/"), "id")
    chunk = F.pmod(F.xxhash64("id", url, F.lit(17)), F.lit(-(-n // pages.PAGES)))
    return {r.id: r.chunk for r in spark.range(n).select("id", chunk.alias("chunk")).collect()}


@pytest.mark.parametrize("n_marked, gone", [(59, False), (60, True)])
def test_shares_are_those_of_the_whole_host(spark, n_marked, gone):
    # All but one in one chunk, which are more than a fifth of its pages; too few for a report in the other.
    chunks = _host_of_chunks(spark, 300)
    first = [k for k in range(300) if chunks[k] == 0][: n_marked - 1]
    assert len(first) == n_marked - 1
    marked = {*first, next(k for k in range(300) if chunks[k] == 1)}
    notice = "Please read our terms before you use any of this site today"
    rows = [(k, f"http://h.example/{k}", f"<p>{notice}</p>" * (k in marked) + f"<p>Page {k} says w{k}</p>") for k in range(300)]
    got = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kept = "" if gone else f"{notice}\n"
    assert {r.page_id: r.text for r in got} == {k: kept * (k in marked) + f"Page {k} says w{k}" for k in range(300)}


@pytest.mark.parametrize("n_marked, gone", [(20, False), (21, True)])
def test_copies_in_several_chunks_count_once(spark, n_marked, gone):
    notice = "Please read our terms before you use any of this site today"
    copy = "A text of more than eight words that stands on every copy of this page"
    own = [f"<p>{notice}</p>" * (k < n_marked) + f"<p>Page {k} says w{k}</p>" for k in range(100)] + [f"<p>{copy}</p>"] * 200
    rows = [(k, f"http://h.example/{k}", html) for k, html in enumerate(own)]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 300 and {got[k] for k in range(100, 300)} == {copy}
    assert [got[k] for k in range(100)] == [("" if gone or k >= n_marked else f"{notice}\n") + f"Page {k} says w{k}" for k in range(100)]


def test_chunks_of_a_host_share_one_shuffle(spark):
    rows = [(k, f"http://h.example/{k}", f"<p>Page {k} says w{k}</p>") for k in range(300)]
    got = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.count() == 300
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # The markup of a page is read once: of the small hosts, and of the large ones.
    assert 1 <= plan.count("_parse(") <= 2


# ---- quotes -----------------------------------------------------------------------------


def test_quotes(spark):
    first = "Where is the station?\n\nI need to catch a train."
    second = "> Where is the  Station?\n\nIt is behind the old market."
    third = "> > Where is the station?\n> It is behind the old market.\n\nThank you very much."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "user", third),
        (1, 3, "user", "> nobody ever said this thing\nWhat?"), (1, 4, "user", None), (1, 5, "user", ""),
        (2, 0, "user", "It is behind the old market."), (2, 0, "user", "It is behind the old market."),
        (None, 1, "user", "> It is behind the old market."), (2, None, "user", "> It is behind the old market."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("root", F.lit(1)).withColumn("key", F.lit(2))
    out = quotes.link_quotes(df).collect()
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.thread_turn, r.depth) for r in out}
    assert len(out) == len(rows)
    assert got[1, 0] == (first, None, 0, 0)
    assert got[1, 1] == ("It is behind the old market.", 0, 0, 1)
    assert got[1, 2] == ("Thank you very much.", 1, 0, 2)
    assert got[1, 3] == ("What?", None, 3, 0)
    assert got[1, 4] == (None, None, 4, 0) and got[1, 5] == ("", None, 5, 0)
    assert got[2, 0][1] is None and got[None, 1][1] is None and got[2, None][1] is None
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_of_all_levels_and_lengths(spark):
    rows = [
        (1, 0, "The station is behind the old market."), (1, 1, "Yes."), (1, 2, "Why?"),
        (1, 3, ">> The station is behind the old market.\nThanks."),
        (1, 4, "> Yes.\n>> The station is behind the old market.\nGood."),
        (1, 5, "> Why?\nBecause."),
        (1, 6, "> Nobody said this.\n>>> Why?\n>> Yes.\nSo."),
        (1, 7, "> Yes.\n> \n> Because.\nWell."),
        (1, 8, "> \n>\nNothing."),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.thread_turn) for r in quotes.link_quotes(df).collect()}
    assert got == {
        0: (None, 0), 1: (None, 1), 2: (None, 2), 3: (0, 0), 4: (1, 1), 5: (2, 2), 6: (1, 1), 7: (5, 2), 8: (None, 8)
    }


def brute_parents(rows):
    """(conv, turn) -> parent, message by message in plain Python."""

    def parse(text):
        out, run, last = [], [], None
        for line in re.split("\r?\n", text or ""):
            mark = re.match(r"[ \t]*(?:>[ \t]*)+", line)
            level = mark.group(0).count(">") if mark else 0
            body = re.sub(r"\s+", " ", line[mark.end() if mark else 0 :].lower()).strip(" ")
            if run and (level != last or not body):
                out.append((last, " ".join(run)))
                run = []
            if body:
                out.append((level, body))
                run.append(body)
            last = level
        return out + ([(last, " ".join(run))] if run else [])

    parsed = [(c, t, parse(x)) for c, t, x in rows]
    out = {}
    for c, t, found in parsed:
        quotes_of = {}
        for level, body in found:
            if level:
                quotes_of[body] = min(level, quotes_of.get(body, level))
        votes = Counter()
        for body, level in quotes_of.items():
            origins = [u for d, u, theirs in parsed if d == c and u < t and (0, body) in theirs]
            if origins:
                votes[level, max(origins)] += len(body)
        out[c, t] = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else None
    return out


def test_quotes_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in range(12):
        for t in range(25):
            lines = [
                rng.choice(["", "", "> ", ">> ", "> > >"]) + rng.choice(["", "Yes.", "why  not", "It rains.", "Go on", f"note {t}"])
                for _ in range(rng.randint(0, 7))
            ]
            rows.append((c, t, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.link_quotes(df).collect()}
    want = brute_parents(rows)
    assert got == want and sum(x is not None for x in want.values()) > 50


def test_quotes_of_one_long_message(spark):
    """Time grows with the passages of a message, not with their square."""
    import time

    def seconds(n):
        text = "\n\n".join(f"> passage {k}\nanswer {k}" for k in range(n // 2))
        df = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")
        start = time.perf_counter()
        assert quotes.parse_quotes(df).select(F.size("passages")).first()[0] == 2 * n
        return time.perf_counter() - start

    seconds(16_000)
    assert seconds(64_000) < 4.5 * max(seconds(16_000), 0.5)


def test_quotes_in_a_hot_conversation(spark):
    chain = spark.range(3000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("> message number "), F.col("id") - 1, F.lit("\nmessage number "), F.col("id")).alias("text"),
    )
    rows = quotes.link_quotes(chain).collect()
    assert all(r.thread_turn == 0 and r.depth == r.turn and r.parent_turn == (r.turn - 1 if r.turn else None) for r in rows)


# ---- tokens -----------------------------------------------------------------------------


def test_round_trips(docs, awkward, library):
    for df in (docs, awkward):
        want = Counter()
        for i, t in texts_of(df):
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        got = bpe.encode_decode(df, PATH, P.PATTERN).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_stable_tokens_leave_the_window(library, monkeypatch):
    import random

    machine = bpe.Transducer(PATH, P.PATTERN)
    monkeypatch.setattr(bpe, "WINDOW_BYTES", 64)
    rng = random.Random(5)
    for letters in ("ab", "etaoin", "th", "aeiourstln"):
        text = "".join(rng.choice(letters) for _ in range(6000))
        ids = [x for part in machine.stream_piece(text[k : k + 50].encode() for k in range(0, len(text), 50)) for x in part]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_counts_and_cache(spark, docs, awkward, library):
    cache = fresh_path(spark, "cache")
    for df in (awkward, docs, docs):
        want = Counter()
        for i, t in texts_of(df):
            n = len(library.encode(t, add_special_tokens=False).ids)
            want[i, len(t.encode()), n, n > 1024] += 1
        got = counts.count_tokens(df, cache, PATH, P.PATTERN).collect()
        assert Counter(tuple(r) for r in got) == want
    stored = spark.read.parquet(cache)
    distinct = {t for df in (awkward, docs) for _, t in texts_of(df)}
    assert stored.count() == stored.select("content").distinct().count() == len(distinct)


def test_counts_of_a_second_call_encode_nothing(spark, docs):
    cache = fresh_path(spark, "cache")
    first = set(map(tuple, counts.count_tokens(docs, cache, PATH, P.PATTERN).collect()))
    rows = spark.read.parquet(cache).count()
    again = counts.count_tokens(docs.unionByName(docs.limit(3)), cache, PATH, P.PATTERN)
    assert set(map(tuple, again.collect())) == first and spark.read.parquet(cache).count() == rows
    # Counts of another version are not met.
    assert counts._cached(spark, cache, counts.tokenizer_digest(PATH, "other")).isEmpty()


def packed_well(rows, df, library):
    want, total = Counter(), 0
    for i, t in texts_of(df):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        start, end, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            data = b"".join(x.to_bytes(4, "little") for x in ids[start:end])
            want[i, piece, start, end - start, zlib.crc32(data)] += 1
            start, end, piece = end, end + 2048, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), -(-total // 2048)


def test_packing(docs, awkward, library):
    for df in (docs, awkward):
        n, least = packed_well(packing.pack_documents(df, PATH, P.PATTERN).collect(), df, library)
        assert n <= least * 1.02 + 1


def test_crossover_keeps_every_piece():
    import random

    rng = random.Random(2)
    lengths = [rng.randint(1, 2047) for _ in range(200)]
    island = packing.Island(lengths, 2048, 1)
    mother, father = island.fresh(0.0), island.fresh(0.5)
    for _ in range(20):
        child = island.cross(mother, father)
        assert sorted(i for b in child for i in b) == list(range(200)) and max(island.load(child)) <= 2048
        mother, father = child, mother
    assert island.worth(island.evolve([])) <= island.worth(island.fresh(0.0))


# ---- duplicates -------------------------------------------------------------------------


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact(docs, awkward, counters):
    for df in (docs, awkward):
        groups = defaultdict(list)
        rows = texts_of(df)
        plain = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows]
        for (i, t), p in zip(rows, plain):
            groups[p].append((-len(t), i is None, i or 0, i))
        want = Counter()
        for (i, _), p in zip(rows, plain):
            keep = min(groups[p], key=lambda x: x[:3])[3]
            want[i, keep, len(groups[p]), keep == i, hashlib.sha256(p.encode()).hexdigest()] += 1
        got = exact.exact_groups(df, counters).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "c"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    kept = exact.keep_unique(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "a b"), (None, "c"), (3, "d")])


def test_frequent_digests(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).cast("binary").alias("digest"))
    found = [bytes(r.digest) for r in exact.frequent_digests(rows, 4).collect()]
    assert b"hot" in found and len(found) <= 4


def near_truth(rows):
    sets = {}
    for i, t in rows:
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        if ws:
            sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(i for i in sets if i is not None)
    for a in keys:
        for b in keys:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(sets.get(i, ())), find(i), find(i) == i) for i, _ in rows)


def test_near(docs, awkward):
    for df in (docs, awkward):
        got = near.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == near_truth(texts_of(df))


def test_near_with_many_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text)] * 300 + [(2, text + " w40"), (3, "something else that is on its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(1, 1): 300, (2, 1): 1, (3, 3): 1})


def test_near_family_over_several_blocks(spark, monkeypatch):
    """A family whose members are alike to different degrees, cut into many blocks."""
    import random

    rng = random.Random(11)
    core = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = list(core)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "BUCKET_BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == near_truth(rows)


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, common in ((4, 3), (40, 30), (2000, 1000)):
        hits = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = near.sketch(np.unique(pool[:n])), near.sketch(np.unique(pool[n - common :]))
            hits.append((a == b).mean())
        assert np.mean(hits) == pytest.approx(common / (2 * n - common), abs=0.03)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (7, 7), (20, 21)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {**{k: 100 for k in range(100, 161)}, 3: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    assert got == want


# ---- licenses ---------------------------------------------------------------------------


def test_patience():
    a, b = "x a b c y a d".split(), "a b c d".split()
    pairs = licenses.patience(a, b)
    assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == list("abcd")


def test_sentences_that_only_resemble_notices_have_no_license():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.COVERAGE)
    for text in (
        "The engine ran under boost with a license plate",
        "stopped under the new rules, BSD staff said, with no license",
    ):
        assert scanner.scan(text) == []
    assert scanner.scan("This is released under the MIT License.")[0][0].startswith("MIT")


def test_licenses(spark, awkward):
    filler = " ".join(f"word{k}" for k in range(3000))
    mit = licenses.TEMPLATES["MIT-text"]
    cases = [
        ("Released under the MIT License.", "MIT"),
        (f"{filler}\nLicensed under the Apache License, Version 2.0.\n{filler}", "Apache-2.0"),
        ("Released under the MIT License.\n" * 40, "MIT"),
        (filler + "\n" + mit.replace(",", ",\n* ") + "\n" + filler, "MIT-text"),
        (mit.replace("merge, publish", "publish"), "MIT-text"),
        ("the license of the work is under version 3", None),
        (None, None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[k].license for k in range(len(cases))] == [w for _, w in cases]
    assert got[1].first_word == 3000 and got[1].coverage == 1.0
    assert licenses.scan_licenses(awkward).where("license is not null").count() == 0


@pytest.mark.parametrize("name", ["MIT", "GPL-3.0", "MIT-text", "BSD-text"])
@pytest.mark.parametrize("copies", [2, 3, 7])
def test_notices_repeated_inside_a_text(name, copies):
    notice, filler = licenses.TEMPLATES[name], " ".join(f"word{k}" for k in range(300))
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan
    n = len(licenses.plain_words(notice))
    best = scan(f"{filler}\n" + f"{notice}\n" * copies + filler)[0]
    assert best[:2] == (name, 1.0) and best[2] >= 300 and best[3] < 300 + n * copies
    if n > 20:
        changed = notice.replace(" and ", " und ", 1)
        best = scan(f"{filler}\n" + f"{changed}\n" * copies + filler)[0]
        assert best[0] == name and best[1] == (n - 1) / n


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text, want",
    [
        (GNU.format("General Public License", 3), ["GPL-3.0-or-later"]),
        (GNU.format("General Public License", 2), ["GPL-2.0-or-later"]),
        (GNU.format("Lesser General Public License", "2.1").replace("program", "library"), ["LGPL-2.1-or-later"]),
        (GNU.format("Affero General Public License", 3), ["AGPL-3.0-or-later"]),
        (GNU.format("General Public License", 9), ["GPL"]),
        (GNU.format("Lesser General Public License", 3) + " more words here " * 30 + GNU.format("General Public License", 3), ["LGPL-3.0-or-later", "GPL-3.0-or-later"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("It is licensed under the GPLv3.", ["GPL-3.0"]),
        ("Distributed under the MIT license", ["MIT"]),
        ("It is available under the terms of the MIT License.", ["MIT"]),
        ("// SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("Creative Commons Attribution Share Alike 3.0 Unported", ["CC-BY-SA-3.0"]),
        ("Text is under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0"]),
        ("See https://creativecommons.org/licenses/by-nc-sa/3.0/ for more", ["CC-BY-NC-SA-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-Something 4.0 International License.", []),
    ],
)
def test_license_families(text, want):
    scan = licenses.Scanner(licenses.NOTICES, licenses.COVERAGE).scan
    for around in ("", " some words around it " * 20):
        assert [f[0] for f in scan(around + text + around)] == want


def test_bsd_clauses_are_told_apart():
    scan = licenses.Scanner(licenses.NOTICES, licenses.COVERAGE).scan
    texts = dict(n for n in licenses.NOTICES if n[0].startswith("BSD-") and len(n[1]) > 300)
    assert len(texts) == 2
    for name, text in texts.items():
        assert scan(f"1. {text}")[0][:2] == (name, 1.0)


def test_every_license_line_is_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = df.where(F.col("text").rlike(r"Licensed under|is licensed under|Released under")).count()
    assert licenses.scan_licenses(df).where("license is not null").count() == told > 0


# ---- all --------------------------------------------------------------------------------


def test_empty_tables(spark, nothing):
    cache = fresh_path(spark, "cache")
    for result in (
        quality.quality_rules(nothing), shards.shard_documents(nothing), bpe.encode_decode(nothing, PATH, P.PATTERN),
        packing.pack_documents(nothing, PATH, P.PATTERN), counts.count_tokens(nothing, cache, PATH, P.PATTERN),
        exact.exact_groups(nothing), licenses.scan_licenses(nothing), near.near_duplicates(nothing),
        quality.keep_good(nothing), exact.keep_unique(nothing), near.keep_distinct(nothing),
    ):
        assert result.count() == 0


def test_pipeline_stages(spark, docs, awkward, library):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "best-fit packing"]
    for df in (docs, awkward):
        kept = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, SF)
            assert kept.columns == df.columns
            rows = texts_of(before)
            if name == "quality rules":
                want = {r.doc_id for r in quality.quality_rules(before).where("kept").collect()}
            elif name == "exact dedup":
                want = {r.doc_id for r in exact.exact_groups(before).where("kept").collect()}
            else:
                want = {i for (i, _, _, k) in near_truth(rows) if k}
            assert {i for i, _ in texts_of(kept)} == want
        final = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        packed_well(final, kept, library)
