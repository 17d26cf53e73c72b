"""Quality rules: repetition counts, and the divergence of a text from language references.

Every text is described by two histograms, of character classes and of common words. The
references are the mean histograms of the languages over the distinct texts of the whole corpus,
one for each value of ``lang`` with at least ``MIN_TEXTS`` texts and ``MIN_REFERENCE_CHARS``
characters; rows without language form one more. A text is held against the language it is stated to
be in, less its own share of that reference, so that it cannot vouch for itself. A text of a language
without a reference is held against the nearest of the ``MAX_OTHERS`` largest references. A text that
is long enough is rejected if its Jensen-Shannon distance exceeds a limit. The common words are
those of ``LANGUAGES``, so words decide only on texts of one of these that has a reference, by the
nearest of these languages, as texts are sometimes stated to be in the wrong one; others have no
word distance. References are a table joined on the language; only the class sums of the
``MAX_OTHERS`` largest and the word sums of ``LANGUAGES`` reach the driver.

Defined results: a NULL or blank text has no words, zero counts and fails the base rule. Repeated
rows get the same verdict. Other columns are ignored, whatever their names. Without references the
base rule alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import let
from tracemill.session import materialise

#: Languages with common words, and these words.
LANGUAGES = ["de", "en", "es", "fr"]
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "that",
    "der", "die", "und", "den", "von", "zu",
    "le", "la", "et", "les", "des", "un",
    "el", "los", "de", "que", "en", "no",
]
#: The symbols, sentence marks and white space of the character classes. The classes
#: are capitals, marks, white space, symbols, the bytes that characters beyond ASCII take besides
#: their first, and the rest, chiefly small letters.
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[.,;:!?'\"()\-]"
BLANKS = " \t\n\x0b\x0c\r"
N_CLASSES = 6
MIN_WORDS = 20
WINDOW = 8  # a power of two: window hashes are made by doubling
#: Shorter texts are not held against the references.
MIN_CHARS, MIN_COMMON = 150, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.17
#: Short texts scatter: the limits rise by these, divided by the root of the number counted.
CLASS_NOISE, WORD_NOISE = 1.0, 0.8
#: A language with fewer distinct texts or characters has no reference.
MIN_TEXTS, MIN_REFERENCE_CHARS = 20, 10_000
#: References that texts of languages without one are held against.
MAX_OTHERS = 256
#: Shares are summed as whole millionths, so that the sum does not depend on its order.
SCALE = 1_000_000


def _lost(text: Column, rest: Column) -> Column:
    return (F.length(text) - F.length(rest)).cast("long")


def _plain(text: Column) -> Column:
    """The text with every kind of white space turned into a blank; cheaper than a pattern."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_counts(words: Column) -> Column:
    """Counts of the common words, written in small letters, then of all other words."""

    def count(hits: Column, word: str) -> Column:
        return F.size(F.filter(hits, lambda x: x == word)).cast("long")

    def counts(hits: Column) -> Column:
        others = (F.size(words) - F.size(hits)).cast("long")
        return F.array(*[count(hits, w) for w in COMMON_WORDS], others)

    return let(F.filter(words, lambda w: w.isin(COMMON_WORDS)), counts)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("p")))
        )

        def places(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            let(pairs, places),
            start,
            lambda a, p: F.struct(
                (p + window).alias("end"),
                (a["n"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("n"),
            ),
            lambda a: a["n"].cast("long"),
        )

    def joined(hashes: Column, step: int) -> Column:
        """Hashes of twice as many words, from the hashes of ``step`` words."""
        return let(
            hashes, lambda a: F.transform(a, lambda h, i: F.xxhash64(h, F.get(a, i + step)))
        )

    def of(w: Column) -> Column:
        hashes, step = F.transform(w, lambda x: F.xxhash64(x)), 1
        while step < window:
            hashes, step = joined(hashes, step), 2 * step
        hashes = F.slice(hashes, 1, F.size(w) - (window - 1))
        return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(
            let(
                hashes,
                lambda h: F.when(
                    F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")
                ).otherwise(covered(h)),
            )
        )

    return let(words, of)


def text_counts(text: Column) -> Column:
    """Struct of the base counts and both histograms of a text that is not NULL."""

    def lines(rows: Column) -> Column:
        return (F.size(rows) - F.size(F.array_distinct(rows))).cast("long")

    def of(x: Column) -> Column:
        n, w = F.length(text).cast("long"), x["w"]
        classes = F.array(
            _lost(text, F.regexp_replace(text, "[A-Z]+", "")),
            _lost(text, F.regexp_replace(text, MARKS + "+", "")),
            n - x["n"],
            x["s"],
            F.octet_length(text) - n,
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            x["n"].alias("word_chars"),
            x["s"].alias("n_symbols"),
            let(
                F.filter(F.split(text, "\n"), lambda r: F.btrim(r, F.lit(BLANKS)) != ""), lines
            ).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            n.alias("n_chars"),
            let(
                classes, lambda c: F.concat(c, F.array(F.greatest(F.lit(0).cast("long"), n - _sum(c))))
            ).alias("class_hist"),
            word_counts(w).alias("word_hist"),
        )

    def parts(plain: Column) -> Column:
        return F.struct(
            F.array_remove(F.split(plain, " "), "").alias("w"),
            F.length(F.replace(plain, F.lit(" "), F.lit(""))).cast("long").alias("n"),
            _lost(text, F.regexp_replace(text, SYMBOLS + "+", "")).alias("s"),
        )

    return let(let(_plain(text), parts), of)


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _shares(counts: Column) -> Column:
    """Counts as whole millionths of their sum; NULL for an empty histogram."""
    return let(
        _sum(counts),
        lambda n: F.when(
            n > 0, F.transform(counts, lambda x: F.floor(x * F.lit(SCALE) / n).cast("long"))
        ),
    )


def measured(docs: DataFrame) -> DataFrame:
    """Counts of every document, written to the shared folder: whole texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", F.xxhash64(text).alias("text_hash"), text_counts(text).alias("q"))
    return materialise(rows.select("doc_id", "lang", "text_hash", "q.*"), "quality")


def language_references(counts: DataFrame) -> DataFrame:
    """Summed class and word shares of each language over its distinct texts.

    (ref_lang, n_texts, class_ref, word_ref), written to the shared folder. Copies count once, so
    that a text that is often repeated makes no reference. NULL is a language of its own.
    """
    shares = counts.where("n_words > 0").select(
        "lang", "text_hash", "n_chars", _shares(F.col("class_hist")).alias("c"), _shares(F.col("word_hist")).alias("w")
    )
    cells = [(x, i) for x, n in (("c", N_CLASSES), ("w", len(COMMON_WORDS) + 1)) for i in range(n)]
    texts = shares.groupBy("lang", "text_hash").agg(
        F.max("n_chars").alias("n_chars"), *[F.max(F.col(x)[i]).alias(f"{x}{i}") for x, i in cells]
    )
    sums = texts.groupBy("lang").agg(
        F.count("*").alias("n_texts"),
        F.sum("n_chars").alias("n_chars"),
        *[F.sum(f"{x}{i}").alias(f"{x}{i}") for x, i in cells],
    )
    found = sums.where((F.col("n_texts") >= MIN_TEXTS) & (F.col("n_chars") >= MIN_REFERENCE_CHARS)).select(
        F.col("lang").alias("ref_lang"),
        "n_texts",
        F.array(*[f"c{i}" for x, i in cells if x == "c"]).alias("class_ref"),
        F.array(*[f"w{i}" for x, i in cells if x == "w"]).alias("word_ref"),
    )
    return materialise(found, "references")


def _entropy(share: Column) -> Column:
    return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def js_distance(counts: Column, references: Column | list[list[int]]) -> Column:
    """Smallest Jensen-Shannon distance (base 2) of a histogram to an array of histograms.

    The divergence is the entropy of the mean less the mean of the entropies. NULL without any.
    """
    if isinstance(references, list):
        references = F.array(*[F.array(*map(F.lit, r)) for r in references])

    def shares(h: Column) -> Column:
        return let(_sum(h), lambda n: F.transform(h, lambda x: x / n))

    def divergence(p: Column, own: Column, q: Column) -> Column:
        mean = _add(F.zip_with(p, q, lambda a, b: _entropy((a + b) / 2)))
        return mean - (own + _add(F.transform(q, _entropy))) / 2

    def nearest(p: Column) -> Column:
        own = _add(F.transform(p, _entropy))
        of_each = lambda h: F.transform(references, lambda r: let(shares(r), lambda q: divergence(p, h, q)))
        return F.array_min(let(own, of_each))

    found = let(shares(counts), nearest)
    return F.when(found.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), found)))


def _without(reference: Column, hist: Column) -> Column:
    """An array of the reference less the shares of one of its texts."""
    return F.array(F.zip_with(reference, _shares(hist), lambda a, b: a - b))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, distances to the language, and verdict of every document."""
    counts = measured(docs)
    references = language_references(counts)
    largest = references.orderBy(F.desc("n_texts"), "ref_lang").limit(MAX_OTHERS).select("class_ref").collect()
    judged = counts.join(references, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")

    n = F.col("n_words")
    classes, common = F.col("class_distance"), F.col("word_distance")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * n)
    strange = F.coalesce(
        classes > MAX_CLASS_DISTANCE + CLASS_NOISE / F.sqrt("n_chars"), F.lit(False)
    ) | F.coalesce(common > MAX_WORD_DISTANCE + WORD_NOISE / F.sqrt(n), F.lit(False))
    stated = F.col("class_ref").isNotNull() & (n > 0)
    if largest:
        others = F.array(*[F.array(*map(F.lit, r.class_ref)) for r in largest])
        class_distance = F.when(
            stated, js_distance(F.col("class_hist"), _without(F.col("class_ref"), F.col("class_hist")))
        ).otherwise(js_distance(F.col("class_hist"), others))
    else:
        class_distance = F.lit(None).cast("double")
    # Texts are sometimes stated to be in the wrong one of these languages, which is no fault of theirs.
    known = references.where(F.col("ref_lang").isin(LANGUAGES)).select("ref_lang", "word_ref").collect()
    elsewhere = [F.when(F.col("lang") != r.ref_lang, F.array(*map(F.lit, r.word_ref))) for r in known]
    own = _without(F.col("word_ref"), F.col("word_hist"))
    word_refs = F.concat(own, F.array_compact(F.array(*elsewhere))) if known else own
    word_distance = js_distance(F.col("word_hist"), word_refs)
    return (
        judged.withColumns(
            {
                "class_distance": F.when(F.col("n_chars") >= MIN_CHARS, class_distance),
                "word_distance": F.when(stated & (n >= MIN_COMMON) & F.col("lang").isin(LANGUAGES), word_distance),
            }
        )
        .select("*", failed.alias("base_failed"), (~failed & ~strange).alias("kept"))
        .drop("lang", "class_hist", "word_hist", "ref_lang", "n_texts", "class_ref", "word_ref")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    good = quality_rules(docs).where("kept").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(good["doc_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == good["text_hash"]
    )
    return docs.join(good, same, "left_semi")
