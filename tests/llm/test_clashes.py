"""Documents that share an id, columns that clash with helpers, and names that are no frame."""

import pytest
from pyspark.sql import functions as F

from tracemill.llm import exact, near, pages, shards

SCHEMA = "doc_id long, text string"


def words(base, n=60, changed=0):
    return " ".join(f"{base}{k}" if k >= changed else f"other{base}{k}" for k in range(n))


def test_two_texts_under_one_id_keep_their_links(spark):
    rows = [(1, words("a")), (1, words("b")), (2, words("a", changed=2)), (3, words("b", changed=2)), (4, words("c"))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_only_the_kept_text_of_an_id_stays(spark):
    rows = [(0, words("a", changed=2)), (1, words("a")), (1, words("b")), (None, words("a")), (5, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_kept_id", F.lit(7)).withColumn("text_key", F.lit("x"))
    kept = near.keep_distinct(df)
    assert kept.columns == df.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {rows[0], rows[2], rows[3], rows[4]}


def test_exact_copies_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], SCHEMA)
    df = df.withColumn("_key", F.lit("mine")).withColumn("__KEY", F.lit("too"))
    kept = exact.keep_unique(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3}


@pytest.mark.parametrize("same_id", ["7", "null", "id"])
def test_repeated_rows_are_spread_over_the_shards(spark, same_id):
    copies = spark.range(4000).selectExpr(f"cast({same_id} as long) as doc_id", "repeat('same text ', 40) as text")
    others = spark.range(4000).selectExpr("id + 10000 as doc_id", "repeat(md5(cast(id as string)), 12) as text")
    rows = shards.shard_documents(copies.union(others))
    found = rows.groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.max("slot").alias("last"), F.count_distinct("slot").alias("d")).collect()
    sizes = [r.n for r in found]
    assert len(sizes) == 16 and max(sizes) <= 1.02 * min(sizes)
    assert all(r.c == r.d == r.last + 1 for r in found)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<main class='site-main has-sidebar'><article><p>text</p></article></main>", "text"),
        ("<article class='post comment-status-open'><p>text</p></article>", "text"),
        ("<div id='page' class='hfeed no-sidebar'><article><p>text</p></article></div>", "text"),
        ("<article><p>a</p><div class='related-work'><p>work</p></div></article>", "a\nwork"),
        ("<article><p>an <span class='ad-hoc'>ad hoc</span> <b class='ad'>test</b></p></article>", "an ad hoc test"),
        ("<article><h1 class='share-price'>Share price</h1><h2 class='related'>Related</h2><p>a</p></article>", "Share price\nRelated\na"),
        ("<div class='sidebar widget'><p>s</p><article><p>text</p></article><p>t</p></div>", "text"),
        ("<article class='notice'><p>text</p></article>", "text"),
        ("<article><p>text</p><section class='comments'><article><p>first!</p></article></section></article>", "text"),
        ("<article><p>text</p></article><article class='comment even'><p>first!</p></article>", "text"),
        ("<article><p>text</p><div class='comment-list'><p>c</p></div><div class='relatedPosts'>r</div></article>", "text"),
        ("<p>text</p><div class='site-footer'>f</div><div class='main-nav'>n</div><div class='ad'>a</div>", "text"),
        ("<aside><article><p>teaser</p></article></aside><p>text</p>", "text"),
    ],
)
def test_names_of_the_frame(html, want):
    assert "\n".join(t for _, t in pages.visible_blocks(html)) == want
