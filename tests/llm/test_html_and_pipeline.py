"""Page text on odd markup, and the pipeline's stages one by one."""

import pytest

from seqtide.llm import html_text


def main(page):
    return html_text.main_text(page, html_text.trained())


def measured(tree, pages, without=()):
    """(precision, recall) of the blocks taken as main text."""
    right = taken = wanted = 0
    for page in pages:
        found = html_text.blocks(page)
        rows = html_text.feature_rows(found)
        rows[:, [html_text.FEATURES.index(f) for f in without]] = 0
        for b, row in zip(found, rows, strict=True):
            main = html_text.is_main(tree, row)
            right, taken, wanted = right + (main and b.marked), taken + main, wanted + b.marked
    return right / taken, right / wanted


def used(tree):
    return {html_text.FEATURES[tree[0]], *used(tree[2]), *used(tree[3])} if len(tree) > 1 else set()


NEIGHBOURS = ("words_before", "links_before", "words_after", "links_after")


def test_tree_holds_on_other_pages_and_needs_the_neighbours():
    tree, other = html_text.trained(), html_text.labelled_pages(200, seed=77)
    assert sum(len(html_text.blocks(p)) for p in html_text.labelled_pages()) >= 200
    precision, recall = measured(tree, other)
    assert precision >= 0.95 and recall >= 0.95
    assert used(tree) & set(NEIGHBOURS)
    alone = html_text.trained(without=NEIGHBOURS)
    assert measured(alone, other, NEIGHBOURS)[0] < precision - 0.02
    assert any(html_text.main_text(p, tree) != html_text.main_text(p, alone) for p in other)


TEXT = "The river had risen overnight and the lower road was closed to all traffic until noon."
MORE = "Boats were tied to the lamp posts, and the baker brought bread by rowing from door to door."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'><article><p>{TEXT}</p><p>{MORE}</p></article></div>",
        f"<article class='overflow-hidden'><p>{TEXT}</p><p>{MORE}</p></article>",
        f"<div class='content with-comments'><p>{TEXT}</p><p>{MORE}</p></div>",
        f"<div id='page-header-image'><p>{TEXT}</p><p>{MORE}</p></div>",
        f"<form><aside><article><p>{TEXT}</p><p>{MORE}</p></article></aside></form>",
        f"<div>Copyright 2024 all rights reserved by us</div><p>{TEXT}</p><p>{MORE}</p>",
        f"<p>{TEXT}</p><p>{MORE}</p><div>Letters from readers</div><div>I was there as well, and it was higher than that.</div><div>Nice!</div>",
        f"<article><p>{TEXT}</p><p>{MORE}</p></article><div>I was there as well, and it was higher than that.</div>",
        f"<article><p>{TEXT}</p><p>{MORE}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>",
        f'<p title="a>b c">{TEXT}</p><p title=\'x>"\'>{MORE}</p>',
        f"<article><p>{TEXT}</p><div class=sidebar>Popular this week</div><p>{MORE}</p><div hidden>not shown</div></article>",
    ],
)
def test_layout_classes_and_boxes(page):
    assert main(page) == f"{TEXT}\n{MORE}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("<!-- never closed <p>x</p>", ""), ("<script>never closed <p>x</p>", ""),
        ("<nav><a>a</a></nav><article><p>One &amp; two&nbsp;&lt;b&gt; \n\t three<b>bold</b></p></article><footer>f</footer>", "One & two <b> threebold"),
        ("<article><p>Unclosed <i>tags<p>go on</article></div></div><div class='comment-list'>no</div>", "Unclosed tags\ngo on"),
        ("<article>a<div class=\"ad banner\">buy</div>b<script>x</script>c</article>", "a\nb c"),
    ],
)
def test_pages(page, text):
    assert main(page) in (text, "") if page == "<" else main(page) == text


def test_deep_and_long_pages():
    assert main("<div>" * 20_000 + "<article><p>deep</p></article>") == "deep"
    assert main("<article><p>" + "word " * 200_000 + "</p></article>").count("word") == 200_000


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", 5, "t"), (1, "u", "<article><p>x</p></article>", 5, "t"), (None, None, None, None, None)], "page_id long, url string, html string, n_chars long, text string")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, tables, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]


def test_every_sql_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    names = set(queries())
    assert set(oracle_sql()) <= names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
