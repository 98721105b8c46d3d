"""Language ID on held-out rows and HTML extraction on pages with known text."""

import pytest
from pyspark.sql import functions as F

from navlytics.llm import html_text, langid
from navlytics.llm.queries import op2_language_id

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    got = op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 250 < len(held) < 420
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 2  # its documents are all in the four languages


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    assert model.predict(None) == model.predict("") == model.predict("12 34 !") == ("und", 0.0, True)
    assert model.predict("漢字仮名交じり文の例文です。" * 30)[2] and model.predict("qzx xqz wkk " * 100)[2]
    long = " ".join(r.text for r in docs.where("lang = 'de' and text is not null").limit(200).collect())
    assert model.predict(long)[0] == "de" and not model.predict(long)[2]
    slots, n, letters = langid.counts(long)  # taken in pieces
    assert letters == sum(c.isalpha() for c in long) and n.sum() > 2.9 * letters
    frame = spark.createDataFrame([(None, None, 1), (1, "nicht auch die", 2), (1, "nicht auch die", 2)], "doc_id long, text string, score int")
    assert sorted(r.lang_pred for r in langid.predict(frame, model).collect()) == ["de", "de", "und"]
    assert langid.predict(frame.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0), F.lit(True))
    assert none.languages == () and none.predict("text") == ("und", 0.0, True)


def test_long_texts_count_as_if_in_one_piece():
    import random

    rng = random.Random(4)
    words = ["and", "the", "table", "οδος", "ΟΔΟΣ", "größe", "İzmir", "12,345.67", "--", "0 0  0", "\n\n\t", "(3)"]
    text = "7 7" + " ".join(rng.choice(words) for _ in range(120_000)) + " 99 "
    assert len(text) > 2 * (1 << 18)

    def same(a, b):
        return a[2] == b[2] and a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()

    whole = langid.counts(text, step=len(text) + 1)
    assert same(langid.counts(text), whole)
    short = text[:3000]
    assert all(same(langid.counts(short, step=k), langid.counts(short)) for k in (20, 500, 2999, 3000))
    short = short.lower()  # pieces shorter than a word are cut in it
    assert all(same(langid.counts(short, step=k), langid.counts(short)) for k in (1, 2, 3, 5))
    table = "word " + "1234567890 " * 60_000 + "word"  # one run of non-letters over several cuts
    assert same(langid.counts(table), langid.counts("word word"))


def test_extraction_of_held_out_layouts():
    chain = html_text.model()
    right = wrong = pages = 0
    for seed in range(10_000, 10_150):
        page, labels = html_text.labelled_page(seed)
        found = html_text.blocks(page)
        assert len(found) == len(labels)
        got = chain.decode(html_text.features(found))
        pages += got == labels
        right += sum(a == b for a, b in zip(got, labels))
        wrong += sum(a != b for a, b in zip(got, labels))
    assert right / (right + wrong) > 0.97 and pages / 150 > 0.85, (right, wrong, pages)


def test_extraction_of_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("<script>var a='<p>x</p>'", ""), ("<article><p>One &amp; two&nbsp;three<p>Four\n five</article>", "One & two three\nFour five"),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>Some longer text that says a lot.</p></article><div class='comments'><p>Nice one!</p></div><footer>&copy; x</footer>",
     "T\nSome longer text that says a lot."),
    ("<!-- <p>no</p> --><article><p style='display:none'>no</p><p>yes <b>bold<br>line</p></article><form><label>Mail</label></form>", "yes bold line"),
])
def test_small_pages(page, want):
    assert html_text.main_text(page, html_text.model()) == want


def test_pages_edge_cases(spark):
    frame = spark.createDataFrame([(None, None, None, 1), (1, "u", "<article><p>" + "long text " * 200_000 + "</p></article>", 2), (1, "u", "<b", 2)], "page_id long, url string, html string, text int")
    got = sorted((r.n_chars for r in html_text.extract(frame).collect()))
    assert got[0] == 0 and got[-1] == 1_999_999
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["p title=it's", 'p data-x=5"', "p 'a", 'p title="a>b" \'', "p title = 'x > y'", 'p href=a?b="c', "p title=", 'p title="it\'s"'])
def test_a_stray_quote_inside_a_tag_ends_with_the_tag(tag):
    page = f"<article><{tag}>Hello world.</p><p>Don't lose it.</p><p>Third \"one\".</p></article>"
    assert [b.text for b in html_text.blocks(page)] == ["Hello world.", "Don't lose it.", 'Third "one".']
