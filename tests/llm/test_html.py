import html
import re

import pytest

from servicelens.llm import html as H
from servicelens.llm.common import table

from . import data

BODY = "<h1>A title &amp; more</h1><p>" + data.words(30, 1) + "</p><p>Be.</p><p>" + data.words(40, 2) + "<br>next</p>"
TEXT = "A title & more\n\n" + data.words(30, 1) + "\n\nBe.\n\n" + data.words(40, 2) + " next"
AROUND = ("<html><head><title>t</title><style>p{}</style><script>var x='</p><p>no</p>';</script></head><body><header><h2>Site</h2></header>"
          "<nav><ul><li><a href=/>" + data.words(20, 3) + "</a></li></ul></nav><div class='cookie-notice'><p>" + data.words(50, 4) + "</p></div>",
          "<aside><p>" + data.words(60, 5) + "</p></aside><div id=comments><p>" + data.words(70, 6) + "</p></div><form><p>" + data.words(30, 7)
          + "<input value='a>b'></p></form><!-- <p>hidden</p> --><footer><p>" + data.words(40, 8) + "</p></footer></body></html>")


def test_pages(spark):
    pages = data.collected(table(spark, "/root/testdata/sf0.01", "pages"))
    got = {r["page_id"]: r for r in data.collected(H.extract_main_text(table(spark, "/root/testdata/sf0.01", "pages")))}
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S).group(1)
        blocks = [re.sub("<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div role='main'>", "</div>"),
                                          ("<div class='content'>", "</div>"), ("<div>", "</div>")])
def test_article_without_the_rest(open_, close):
    assert H.main_text(AROUND[0] + open_ + BODY + close + AROUND[1]) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just words", "just words"), ("<p>a<p>b<script>x</p>", "a\n\nb"), ("<!-- never closed <p>x</p>", ""),
    ("<article><header><h1>T</h1></header><p>x &copy; &#233; &lt;b&gt; &amp;amp;</p></article>", "T\n\nx © é <b> &amp;"),
    ("<article><p>one</p><div class=ad>buy</div><p>two</p></article>", "one\n\ntwo"),
    ("<div class=ad>never closed<article><p>one</p></article>", "one"), ("<p title='a > b'>x\n\t y</p>", "x y"),
    ("<article><p>a <b>b</b>c <i>d</i></p><ul><li>e</li></ul></article>", "a bc d\n\ne"), ("<br>" * 5000, ""), ("a < b", "a < b")])
def test_cases(page, text):
    assert H.main_text(page) == text


def test_edges(spark):
    rows = [(1, "u", None), (None, None, "<p>x</p>"), (2, "u", ""), (2, "u", ""), (3, "u", "<article>" + "<p>" + data.LONG + "</p>" * 3)]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = data.collected(H.extract_main_text(pages))
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == sorted([("1", 0), ("None", 1), ("2", 0), ("2", 0), ("3", len(data.LONG))])
    assert H.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", [
    "<section id='discussion'><p>kept</p></section>", "<h2 id='search'>kept</h2>", "<div class='legal-analysis'>kept</div>",
    "<p><span class='share'>kept</span></p>", "<p id='related-work'>kept</p>", "kept<div class='Notice'>We</div>",
    "<p class=ad>Buy<p>kept</p>", "<p class='ad'>Buy<h2>kept</h2>", "<div><p class=ad>Buy</div>kept",
    "<ul><li class=ad>Buy<ul><li>Buy<li>Buy</ul><li>kept</ul>", "<ul><li class=ad>Buy</ul><p>kept</p>",
    "<table><tr><td class=ad>Buy<table><tr><td>Buy</td></tr></table><td>kept</table>", "<table><tr class=ad><td>Buy<td>Buy<tr><td>kept</table>",
    "<dl><dt class=ad>Buy<dd>kept</dl>", "kept<div class='cookie-notice'>We</div>", "kept<div class='comment-list comments ad-box'>We</div>",
    "kept<div role=navigation>We</div>", "kept<p class=ad>Buy <b>now</b></p>"])
def test_names_and_implied_ends_inside_an_article(part):
    assert H.main_text("<article><p>one</p>" + part + "<p>two</p><p>three</p></article><p>out</p>").split() == ["one", "kept", "two", "three"]


@pytest.mark.parametrize("gap", ["<div class='ad'><p>Buy this now</p></div>" * 3, "<p><a href=/>More of the same</a></p>" * 3])
@pytest.mark.parametrize("open_, close", [("<div class=content>", "</div>"), ("<div>", "</div>"), ("<div><section>", "</section></div>"), ("", "")])
def test_the_end_of_an_unmarked_article_after_a_silent_gap(open_, close, gap):
    beside = "<div><p>Short words of another part</p></div>"
    page = AROUND[0] + open_ + BODY + gap + "<p>The last words.</p>" + gap + "<section><h2>Later</h2><p>A note.</p></section>" + close + AROUND[1]
    assert H.main_text(page) == TEXT + "\n\nThe last words.\n\nLater\n\nA note."
    if open_:
        assert H.main_text(page.replace("</body>", beside + "</body>")) == TEXT + "\n\nThe last words.\n\nLater\n\nA note."


PROSE = "<p>" + data.words(40, 21) + "</p><p>" + data.words(40, 22) + "</p>"
SAYS = data.words(40, 21) + "\n\n" + data.words(40, 22)


@pytest.mark.parametrize("part", [
    "<div class='comments'>" + PROSE + "</div>", "<section id='comments'>" + PROSE + "</section>", "<div class='sidebar'>" + PROSE + "</div>",
    "<div class='menu'>" + PROSE + "</div>", "<div class='footer'>" + PROSE + "</div>", "<div class='notice'>" + PROSE + "</div>",
    "<div class='newsletter'>" + PROSE + "</div>", "<article class='comment'>" + PROSE + "</article>", "<div class='post-comments'>" + PROSE + "</div>",
    "<section id='comments'><article>" + PROSE + "</article><article class='comment'>" + PROSE + "</article>" + PROSE + "</section>",
    "<div class='related-stories'><p><a href=/>" + data.words(20, 3) + "</a></p><ul><li><a href=/>" + data.words(9, 4) + "</a></ul></div>"])
@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
                                          ("<div class=content>", "</div>")])
def test_parts_beside_the_article_inside_its_marks(open_, close, part):
    for page in (open_ + BODY + part + "<p>The end.</p>" + close, open_ + part + BODY + "<p>The end.</p>" + close):
        assert H.main_text(AROUND[0] + page + AROUND[1]) == TEXT + "\n\nThe end."


def test_comments_behind_the_article():
    for part in ("<article class='comment'>" + PROSE + "</article>", "<div id='comments'><article>" + PROSE + "</article></div>",
                 "<main><div class='sidebar'>" + PROSE + "</div></main>"):
        assert H.main_text("<main><article>" + BODY + "</article></main>" + part + "<footer>x</footer>") == TEXT


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div class='post share-enabled'>", "</div>"), ("<div class='content widget'>", "</div>"),
                                          ("<div>", "</div>")])
@pytest.mark.parametrize("tag, attrs", [("div", "class='ad-hoc-networks'"), ("section", "class='legal'"), ("section", "id='related-work'"),
                                        ("div", "id='discussion'"), ("div", "class='menu-of-the-day'")])
def test_one_word_of_a_name_drops_no_article_text(open_, close, tag, attrs):
    page = AROUND[0] + open_ + BODY + f"<{tag} {attrs}>" + PROSE + f"</{tag}>" + close + AROUND[1]
    assert H.main_text(page) == TEXT + "\n\n" + SAYS


def test_label_inside_a_paragraph_and_a_page_that_is_one_suspect():
    assert H.main_text("<article><p>one <label>two</label> three</p></article>") == "one two three"
    assert H.main_text("<div class='search-results-essay'>short</div>") == "short"


def test_without_marks_the_line_blocks_give_the_same(spark):
    for p in data.collected(table(spark, "/root/testdata/sf0.01", "pages")):
        assert H.main_text(re.sub(r"(</?)article\b", r"\1div", p["html"])) == H.main_text(p["html"])
