from __future__ import annotations

import numpy as np

from tidemark.llm import main_text as mt

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy seven things for the price of none today</div>
<article><header><h1>A &amp; B &lt;title&gt;</h1></header><p><b>First   paragraph with <a href=z>a link</a> and&nbsp;more<br>
text in it.<p>Second.</p><p>Third&#33; caf&eacute;</p><div class="share-buttons">Share this</div><form><input>Name</form>
<div id="comments"><p>A reader says that this is a fine article and goes on for a while.</p></div></article>
<aside>Also read this long piece about something else entirely, it is good</aside><footer>&copy; nobody</footer></body></html>"""


def texts(spark, rows):
    return mt.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).orderBy("page_id").collect()


def kept(page: str) -> list[str]:
    blocks, features = mt.blocks(page)
    return [b for b, k in zip(blocks, mt.trained_tree().predict(features) >= 0.5, strict=True) if k] if blocks else []


def test_the_article_alone_stays():
    assert kept(PAGE) == ["A & B <title>", "First paragraph with a link and more text in it.", "Second.", "Third! café"]


def test_tree_learns_its_table():
    table = np.array(mt.EXAMPLES, float)
    assert ((mt.trained_tree().predict(table[:, :-1]) >= 0.5) == table[:, -1]).all()
    assert len(mt.EXAMPLES) < 200


def test_page_without_article_element():
    body = "<p>" + "many plain words of prose " * 12 + "</p>"
    links = "<ul>" + "<li><a href=x>link here</a></li>" * 5 + "</ul>"
    assert kept(f"<html><body>{links}{body}{body}{links}</body></html>") == [" ".join(("many plain words of prose " * 12).split())] * 2


def test_classes_of_the_page_and_of_paragraphs():
    page = (
        '<body class="has-sidebar comments-open"><article class="post notice"><p>kept one</p><p class="ad-slot">bought</p>kept two<h2 id="related">see also</h2>'
        '<p hidden>unseen</p></article><section><article class="comment-body">a reader</article></section><div role=complementary><p>beside</p></div></body>'
    )
    assert kept(page) == ["kept one", "kept two"]


def test_features_are_those_of_the_neighbours():
    _, x = mt.blocks("<p>one two</p><p><a>three</a> four five</p><p>six</p>")
    assert x[1].tolist() == [2, 3, 1, 0, 0, 0, 0, 1, 0]
    _, x = mt.blocks("<p>one two</p><p><a href=x>three</a> four five</p><p>six</p>")
    assert x[1].tolist() == [2, 3, 1, 0, 1 / 3, 0, 0, 1, 0]


def test_broken_pages(text_spark):
    pages = ["<article><p>cut off <b>here", "<article><p>a < b and c > d</p>", "<article>x</nav></div>y</article>", "<script>never closed", "<!-- never closed", "plain text", "<p", "", None, "<article>" + "w " * 50_000]
    got = texts(text_spark, [(i, None, p, "x", "y") for i, p in enumerate(pages)] + [(None, None, None, None, None), (0, "u", "<article>twice</article>", "", "")])
    by = {r.page_id: r.text for r in got if r.url is None}
    assert by[0] == "cut off here" and by[1] == "a < b and c > d" and by[2] == "x\ny" and by[3] == by[4] == by[6] == by[7] == by[8] == by[None] == ""
    assert by[9] == " ".join(["w"] * 50_000)
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(pages) + 2
    assert texts(text_spark, []) == []


def test_code_points_are_counted(text_spark):
    (row,) = texts(text_spark, [(1, "u", "<article>a&#x1F600;b   c</article>", None, None)])
    assert (row.text, row.n_chars) == ("a\U0001f600b c", 5)


PROSE = " ".join("many plain words of prose".split() * 12)


def test_elements_named_like_unseen_ones():
    page = f"<html><head><meta charset=utf-8><title>no</title><body><article><svg-icon x=1></svg-icon><p>{PROSE}</p><svg viewBox='0'/><video-player></video-player><p>end of it</p><svg><text>no</text></svg></article>"
    assert kept(page) == [PROSE, "end of it"]
    assert kept(f"<head><title>no</title><style>p{{}}</style><link rel=x><p>{PROSE}</p>") == [PROSE]


def test_hidden_is_an_attribute():
    for shown in ('class="overflow-hidden"', 'style="overflow:hidden"', "class='sm:hidden x'", "data-hidden=1", 'title="hidden"', "hidden=false"):
        assert kept(f"<article><div {shown}><p>{PROSE}</p><p>short end</p></div></article>") == [PROSE, "short end"], shown
    for unseen in ("hidden", 'hidden=""', 'style="color:red; display : none"', "aria-hidden=true", 'class=x HIDDEN data-y="z"'):
        assert kept(f"<article><div {unseen}><p>{PROSE}</p></div><p>{PROSE} seen</p></article>") == [f"{PROSE} seen"], unseen


def test_text_outvotes_class_marks():
    whole = f"<h1>A title of five words</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE} two</p>"
    for name in ("layout-with-sidebar", "post popular", "has-share-bar", "discussion"):
        assert kept(f'<body><nav>x</nav><div class="{name}">{whole}</div></body>') == ["A title of five words", PROSE, "Short.", f"{PROSE} two"], name
        assert kept(f'<article><div class="{name}">{whole}</div><div class=share>Share this</div></article>') == ["A title of five words", PROSE, "Short.", f"{PROSE} two"], name
    page = f'<article>{whole}{whole}<div class="notice"><p>{PROSE} three</p></div><div class="related"><p><a href=x>{PROSE}</a></p><p>six words</p></div></article>'
    assert kept(page) == ["A title of five words", PROSE, "Short.", f"{PROSE} two"] * 2 + [f"{PROSE} three"]


def test_forms():
    """A page or an article wrapped in a form is read; a form beside or in the article is not."""
    whole = f"<h1>A title of five words</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE} two</p>"
    want = ["A title of five words", PROSE, "Short.", f"{PROSE} two"]
    assert kept(f"<body><form action=x><nav><a href=y>menu</a></nav><div>{whole}</div></form></body>") == want
    assert kept(f"<form><article>{whole}</article></form>") == want
    assert kept(f"<form><main>{whole}</main><aside>{PROSE}</aside></form>") == want
    assert kept(f"<article>{whole}<form><p>Your name</p><p>{PROSE} terms</p></form></article>") == want
    assert kept(f"<article>{whole}</article><form><p>Sign up for our letters today</p></form>") == want


def test_quotes_open_values_only_after_an_equals_sign():
    assert kept(f"<article><p title=don't>It's one {PROSE}</p><p>and 'two'</p></article>") == [f"It's one {PROSE}", "and 'two'"]
    assert kept(f"""<article><p data-x="a > b" title='c > d'>{PROSE}</p><p title = "it's">end</p></article>""") == [PROSE, "end"]
    assert kept(f"<article><img alt=5\" src=x><p>{PROSE}</p></article>") == [PROSE]
    assert kept("<article><p>text<p title=\"never closed>one</p><p>two</p>")[0] == "text"
    assert kept("<article>" + "<p a='" * 3000 + PROSE) is not None  # in time


def test_lists_and_headings_in_prose_without_an_article():
    page = f"<div><p>{PROSE}</p><h2>Ingredients</h2><ul><li>two eggs</li><li>some flour</li><li>salt</li></ul><p>{PROSE} two</p><h2>End</h2><p>{PROSE} three</p></div>"
    assert kept(page) == [PROSE, "Ingredients", "two eggs", "some flour", "salt", f"{PROSE} two", "End", f"{PROSE} three"]
    menu = "".join(f"<li><a href=x>entry {k}</a></li>" for k in range(6))
    assert kept(f"<div><ul>{menu}</ul><p>{PROSE}</p><ul>{menu}</ul><p>Contact</p><ul>{menu}</ul></div>") == [PROSE]


def test_links_may_hold_blocks():
    card = "<a href=x><h3>Another story</h3><p>What it is about in a few words</p></a>"
    assert kept(f"<div><p>{PROSE}</p><p>{PROSE} two</p></div><div>{card * 3}</div>") == [PROSE, f"{PROSE} two"]
    assert kept(f"<article><a name=top><p>{PROSE}</p><p>{PROSE} two</p></article>") == [PROSE, f"{PROSE} two"]
    assert kept(f"<div><p>See <a href=x>never closed<p>{PROSE}</p><p>{PROSE} two</p><a href=y>x</a></div>")[-2:] == [PROSE, f"{PROSE} two"]


def test_neighbours_decide_on_pages_without_an_article():
    """The share of decisions that change when the neighbours' features are blanked, on pages of prose, lists and menus in turn."""
    rng = np.random.default_rng(3)
    tree, changed, total = mt.trained_tree(), 0, 0
    for _ in range(60):
        parts = []
        for _ in range(12):
            kind = rng.integers(4)
            n = int(rng.integers(1, 5))
            parts.append([f"<p>{PROSE}</p>", f"<p>{'word ' * n}</p>", f"<p><a href=x>{'link ' * n}</a></p>", f"<li>{'item ' * n}</li>"][kind])
        _, x = mt.blocks("<div>" + "".join(parts) + "</div>")
        blank = x.copy()
        blank[:, [0, 2, 3, 5]] = 0
        changed += int(((tree.predict(x) >= 0.5) != (tree.predict(blank) >= 0.5)).sum())
        total += len(x)
    assert changed > 0.05 * total
