import html
import itertools
import random
import re

import pytest

from iterix.llm import html_text as H
from iterix.session import ship

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="top"><b>Site name</b><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies on this site, please accept them</div><div class="ad">Buy some more</div><!-- <p>hidden</p> -->
<{main}><h1>A &amp; B</h1><p>First   paragraph with <b>bold</b> and <a href="#">a link</a>,
on two lines &#8212; caf&eacute; &lt;b&gt;.</p>{ad}<p>Second one<br>after a break, unclosed<p>Third paragraph here<ul><li>item one</li><li>item two</li></ul>
<form><input value="x"><button>Send it</button></form></{main}>
<div id="comments"><p>Reader one says hello to all of you</p><p>Reader two says hello too, at more length</p></div>
<aside>Related articles to read</aside><footer>&copy; 2024 Some company, all rights reserved</footer></body></html>"""
TEXT = "A & B\n\nFirst paragraph with bold and a link, on two lines — café <b>.\n\nSecond one after a break, unclosed\n\nThird paragraph here\n\nitem one\n\nitem two"
LABELLED = PAGE.format(main="article", ad="")
AD = '<div class="ad">Buy one of these ten very fine things today now</div>'


@pytest.fixture(scope="module")
def model():
    return H.fit_pages([LABELLED] * 20)


@pytest.mark.parametrize("main", ["article", "main", "div"])
@pytest.mark.parametrize("ad", ["", AD, '<div id="ad-17">Buy one</div>' * 3, '<aside><ul><li><a href="/x">another one</a></li></ul></aside>'])
def test_article_without_the_rest(model, main, ad):
    assert model.extract(PAGE.format(main=main, ad=ad)) == TEXT


@pytest.mark.parametrize("inner", [AD, "<form><label>Your name</label><input><select><option>one<option>two</select><button>Send it to us</button></form>", '<div id="comments">' + "<p>one more says this</p>" * 30 + "</div>"])
def test_little_text_beside_a_jump_stays(model, inner):
    long, short = " ".join(["word"] * 40), "five words at the end"
    page = "<body><nav>Home</nav>%s<footer>All rights</footer></body>"
    assert model.extract(page % f"<h1>Title</h1><p>{long}</p>{inner}<p>{short}</p>") == f"Title\n\n{long}\n\n{short}"
    assert model.extract(page % f"<h1>Title</h1><p>{short}</p>{inner}<p>{long}</p>") == f"Title\n\n{short}\n\n{long}"


def site(g):
    """A maker of pages of one site: frames of its own class names, the same for all its pages."""
    say = lambda n: " ".join("".join(g.choice("abcdeilmnorst") for _ in range(g.randint(2, 8))) for _ in range(n))
    top, side, foot, ad = (f"{g.choice(['x', 'site', 'page'])}-{say(1)}" for _ in range(4))

    def page():
        blocks = [("h1", say(g.randint(2, 6)))] + [(g.choice(["p", "p", "p", "h2", "blockquote"]), say(g.randint(1, 60))) for _ in range(g.randint(2, 12))]
        inner = [f"<{t}>{x}</{t}>" for t, x in blocks]
        if g.random() < 0.2:  # in the label, though not in the text
            inner.insert(g.randint(1, len(inner)), f'<div class="{ad}">{say(g.randint(3, 30))}</div>')
        frame = f'<div class="{top}"><ul>' + "".join(f"<li><a href=/>{say(2)}</a></li>" for _ in range(g.randint(3, 9))) + "</ul></div>"
        after = f'<div id="{side}"><p>{say(g.randint(5, 60))}</p></div><div class="{foot}">{say(20)}</div><div class="{ad}">{say(g.randint(3, 30))}</div>'
        return f"<html><body>{frame}<article>{''.join(inner)}</article>{after}</body></html>", "\n\n".join(x for _, x in blocks)

    return page


def strip(page):
    return re.sub(r"</?(article|main)\b[^>]*>", "", page)


def test_held_out_pages_without_marks(monkeypatch):
    """Advert boxes stand outside of articles too, so all kinds can be learnt; no page is marked when it is read."""
    g = random.Random(3)
    page = site(g)
    learnt, held = [page() for _ in range(150)], [page() for _ in range(150)]
    model = H.fit_pages([p for p, _ in learnt])
    got = [model.extract(strip(p)) for p, _ in held]
    assert [model.extract(p) for p, _ in held] == got  # the mark has no part in it
    assert sum(t == want for t, (_, want) in zip(got, held)) >= 140
    monkeypatch.setattr(H.HtmlModel, "region", staticmethod(lambda scores, jumped: [(0, len(scores))]))
    assert all(model.extract(strip(p)) != want for p, want in held)


def test_region_is_the_best_of_all_contiguous_ones():
    g = random.Random(4)
    for _ in range(300):
        scores = [g.choice([-2.5, -1.1, -0.3, 0.0, 1.0, 2.0, 3.0]) for _ in range(g.randint(0, 12))]
        jumped = [x < 0 and g.random() < 0.3 for x in scores]
        pieces = H.HtmlModel.region(scores, jumped)
        taken = [k for lo, hi in pieces for k in range(lo, hi)]
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)], default=0)
        lo, hi = (taken[0], taken[-1] + 1) if taken else (0, 0)
        assert sum(scores[lo:hi]) == pytest.approx(max(best, 0)) and taken == [k for k in range(lo, hi) if not jumped[k]]


def brute(model, page):
    """The extraction written out: the region by trying all, the text by walking the items."""
    found, elements = H.read(page)
    roots = model.roots(elements)
    scores = model.scores(found, elements, roots)
    sums = [0.0, *itertools.accumulate(scores)]
    best, lo, hi = 0.0, 0, 0
    for j in range(len(scores) + 1):
        for i in range(j):
            if sums[j] - sums[i] > best + 1e-9:
                best, lo, hi = sums[j] - sums[i], i, j
    out = {}
    for x in found[lo:hi]:
        if roots[x.element] < 0 and not elements[x.element].no_text:
            out[x.block] = out.get(x.block, "") + (" " if x.tag == "br" else x.text if not x.tag else "")
    return "\n\n".join(t for t in (" ".join(html.unescape(v).split()) for v in out.values()) if t)


def test_extraction_is_the_brute_force_one(model):
    g = random.Random(5)
    parts = ["<p>", "</p>", "<div class='ad'>", "</div>", "<nav>", "</nav>", "<b>", "</b>", "<br>", "<i>", "some words ", "&amp; ", "a", "<form>", "</form>", "<!-- x -->", "<h1 title=it's>", "</h1>"]
    for _ in range(400):
        page = "".join(g.choice(parts) for _ in range(g.randint(0, 30)))
        assert model.extract(page) == brute(model, page)


def test_broken_and_long_pages(model):
    assert model.extract(None) == model.extract("") == model.extract("<p></p><!-- x") == ""
    assert model.extract("<article><p title=it's>one two</p><p>three's four</p></article>") == "one two\n\nthree's four"
    assert model.extract('<p title="a > b" class=x\'y>one</p><p id="open>two</p>') == "one\n\ntwo"
    assert model.extract("<p " + "a='" * 5000 + ">one") == "one"
    assert model.extract("<article><p>cut off in a <b") == "cut off in a"
    assert model.extract("<article><p>cut off in &amp") == "cut off in &"
    assert model.extract("no markup at all") == "no markup at all"
    long = "<article>" + "".join(f"<p>paragraph number {k} of the page</p>" for k in range(30000)) + "</article>"
    assert model.extract(long).count("\n\n") == 29999
    deep = "<article>" + "<div>" * 20000 + "text in the deep" + "</div>" * 20000
    assert model.extract(deep) == "text in the deep"
    assert H.fit_pages([]).extract("<p>no model, but words</p>") == "no model, but words"


def test_rows(spark):
    rows = [(1, "u", LABELLED, "x")] * 6 + [(2, None, None, "x"), (None, "v", "<p>just these words", None)] + [(k, "u", LABELLED, "x") for k in range(3, 9)]
    df = ship(spark).createDataFrame(rows, "page_id long, url string, html string, text string")
    model = H.fit(df)
    assert model == H.fit_pages([LABELLED] * 7)  # repeated rows count once
    got = sorted((tuple(r) for r in H.main_text(df, model).collect()), key=str)
    assert got == sorted([(k, "u", TEXT, len(TEXT)) for k in (1,) * 6 + (3, 4, 5, 6, 7, 8)] + [(2, None, "", 0), (None, "v", "just these words", 16)], key=str)
    assert H.main_text(df.limit(0), H.fit(df.limit(0))).count() == 0
