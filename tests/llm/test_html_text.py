"""Pages whose markup must not cost their text."""

import random

import pytest

from pointweave.llm.html_text import Line, main_text, span, weights


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body class='has-sidebar'><p>kept</p></body>", "kept"),
        ("<body class='sidebar'><p>kept</p></body>", "kept"),
        ("<article class='post comments-open'><p>kept</p></article>", "kept"),
        ("<main class='share'><p>kept</p></main>", "kept"),
        ("<div class='content-with-sidebar'><p>kept</p></div>", "kept"),
        ("<p>a</p><svg/><p>b</p><math /><p>c</p>", "a b c"),
        ("<p>a</p><button>x<p>b</p>", "a x b"),
        ("<div><select><option>x</div><p>b</p>", "b"),
        ("<div><object>x</div><p>b</p>", "x b"),
        ("<p class=ad>buy<p>kept<p>too", "kept too"),
        ("<p class=ad>buy<br>more</p>kept", "kept"),
        ("<p class=ad>buy<div>kept</div>", "kept"),
        ("<ul><li class=share>share<li>kept<li>too</ul>", "kept too"),
        ("<ul><li class=share>share<ul><li>inner</ul><li>kept</ul>", "kept"),
        ("<table><tr><td class=ad>buy<td>kept<tr><td>too</table>", "kept too"),
        ("<table><tr><td class=ad>buy<table><tr><td>inner</table><td>kept</table>", "kept"),
        ("<dl><dt class=ad>buy<dd>kept<dt>too</dl>", "kept too"),
        ("<p>a <select><option>x</select> b</p>", "a b"),
        ("<p>a</p><svg><text>x</text></svg><p>b</p>", "a b"),
        ("<div class='ad'>buy</div><p>kept</p>", "kept"),
        ("<html class='no-js cookie-ok'><p>kept</p></html>", "kept"),
        ("<article><section id='search-algorithms'><p>kept</p></section></article>", "kept"),
        ("<p>a</p><span class=ad>Buy <span>now</span> cheap</span><p>b</p>", "a b"),
        ("<p>a <b class=ad>x<b>y</b>z</b> b <b>c</b></p>", "a b c"),
        ("<nav><a href=x>menu</a><p>kept</p>", "kept"),
        ("<div class=ad><p>kept</p>", "kept"),
        ("<p title=\"abc>kept</p>", "kept"),
        ("<article class=teaser><p>read on</p></article><div><p>" + "body " * 30 + "</p></div>", "read on " + ("body " * 30).strip()),
        ("<p hidden>no</p><p>kept</p><div style='color: red; display:none'>no</div><p title='a hidden thing'>too</p>", "kept too"),
        ("<p><a href=x>all of it a link</a></p>", "all of it a link"),
        ("<body style='display: none'><p>kept</p></body>", "kept"),
    ],
)
def test_markup(page, text):
    assert main_text(page) == text


def test_text_after_a_list_of_links_stays():
    links = "<ul>" + "<li><a href=x>related</a></li>" * 3 + "</ul>"
    page = f"<div><p>{'first ' * 100}</p>{links}<p>{'later ' * 40}</p></div>"
    assert main_text(page) == ("first " * 100 + "later " * 40).strip()


STRAY = "<p>Home</p>" + "<nav><p>menu</p></nav>" * 4 + "<p>" + "body " * 20 + "</p><p>end.</p>" + "<div class=ad>buy</div>" * 4 + "<p>Top</p>"


def test_the_window_decides():
    body = "body " * 20 + "end."
    assert main_text(STRAY) == body
    assert main_text(STRAY, window=8) == f"Home {body} Top"
    assert main_text(STRAY, surge=1) == f"Home {body} Top"
    inside = f"<article>{STRAY}</article>"
    assert main_text(inside) == body and main_text(inside, window=8) == f"Home {body} Top"


def brute_span(sizes, window, surge):
    """Lines near text, by every window in turn."""
    n = len(sizes)
    sums = {at: sum(sizes[max(0, at) : at + window]) for at in range(1 - window, n)}
    runs, run = [], []
    for at in sorted(sums):
        if sums[at]:
            run.append(at)
        elif run:
            runs.append(run)
            run = []
    runs += [run] if run else []
    kept = [r for r in runs if max(sums[at] for at in r) >= surge] or runs
    return (kept[0][0] + window - 1, kept[-1][-1] + 1) if kept else (0, 0)


def test_spans_against_every_window():
    import numpy as np

    rng = random.Random(6)
    for _ in range(400):
        sizes = [rng.choice([0, 0, 0, 1, 5, 30]) for _ in range(rng.randint(1, 30))]
        window, surge = rng.randint(1, 6), rng.choice([1, 6, 20])
        assert span(np.array(sizes), window, surge) == brute_span(sizes, window, surge)


def test_weights():
    page = [Line("x" * 9, 9, False, False), Line("y" * 3, 0, False, True), Line("z" * 20, 0, True, False), Line("w" * 12, 0, False, False)]
    assert weights(page).tolist() == [0, 3, 0, 0]
    assert weights([*page, Line("v", 0, False, False)]).tolist() == [0, 3, 0, 12, 1]
