"""Line-block distribution: pages without an article, marks that are none, and an independent version of surge and dive."""

import random
import time

import pytest

from lodestar.llm import html_text as H

LONG = "This is a long paragraph of running text that has no link in it at all and goes on for a while."


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><p>{LONG}</p><aside>side</aside><p>{LONG} B</p></div>", f"{LONG}\n\n{LONG} B"),
    (f"<div><h1>T</h1><p>{LONG}</p><nav><a href=x>Menu</a></nav><p>End.</p></div>", None),
    (f"<div><h1><a href=x>Linked title</a></h1><p>{LONG}</p><p><a href=y>{LONG}</a></p></div>", f"Linked title\n\n{LONG}\n\n{LONG}"),
    (f"<div><p class='notice-board'>{LONG}</p><div class='social-history'>{LONG} two</div><p data-x=hidden>Three</p></div>", f"{LONG}\n\n{LONG} two\n\nThree"),
    (f"<article><p class='notice-board'>{LONG}</p><div class='social-history'>{LONG} two</div><p data-x=hidden>Three</p></article>", f"{LONG}\n\n{LONG} two\n\nThree"),
    (f"<div><p>{LONG}</p><p style='display: none'>unseen {LONG}</p><p hidden>unseen {LONG}</p></div>", LONG),
    (f"<article><p>{LONG}</p></article><ol class='commentlist'><li>{LONG} reader</li></ol><div class=discussion><p>{LONG} reader</p></div>", LONG),
    (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>A teaser of another one</p></article>", "\n\n".join([LONG] * 3)),
    (f"<div><p title='<script>'>{LONG}</p><p title=\"a > b\">Two</p></div>", f"{LONG}\n\nTwo"),
    (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}</p><ul><li><a href=3>Three</a></li></ul></div>", LONG),
    (f"<main><ul><li><a href=1>One</a><li>Two</ul><p>{LONG}</main><div>Follow us</div>", f"One\n\nTwo\n\n{LONG}"),
    (f"<body><div class='site-footer'>imprint {LONG}</div><div id=content><p>{LONG}</p></div><script>var a='<p>no</p>'</script>", LONG),
    (f"<div><p>{LONG}<div class='cookie-notice'><b>we use cookies {LONG}</div><p>After.</div>", None),
])
def test_pages(page, text):
    got = H.main_text(page)
    if text is None:
        assert LONG in got and "cookies" not in got and "Menu" not in got
    else:
        assert got == text


def test_windows_decide_within_a_page_without_an_article():
    """A lone short line far from the running text is left out; the same line next to it stays."""
    blocks = "".join(f"<p>{LONG}</p>" for _ in range(4))
    far = f"<div>ok</div><div><a href=x>a</a></div><div><a href=x>b</a></div><div><a href=x>c</a></div><div>{blocks}<div>ok</div></div>"
    assert H.main_text(far) == "\n\n".join([LONG] * 4 + ["ok"])


def test_windows_decide_within_an_article(monkeypatch):
    """A line of two letters stays because of its neighbours in the window, and by itself it is too light."""
    page = f"<article><p>{LONG}</p>" + "<p>ab</p>" * 6 + f"<p>{LONG}</p></article>"
    assert H.main_text(page) == "\n\n".join([LONG, *["ab"] * 6, LONG])
    monkeypatch.setattr(H, "WINDOW", 1)
    assert H.main_text(page) == "\n\n".join([LONG, LONG])


def test_short_ends_of_a_page_without_an_article_stay():
    page = f"<h1>Title</h1><p>Hi.</p><p>Yes.</p>{LONG}<p>No.</p><p>Ok.</p><p>End.</p><p>Bye.</p><div><a href=x>Next</a></div><p>Far.</p>"
    assert H.main_text(page) == "\n\n".join(["Title", "Hi.", "Yes.", LONG, "No.", "Ok.", "End.", "Bye."])


def test_what_stands_beside_an_article_goes():
    """Menus inside go, short lines outside go, and so does a reader's remark of some hundred letters in a nameless box."""
    menu = "<ul>" + "".join(f"<li><a href={i}>Entry number {i} of the menu</a></li>" for i in range(60)) + "</ul>"
    page = f"<div>Short line</div><article><h1>T</h1><nav>{menu}</nav><p>{LONG}</p><p>Ok.</p></article><div>Another</div><div class=x9><p>{LONG * 6}</p></div>"
    assert H.main_text(page) == "\n\n".join(["T", LONG, "Ok."])


@pytest.mark.parametrize("piece", ["<p ", "<!", '<p "', "<p '\"", "<a b='", '<p ">', "<p a=\">'", "</p ", "<![CDATA[", "<!-- "])
def test_a_megabyte_of_broken_tags(piece):
    """The scan goes forward only: four times the page takes about four times the time, and seconds at most."""
    began = time.perf_counter()
    H.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(("page", "text"), [
    (f"<p>{LONG}</p><p class=\"x>Lost quote {LONG}</p><p>Then {LONG}</p>", f"{LONG}\n\nLost quote {LONG}\n\nThen {LONG}"),
    (f"<p>{LONG} a < b and c <3", f"{LONG} a < b and c <3"), (f"<p>{LONG}<p unclosed", f"{LONG}<p unclosed"), (f"<p>{LONG}<!-- {LONG}", LONG),
])
def test_broken_ends(page, text):
    assert H.main_text(page) == text


def _reference(weights):
    """Lines of the text, by marking every window over the threshold and filling between its heavy lines."""
    n, w = len(weights), H.WINDOW
    sums = {i: sum(weights[j] for j in range(i, i + w) if j < n) for i in range(n)}
    top = max(sums.values(), default=0)
    level = min(H.PEAK_SHARE * top, H.CEILING)
    kept, run = set(), []
    for i in range(n + 1):
        if i < n and top and sums[i] >= level:
            run.append(i)
        elif run:
            heavy = [j for k in run for j in range(k, min(k + w, n)) if weights[j] > 0]
            kept |= set(range(min(heavy), max(heavy) + 1))
            run = []
    return sorted(kept)


def test_passages_equal_a_reference_version():
    rng = random.Random(4)
    for _ in range(3000):
        weights = [rng.choice([0, 0, 0, 1, 5, 12, 40, 300, 1000]) * 1.0 for _ in range(rng.randrange(0, 25))]
        got = sorted({i for a, b in H.passages(weights) for i in range(a, b + 1)})
        assert got == _reference(weights), weights
        assert all(a <= b for a, b in H.passages(weights))


def test_deep_and_broken_pages_end():
    assert H.main_text("<div>" * 20_000 + LONG) == LONG
    assert H.main_text("</p>" * 20_000 + LONG + "<b>" * 20_000 + "</i>" * 20_000) == LONG
    assert H.main_text("<p>" + "word " * 400_000) == ("word " * 400_000).strip()


def test_columns_and_nulls(spark):
    rows = [(1, None, f"<p>{LONG}</p>", "t", 5), (None, "u", None, None, None), (2, "u", "", "t", 1), (2, "u", "", "t", 1)]
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, LONG, len(LONG)), (2, "", 0), (2, "", 0)]
