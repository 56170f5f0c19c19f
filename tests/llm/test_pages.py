"""Main text with scripts, buttons and adverts inside the article, and wrappers named like boilerplate."""

from __future__ import annotations

import html as escapes
import random

import pytest

from barlake.llm import html

ONE = "The first paragraph tells at some length what the harbour looked like when the ferries still came in the morning."
TWO = "The second paragraph goes on about the weather, the price of fish and the people who waited for both of them."
NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
END = '<footer><p>Copyright, all rights reserved by the publisher of these pages.</p></footer>'


def page(inner):
    return f"<html><head><title>t</title></head><body>{NAV}{inner}{END}</body></html>"


@pytest.mark.parametrize("junk", [
    "<script>var t = 1; track(0);</script>", "<style>.a { color: red }</style>", "<noscript>Please enable scripts.</noscript>", "<button>Buy now!</button>",
    "<template><p>Template text.</p></template>", "<svg><text>Chart label</text></svg>", "<iframe>frame</iframe>", "<select><option>One<option>Two</select>",
    "<form><input><label>Your name</label></form>", '<div class="ad">Buy now, only today!</div>', '<aside><p>Read our other stories on the harbour.</p></aside>',
    '<div class="comments"><p>First comment by a reader who liked all of it.</p></div>', '<article class="comment"><p>A reader has written this reply.</p></article>',
    '<object>No plug-in</object>',
])
@pytest.mark.parametrize("marked", [True, False])
def test_junk_between_paragraphs(junk, marked):
    inner = f"<p>{ONE}</p>{junk}<p>{TWO}</p>"
    assert html.main_text(page(f"<article>{inner}</article>" if marked else f"<div>{inner}</div>")) == f"{ONE}\n{TWO}"


@pytest.mark.parametrize("junk", ['<span class="ad">Buy now!</span>', "<script>x()</script>", "<button>Share</button>", "<style>a{}</style>"])
def test_junk_inside_a_sentence(junk):
    left, right = ONE.split(" at some ")
    assert html.main_text(page(f"<article><p>{left} at {junk}some {right}</p><p>{TWO}</p></article>")) == f"{ONE}\n{TWO}"


@pytest.mark.parametrize("wrapper", ['form id="aspnet"', 'div class="page with-sidebar"', 'div class="search-page"', 'div class="page comments-open"'])
@pytest.mark.parametrize("region", ["article", "main", 'div role="main"'])
def test_wrappers_do_not_empty_the_page(wrapper, region):
    tag, own = wrapper.split()[0], region.split()[0]
    inner = f"<{region}><p>{ONE}</p><p>{TWO}</p></{own}>"
    assert html.main_text(page(f"<{wrapper}><div class=\"sidebar\"><p>Most read this week: the ferries.</p></div>{inner}</{tag}>")) == f"{ONE}\n{TWO}"


def test_articles_of_sidebars_stay_out():
    teasers = '<aside><article><p>A teaser of another story that is long enough to look like text.</p></article></aside>'
    assert html.main_text(page(f"<article><p>{ONE}</p><p>{TWO}</p></article>{teasers}")) == f"{ONE}\n{TWO}"
    teasers = f'<div class="related">{teasers}<article><p>Another teaser that is long enough to look like text.</p></article></div>'
    assert html.main_text(page(f"<main><p>{ONE}</p><p>{TWO}</p></main>{teasers}")) == f"{ONE}\n{TWO}"


def test_linked_sentence_stays():
    linked = '<p><a href="/r">See the full report.</a></p>'
    assert html.main_text(page(f"<article><p>{ONE}</p>{linked}<p>{TWO}</p></article>")) == f"{ONE}\nSee the full report.\n{TWO}"


def test_generated_pages():
    """Whole pages put together from known content and known junk: exactly the content comes back."""
    r = random.Random(11)
    words = "harbour ferry morning price weather waited people looked fish boat & <tide> “quoted” naïve".split()
    junk = ["<script>a<b && c</script>", '<div class="share">Share this</div>', "<style>p{}</style>", "<button>More</button>", '<div class="ads"><p>Only today: half price.</p></div>',
            '<div class="newsletter"><form><label>Mail</label></form></div>', "<!-- remark -->", '<section id="comments"><p>I liked this one a lot, thanks.</p></section>']
    for _ in range(200):
        content, parts = [], []
        for _ in range(r.randrange(2, 9)):
            text = " ".join(r.choice(words) for _ in range(r.randrange(12, 60))) + "."
            content.append(text)
            cut = r.randrange(1, len(text.split()))
            left, right = " ".join(text.split()[:cut]), " ".join(text.split()[cut:])
            middle = r.choice([" ", "\n   ", " <b></b>", " <script>z()</script>", '<span class="advert">Ad</span> '])
            parts.append(f"<p>{escapes.escape(left)}{middle}{escapes.escape(right)}</p>" + (r.choice(junk) if r.random() < 0.5 else ""))
        assert html.main_text(page(f"<article>{''.join(parts)}</article>")).split("\n") == content


def test_deep_and_broken_pages_are_linear():
    assert html.main_text(page("<div>" * 50_000 + f"<article><p>{ONE}</p></article>")) == ONE
    assert html.main_text(page(f"<article><p>{ONE}</p>" + "</b></i></nav>" * 30_000 + f"<p>{TWO}</p></article>")) == f"{ONE}\n{TWO}"
