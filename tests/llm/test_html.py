import random

import pytest

from tessel.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make this long enough to be text.</p></div>
%s<div class="ad">Buy this thing now, it is the best thing that you can buy.</div><form><p>Name and address and much more <input></p></form>
<section id="comments"><p>A reader comment that is long enough to be main text by its length alone.</p></section><aside><p>Aside text that is long, too, and goes on for a while.</p></aside><footer>&copy; foot &middot; text</footer></body></html>"""
SENTENCE = "Paragraph %s has a good number of words in it, as the text of an article does."


def test_article_is_kept_whole():
    body = "<article><h1>Head &amp; line</h1><p><b>Bold</b> first\n paragraph &lt;x&gt; &#233;&nbsp;y.<br>After break</p><p>Short.</p><script>no()</script><p>Last <i>one</i> <!-- no --> here.</article>"
    assert html_text.extract(PAGE % body) == "Head & line Bold first paragraph <x> é y. After break Short. Last one here."


def test_without_an_article_density_decides():
    body = "<div id='main'>" + "".join(f"<p>{SENTENCE % i}</p>" for i in range(6)) + "</div>"
    text = html_text.extract(PAGE % body)
    assert text.startswith("Paragraph 0") and text.endswith("article does.") and "comment" not in text and "cookies" not in text and "Buy" not in text


BARE = """<html><body><div><div><div>My site</div></div></div><div><div><span><a href=1>One</a> <a href=2>Two</a></span></div></div>
<div><div><div><div>Title</div>%s<div>End.</div></div></div></div><div><div><div>by the site</div></div></div></body></html>"""


def test_tags_without_meaning():
    """Nothing but div and span: the sums alone part the text from what lies around it."""
    body = "".join(f"<p>{SENTENCE % i}</p>" for i in range(4))
    assert html_text.extract(BARE % body) == " ".join(["Title", *[SENTENCE % i for i in range(4)], "End."])


def test_the_window_decides(monkeypatch):
    """A short paragraph beyond a gap of four lines belongs to the text if a window bridges it."""
    page = "<body><p>" + SENTENCE % 1 + "</p><p>" + SENTENCE % 2 + "</p></div><div></div><div><p>Tail.</p></body>"
    assert html_text.extract(page).endswith("article does.")
    monkeypatch.setattr(html_text, "WINDOW", 5)
    assert html_text.extract(page).endswith("Tail.")
    monkeypatch.setattr(html_text, "WINDOW", 1)
    text = html_text.extract("<body><p>" + SENTENCE % 1 + "</p><div><p>Tail.</p></div></body>")
    assert "Tail" not in text


def test_a_mark_tips_the_scale_only():
    """Text outside of the article stays if it surges by itself; a teaser does not."""
    article, teaser = f"<article><h1>Short</h1><p>{SENTENCE % 1}</p></article>", "<article><h2><a href=x>More</a></h2></article>"
    long = "<div>" + "".join(f"<p>{SENTENCE % i}</p>" for i in range(8)) + "</div>"
    assert html_text.extract(f"<body>{article}<div>Buy this now.</div></body>") == "Short " + SENTENCE % 1
    assert html_text.extract(f"<body>{article}{long}</body>").startswith("Short " + SENTENCE % 1 + " Paragraph 0")
    assert "More" not in html_text.extract(f"<body><article>{''.join(f'<p>{SENTENCE % i}</p>' for i in range(3))}</article>{teaser}</body>")
    assert html_text.extract(f"<main><article><p>{SENTENCE % 1}</p><article><p>{SENTENCE % 2}</p></article></article><div><p>I agree.</p></div></main>") == SENTENCE % 1


@pytest.mark.parametrize("kept", ["side-by-side", "form", "notice-board", "search-theory", "shared-history", "addition", "headers", "postscript"])
def test_names_of_main_text(kept):
    assert html_text.extract(f"<article><p>{SENTENCE % 1}</p><div class='{kept}'><p>{SENTENCE % 2}</p></div></article>").endswith(SENTENCE % 2)


@pytest.mark.parametrize("gone", ["ad", "ad-slot-3", "sidebar", "right_sidebar", "site-header", "cookieBanner", "newsletter-form", "comments", "comment-list", "x y related"])
def test_names_beside_main_text(gone):
    assert html_text.extract(f"<article><p>{SENTENCE % 1}</p><div class='{gone}'><p>{SENTENCE % 2}</p></div></article>") == SENTENCE % 1


LONG = " ".join(SENTENCE % i for i in range(4))


@pytest.mark.parametrize("body, short", [
    ("<section><div><p>%s</p></div></section><section><div><p>Short end.</p></div></section>", "Short end."),
    ("<p>%s</p><figure><img></figure><div><div><p>By a writer</p></div></div><figure><img></figure><p>Goes on.</p>", "By a writer"),
    ("<div><section><div><p>Before.</p></div></section></div><div><section><div><p>%s</p></div></section></div>", "Before."),
    ("<div><div><div><div><p>%s</p></div></div></div></div><div><div><div><div><table><tr><td>Cell</td></tr></table></div></div></div></div>", "Cell"),
])
def test_an_article_loses_no_short_block(body, short):
    text = html_text.extract(PAGE % f"<article>{body % LONG}</article>")
    assert short in text and SENTENCE % 0 in text and SENTENCE % 3 in text and "cookies" not in text


@pytest.mark.parametrize("remarks", [
    "<h3>Comments</h3><div><p>%s</p></div><div><p>%s</p></div>", "<div><h3>3 Comments</h3></div><div><p>%s</p><p>%s</p></div>", "<section><h2>Reader comments</h2><p>%s</p><p>%s</p></section>",
])
def test_what_a_heading_of_comments_heads_goes(remarks):
    remark = "I read this and I do not agree with a word of it. " * 30
    page = f"<body><main><div><p>{LONG}</p></div>{remarks % (remark, remark)}</main></body>"
    assert html_text.extract(page) == LONG
    assert html_text.extract(f"<body><main><h2>Comments on the law</h2><p>{LONG}</p></main></body>").endswith(LONG)


def test_lists_of_stories_go():
    assert html_text.extract(f"<main><div><p>{LONG}</p></div><div class='related-stories'><p>{LONG} {LONG}</p></div></main>") == LONG


def plain(lines):
    """By the definition: text lines between two dives, if a sum that no dive cuts surges, or one of the same article."""
    mark = max((x.mark for x in lines if x.text), default=0)
    w = [(2 * len(x.text) if x.mark == mark else 0.5 * (len(x.text) - x.linked)) if mark else len(x.text) - x.linked for x in lines]
    n, k = len(w), html_text.WINDOW
    level = min(80, max([sum(w[i : i + k]) for i in range(n)], default=0) / 3)
    weighty = [i for i in range(n) if w[i]]
    parts = []
    for i in weighty:
        if parts and all(any(w[a : a + k]) for a in range(parts[-1][-1] + 1, i - k + 1)):
            parts[-1].append(i)
        else:
            parts.append([i])
    high = [max(sum(w[i : i + k]) for i in range(p[0], p[-1] + 1)) >= level for p in parts]
    articles = {x.article for p, h in zip(parts, high) if h for x in lines[p[0] : p[-1] + 1] if x.article}
    return [x.text for p, h in zip(parts, high) for x in lines[p[0] : p[-1] + 1] if x.text and (h or x.article in articles)]


def test_equals_the_definition():
    rng, cut = random.Random(4), 0
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
    for _ in range(500):
        parts, stack = [], []
        for _ in range(rng.randrange(5, 60)):
            tag = rng.choice(["p", "p", "p", "p", "div", "div", "section", "article", "main", "a", "span", "nav", "li", "ul", "h2"])
            if rng.random() < 0.45 and stack:
                parts.append(f"</{stack.pop()}>")
            else:
                stack.append(tag)
                parts.append(f"<{tag}>" + " ".join(word() for _ in range(rng.choice([0, 1, 1, 3, 12]))))
        lines = html_text.lines_of("".join(parts))
        assert html_text.main_lines(lines) == plain(lines)
        cut += len(plain(lines)) < sum(x.text != "" for x in lines)
    assert 100 < cut < 450


def test_broken_markup():
    for page in (None, "", "plain words only", "<p>open", "<<<>>>", "<a title=\"x>y", "<!-- open", "<script>open", "a < b and c > d", "<p>" * 5000, "x" * 100_000, "<div class='\n", "</p></div>"):
        assert isinstance(html_text.extract(page), str)
    assert html_text.extract("plain words only") == "plain words only"
    assert html_text.extract("<p>a < b and c &gt; d</p>") == "a < b and c > d"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "v", PAGE % "<article><p>Text.</p></article>", "y"), (2, "v", PAGE % "<article><p>Text.</p></article>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.url, r.text) for r in html_text.main_text(df).collect()) == [(1, "u", ""), (2, "v", "Text."), (2, "v", "Text.")]
    assert html_text.main_text(df.limit(0)).count() == 0
