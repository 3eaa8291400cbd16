"""Pages whose article is known, in wrappers and beside noise of many kinds."""

import random
import time

import pytest
from corpusmill.llm import html_text
from corpusmill.llm.html_text import main_text

WRAPPERS = ('<div class="content has-sidebar">', '<div id="main" class="layout-with-sidebar">', '<div class="wrapper header-fixed">', '<div class="page-with-menu">', "<div>", '<section class="post-body">', '<main class="site-main">')
NOISE = (
    '<div class="sidebar"><p>Other things to read, said at length, with commas, and more.</p></div>',
    '<nav><a href="/">Home</a> <a href="/b">More</a></nav>',
    '<div class="comments"><article class="comment"><p>What a reader wrote, at great length, with many, many commas.</p></article></div>',
    '<aside>Aside</aside>',
    '<div class="ad-slot">Buy now</div>',
    '<div id="cookie-banner"><p>We use cookies, as all do.</p></div>',
    '<div class="site-footer">All the small print</div>',
    '<form><label>Search</label><input></form>',
    '<ul><li><a href="/1">One story</a></li><li><a href="/2">Another story</a></li></ul>',
    "<script>var x = '<p>no</p>';</script>",
)


def paragraph(rng):
    return "Word" + "".join(f" w{rng.randrange(99)}{',' if rng.random() < 0.1 else ''}" for _ in range(rng.randrange(8, 60))) + "."


@pytest.mark.parametrize("seed", range(30))
def test_the_article_and_nothing_else(seed):
    rng = random.Random(seed)
    blocks, inner = [], []
    for _ in range(rng.randrange(2, 5)):
        part = ["<section>"] if rng.random() < 0.5 else ['<div class="social-science">']
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(("p", "p", "p", "h3", "li"))
            text = paragraph(rng) if kind == "p" else f"Short {rng.randrange(99)}"
            blocks.append(text)
            part.append(f"<ul><li>{text}</li></ul>" if kind == "li" else f"<{kind}>{text}</{kind}>")
        inner.append("".join(part) + ("</section>" if part[0] == "<section>" else "</div>"))
    wrappers = [rng.choice(WRAPPERS) for _ in range(rng.randrange(0, 4))]
    noise = lambda: "".join(rng.choice(NOISE) for _ in range(rng.randrange(0, 4)))
    page = "<html><head><title>T</title></head><body>" + noise() + "".join(wrappers) + "<article>" + "".join(inner) + "</article>" + "".join(f"</{w[1:].split()[0].rstrip('>')}>" for w in reversed(wrappers)) + noise() + "</body></html>"
    assert main_text(page) == "\n".join(blocks)


def test_a_page_whose_names_are_all_noise_keeps_its_text():
    assert main_text('<div class="sidebar"><p>All there is on this page.</p></div>') == "All there is on this page."


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    assert main_text("<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000) == "deep"
    assert main_text("<p>x<span>" * 20_000).count("x") == 20_000
    assert len(main_text("<article>" + "<p>some words, here</p>" * 30_000 + "</article>").split("\n")) == 30_000
    assert time.time() - began < 20


def test_names_inside_an_article_take_no_headings_or_text():
    page = '<article><h1>T</h1><p>One, two, three and more of it.</p><div class="section-header"><h2>Second head</h2></div><p>More text, and more.</p><div class="post-footer">Tags: a, b</div><div class="ad-box">Buy</div><div class="comments">Nice</div></article>'
    assert html_text.main_text(page) == "T\nOne, two, three and more of it.\nSecond head\nMore text, and more.\nTags: a, b"


def test_a_form_around_the_page_is_a_wrapper():
    paragraphs = "".join(f"<p>Paragraph {i} says something, at some length.</p>" for i in range(5))
    want = "\n".join(f"Paragraph {i} says something, at some length." for i in range(5))
    assert html_text.main_text(f'<form id="aspnetForm"><div>{paragraphs}</div></form>') == want
    assert html_text.main_text(f'<form id="aspnetForm"><nav>Home</nav><div>{paragraphs}<form><label>Mail</label><p>Your address</p></form></div></form>') == want
    assert html_text.main_text(f"<div>{paragraphs}</div><form><p>Sign up</p><p>now</p></form>") == want
    assert html_text.main_text("<form><label>Name</label><p>Password</p></form>") == ""


def test_lists_of_links_stay_inside_an_article():
    links = '<ul><li><a href="#">Reference one</a></li><li><a href="#">Reference two</a></li></ul>'
    section = "<section>" + "<p>Some text, with commas, and with length enough to win.</p>" * 3 + "</section>"
    for inner in (section + links, section.replace("section", "div") + links):
        assert html_text.main_text(f"<body><ul><li><a>Menu</a></li></ul><article>{inner}</article></body>").endswith("Reference one\nReference two")
        assert "Menu" not in html_text.main_text(f"<body><ul><li><a>Menu</a></li></ul><article>{inner}</article></body>")


def simple(tree):
    """A second implementation over nested (name, kids): text of blocks in page order, without parts that are noise by their element."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    def visit(node):
        if isinstance(node, str):
            run.append(node)
            return
        name, kids = node
        if name in html_text.DROPPED:
            return
        if name in html_text.BLOCKS:
            flush()
        for k in kids:
            visit(k)
        if name in html_text.BLOCKS:
            flush()

    visit(tree)
    flush()
    return "\n".join(out)


def test_generated_articles_against_a_second_implementation():
    import random

    rng = random.Random(6)
    words = lambda n: " ".join(rng.choices(["one", "two,", "three", "four.", "é"], k=n))

    def node(depth):
        name = rng.choice(["p", "p", "div", "section", "ul", "h2", "nav", "script", "form", "figure", "blockquote", "table"] if depth else ["div"])
        if name in ("p", "h2"):
            return (name, [words(rng.randrange(1, 15)), ("b", [words(2)]), words(3), ("a", [words(1)])])
        if name == "ul":
            return (name, [("li", [words(4)]) for _ in range(3)])
        if name == "table":
            return (name, [("tr", [("td", [words(2)]), ("td", [words(2)])])])
        if name in ("nav", "script", "form"):
            return (name, [words(3)])
        return (name, [node(depth + 1) for _ in range(rng.randrange(1, 5))] if depth < 4 else [("p", [words(5)])])

    def html(x):
        return x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(html, x[1])) + f"</{x[0]}>"

    for _ in range(150):
        body = ("article", [("h1", [words(3)]), *(node(0) for _ in range(3)), ("p", [words(30)])])
        page = f"<html><head><title>t</title></head><body><nav>Menu</nav><div><a>x</a> <a>y</a></div>{html(body)}<footer>Imprint</footer></body></html>"
        assert html_text.main_text(page) == simple(body)
