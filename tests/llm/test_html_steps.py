"""Each step of the extraction against a plain version, and pages that are hard to take apart."""

from __future__ import annotations

import math
import random
import time
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings, strategies as st

from claimloom.llm import html_text
from claimloom.llm.html_text import main_text

LONG = "Long words of the article that go on and on, over many a line, until the paragraph comes to its end."


def lines_of(page: str):
    parser = html_text._Lines()
    parser.feed(page)
    parser.close()
    return parser


def random_page(seed: int) -> str:
    rng = random.Random(seed)

    def block(depth: int) -> str:
        kind = rng.choice(["p", "p", "p", "div", "section", "article", "ul", "table"]) if depth < 4 else "p"
        words = lambda n: " ".join(rng.choice(["alpha", "be", "gammas", "of"]) for _ in range(n))
        if kind == "p":
            return f"<p>{words(rng.randrange(40))} <a href=x>{words(rng.randrange(4))}</a> <b>{words(2)}</b>" + rng.choice(["</p>", ""])
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a>{words(2)}</a>" for _ in range(rng.randrange(1, 5))) + "</ul>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td>{words(rng.randrange(1, 9))}" for _ in range(3)) + "</table>"
        return f"<{kind}>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{kind}>"

    return "<body>" + "".join(block(0) for _ in range(6)) + "</body>"


def plain_ratios(parser) -> list[float]:
    lines, parent, kind = parser.lines, parser.parent, parser.kind

    def up(node):
        chain = [node]
        while node:
            node = parent[node]
            chain.append(node)
        return chain

    def inside(node, line):
        """Whether the line counts for the container as a whole."""
        chain = up(line[3])
        return node in chain and (kind[node] not in ("", "html", "body") or chain[0] == node)

    def whole(node):
        own = [x for x in lines if inside(node, x)]
        return sum(len(x[0]) - x[1] for x in own) / max(1, sum(x[2] for x in own))

    def article(node):
        return next((n for n in up(node)[::-1] if kind[n] in ("article", "main")), 0)

    def articles():
        own = [x for x in lines if article(x[3])]
        return sum(len(x[0]) - x[1] for x in own) / max(1, sum(x[2] for x in own))

    def around(node):
        """The ratio of the nearest container that is mostly prose of its own."""
        for n in up(node):
            if kind[n] in ("", "html", "body"):
                return 0.0
            prose = sum(len(x[0]) - x[1] for x in lines if x[3] == n and (len(x[0]) - x[1]) / x[2] >= html_text.PROSE)
            if prose and 2 * prose >= sum(len(x[0]) - x[1] for x in lines if inside(n, x)):
                return whole(n)

    out = []
    for i, line in enumerate(lines):
        mine = [x for x in lines if x[3] == line[3]]
        menu = 2 * sum(x[1] for x in mine) > sum(len(x[0]) for x in mine) and sum(len(x[0]) for x in mine) <= html_text.LABEL * len(mine)
        weights = [(math.exp(-((i - j) ** 2) / 2), (len(x[0]) - x[1]) / x[2]) for j, x in enumerate(lines) if abs(i - j) <= 2 and article(x[3]) == article(line[3])]
        own = [x for x in lines if inside(line[3], x)]
        if 2 * sum(x[1] for x in own) > sum(len(x[0]) for x in own) and 2 * line[1] > len(line[0]) and (menu or not article(line[3])):
            out.append(whole(line[3]))
        else:
            out.append(max([sum(w * v for w, v in weights) / sum(w for w, _ in weights), whole(line[3]), around(line[3])] + ([articles()] if article(line[3]) else [])))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_ratios_and_choice_like_a_plain_version(seed):
    parser = lines_of(random_page(seed))
    got = html_text.line_ratios(parser.lines, parser.parent, parser.kind)
    want = plain_ratios(parser)
    assert got == pytest.approx(want)
    logs = [math.log(1 + min(r, html_text.PROSE)) for r in want]
    low, high = min(logs), max(logs)
    for _ in range(100):  # each to its nearer mean
        near = [x for x in logs if 2 * x < low + high], [x for x in logs if 2 * x >= low + high]
        if not near[0]:
            low = high = 0.0
            break
        low, high = (sum(x) / len(x) for x in near)
    marks = [high - low < math.log(html_text.APART) or 2 * x >= low + high for x in logs]
    assert main_text(random_page(seed)) == "\n".join(line[0] for line, m in zip(parser.lines, marks, strict=True) if m)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>t</title><body><p>{LONG}</p></body></html>", LONG),  # no </head>
        (f"<html><head><meta charset=utf-8>{LONG}", LONG),
        (f"<body><form action=x><div><p>{LONG}</p><p>{LONG}</p><input></div></form></body>", f"{LONG}\n{LONG}"),  # a form around the page
        (f"<article><p>{LONG}</article><article><p>Two of them.</article>", f"{LONG}\nTwo of them."),
        (f"<article><p>{LONG}<p class='legal-history'>A history of law.<ul><li><a href=1>Home</a><li><a href=2>About</a></ul><p>Short.</article>", f"{LONG}\nA history of law.\nShort."),
        (f"<p>{'<i>' * 30}deep{'</i>' * 30} text<p>next", "deep text\nnext"),
        (f"<article><p>{'<b>' * 30}{LONG}<p>next</article>", f"{LONG}\nnext"),
        (f"<div class='ad'>{LONG} {LONG}</div><article><p>Short one.</article>", "Short one."),
        (f"<ul><li><p>{LONG}<li>{LONG}</ul>", f"{LONG}\n{LONG}"),
        (f"<div class='commentList'><p>{LONG}</div><main>{LONG}<nav>a</nav></main></div></div>", LONG),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p></article><header>Site</header>", f"Head\n{LONG}"),
        ("</p></div>stray", "stray"),
        ("<p>a</p><![foo[bar]]><p>b</p><!foo><![CDATA[x]]><?php echo ?><!-->c<!--->d", "a\nb\ncd"),
        ("<p>one</p></><!-- two --!>three<script>x</script foo>four</ p>", "one\nthreefour"),
        (f"<p>{LONG}</p><a <a <a ", LONG),
        (f"<p>{LONG}</p><!-- cut off <p>{LONG}", LONG),
        (f"<body><div><p>{LONG}<p>{LONG}<ul><li>one<li>two<li>three<li>four</ul><table><tr><td>a<td>b<tr><td>c<td>d</table><p>{LONG}</div><div><ul><li><a>Home</a><li><a>About</a></ul></div>", f"{LONG}\n{LONG}\none\ntwo\nthree\nfour\na\nb\nc\nd\n{LONG}"),
        (f"<article><p>{LONG}<ul><li><a href=1>The first of the works that this text refers to</a><li><a href=2>Another work, by other hands</a></ul></article>", f"{LONG}\nThe first of the works that this text refers to\nAnother work, by other hands"),
    ],
)
def test_omitted_tags_and_wrappers(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "".join(f"<div>line {i} of it" for i in range(20_000)), "<p>" + "<b>" * 20_000 + "x" + "</i>" * 20_000, "<div class=ad>x" * 20_000, "<ul><li>x" * 10_000, "</div>" * 20_000 + "<a>x" * 20_000, "<a <a " * 100_000, "<a b='>" * 50_000, "<a b=' " * 100_000, "<!-- " * 100_000, "<![x " * 100_000, "</a " * 100_000, "<script>" * 50_000, "&amp" * 100_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 2


@given(st.lists(st.sampled_from(["<", ">", "/", "!", "-", "--", "[", "]", "?", "=", "'", '"', " ", "\n", "&", ";", "#", "&amp;", "&#0;", "a", "p", "div", "script", "<p>", "</p>", "<div class=ad>", "<!--", "-->", "<![", "\x00", "é"]), max_size=60).map("".join))
@settings(max_examples=500, deadline=None)
def test_any_page_gives_text(page):
    text = main_text(page)
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n")) and main_text(page) == text


@given(st.binary(max_size=300), st.integers(1, 3000))
@settings(max_examples=30, deadline=None)
def test_random_bytes_take_linear_time(raw, n):
    page = (raw.decode("latin-1") or "<") * n
    page = (page * (1 + 1_000_000 // len(page)))[:1_000_000]
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


BLOCKS = ("p", "div", "section", "article", "ul", "li", "table", "tr", "td")


def random_tree(seed: int) -> str:
    """A page with every tag closed, which a parser of XML reads as well."""
    rng = random.Random(seed)
    words = lambda: " ".join(rng.choice(["alpha", "be&amp;e", "gammas\n", "&lt;of"]) for _ in range(rng.randrange(5)))

    def inner(tag: str, depth: int) -> str:
        if tag == "p" or depth > 4:
            return words() + f"<a>{words()}</a>" * rng.randrange(2) + f" <b>{words()}</b>" * rng.randrange(2) + words()
        under = {"ul": ["li"], "table": ["tr"], "tr": ["td"]}.get(tag, ["p", "div", "section", "ul", "table"])
        return "".join((words() if tag not in ("ul", "table", "tr") else "") + f"<{t}>{inner(t, depth + 1)}</{t}>" for t in rng.choices(under, k=rng.randrange(4)))

    return f"<body>{inner('div', 0)}</body>"


@pytest.mark.parametrize("seed", range(60))
def test_lines_like_a_parser_of_xml(seed):
    page, out, held = random_tree(seed), [], []

    def end():
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            out.append((text, min(sum(len(t.strip()) for t, linked in held if linked), len(text))))
        held.clear()

    def walk(node, linked):
        block = node.tag not in ("a", "b")
        if block:
            end()
        held.append((node.text or "", linked or node.tag == "a"))
        for child in node:
            walk(child, linked or node.tag == "a")
            held.append((child.tail or "", linked or node.tag == "a"))
        if block:
            end()

    walk(ElementTree.fromstring(page), False)
    assert [(text, in_links) for text, in_links, *_ in lines_of(page).lines] == out


def test_no_pages_and_clashing_names(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.with_main_text(empty, ["page_id", "text", "n_chars"])
    assert got.columns == ["page_id", "text", "n_chars"] and got.collect() == []
