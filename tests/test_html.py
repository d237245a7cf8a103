"""Selectors over pages: nested, unclosed and stray tags by hand, and trees made at random against a search from the root."""

import random
import time

import pytest

from marlstone.operators import extract, html


def found(page, selector):
    chains = html.parse_selector(selector)
    seen, out = set(), []
    for _, number, _, _, text in html.find_elements(page, chains):
        if number not in seen:
            seen.add(number)
            out.append(text)
    return out


@pytest.mark.parametrize(
    ("page", "selector", "texts"),
    [
        ("<p>a<p>b<div>c</p>d</div>", "p", ["a", "b"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "ul > li", ["a", "b c", "c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li li", ["c"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>after", "tr", ["1 2", "3"]),
        ("<div class='x y' id=m><b>t</b></div><div class=y>u</div>", "div.x.y#m > b, div.y", ["t", "t", "u"]),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", "p", ["yes"]),
        ("<pre>a &lt; b\n  c</pre></pre></div><pre>&amp;d</pre>", "pre", ["a < b c", "&d"]),
        ("<a href='/x'>1</a><a>2</a><a HREF=/y>3</a>", "a[href]", ["1", "3"]),
        ("<a href='/x'>1</a><a href=/y>3</a>", "a[href='/y']", ["3"]),
        ("<div><section><p>1</p></section><p>2</p></div>", "div > p", ["2"]),
        ("<p>x<br>y<img src=a>z", "p", ["x y z"]),
        ("<b>open <i>both", "*", ["open both", "both"]),
        ("", "p", []),
        ("no tags < here & there", "p", []),
    ],
)
def test_by_hand(page, selector, texts):
    assert found(page, selector) == texts


@pytest.mark.parametrize("bad", ["", "p,", "> p", "p >", "p ~ q", "p:first"])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError):
        html.parse_selector(bad)


def test_random_trees_equal_a_search_from_the_root():
    rnd = random.Random(3)

    def tree(depth):
        node = {"tag": rnd.choice(["div", "span", "em"]), "class": rnd.choice(["", "x", "y", "x y"]), "kids": []}
        for _ in range(rnd.randint(0, 3) if depth else 0):
            node["kids"].append(tree(depth - 1))
        return node

    def write(n):
        return f"<{n['tag']} class='{n['class']}'>t{id(n)} {''.join(map(write, n['kids']))}</{n['tag']}>"

    def text(n):
        return " ".join([f"t{id(n)}", *(text(k) for k in n["kids"])])

    def met(path, chain):
        tag, _, cls = chain[-1][1].partition(".")
        if tag not in ("*", path[-1]["tag"]) or cls and cls not in path[-1]["class"].split():
            return False
        if len(chain) == 1:
            return True
        uppers = [path[:-1]] if chain[-1][0] == ">" else [path[:i] for i in range(1, len(path))]
        return any(up and met(up, chain[:-1]) for up in uppers)

    def search(n, path, chain):
        path = [*path, n]
        return ([text(n)] if met(path, chain) else []) + [t for k in n["kids"] for t in search(k, path, chain)]

    for _ in range(60):
        root = tree(5)
        chain = [("", rnd.choice(["div", "*.x", "span.y", "em"]))] + [(rnd.choice([" ", ">"]), rnd.choice(["div", "*", "span.x", "em.y"])) for _ in range(rnd.randint(0, 3))]
        selector = "".join((f" {c} " if c == ">" else c) + s for c, s in chain)
        assert found(write(root), selector) == search(root, [], chain)


def test_time_grows_with_the_page():
    def seconds(n):
        page = "<div>" * n + "<p class=x>t</p>" * n
        began = time.process_time()
        assert len(found(page, "div p.x")) == n
        return time.process_time() - began

    seconds(1000)
    assert seconds(20_000) < 25 * max(seconds(2000), 0.01)


def test_rows(spark):
    pages = [(1, "<h1>One</h1><p>x</p><pre>code</pre><h2>Two</h2><article><pre>more</pre></article>"), (2, None), (3, "")]
    df = spark.createDataFrame(pages, "id long, html string")
    rows = html.elements(df, "id", "html", ["pre", "article > pre, pre"]).collect()
    assert sorted((r.html_selector, r.position, r.n_headings, r.code) for r in rows) == [("article > pre, pre", 1, 1, "code"), ("article > pre, pre", 2, 2, "more"), ("pre", 1, 1, "code"), ("pre", 2, 2, "more")]
    assert sorted((r.code, r.headings) for r in extract.html_code(df, "id", "html").collect()) == [("code", ["One"]), ("more", ["One", "Two"])]
    assert html.elements(df.limit(0), "id", "html", ["p"]).count() == 0
