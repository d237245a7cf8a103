"""Markdown of elements by hand, and its rows against those of each whole snippet."""

import random
import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators import extract, html


def written(page, selector):
    return [text for k, _, _, _, text in html.find_snippets(page, html.parse_selector(selector)) if k is not None]


@pytest.mark.parametrize(
    ("page", "selector", "texts"),
    [
        ("<p>a <b>bold <b>er</b> </b>and<i>it</i> <s>x</s><p><code>c_d</code> <code>e`f</code> <code>g``h</code>", "p", ["a **bold er** and*it* ~~x~~", "`c_d` `` e`f `` g\\`\\`h"]),
        ("<p>a<br><br>b<br></p><p># no<br>- no<br>1. no<br>```no<p>&amp;lt; &lt;i&gt; x_y [z] \\", "p", ["a\\\n\\\nb", "\\# no\\\n\\- no\\\n1\\. no\\\n\\`\\`\\`no", "\\&lt; \\<i> x\\_y \\[z\\] \\\\"]),
        ("<p>see <a href='/u v'>the <b>page</b></a> <a>here</a> <img src='a(1).png' alt='A\nB'></p><p></p>", "p", ["see [the **page**](/u%20v) here ![A B](<a(1).png>)", ""]),
        ("<p>wow!<a href=u>x</a> no! <a href=u>y</a>", "p", ["wow\\![x](u) no! [y](u)"]),
        ("<ul><li>one<li><p>two</p><p>more</p><ol><li>n<li>m</ol></ul>end", "ul", ["- one\n- two\n  more\n  1. n\n  2. m"]),
        ("<div>x<blockquote><p>q<p>r</blockquote><hr>y</div>", "div", ["x\n\n> q\n\n> r\n\ny"]),
        ("<table><tr><th>A<th>B|<tr><td>1<td><p>2<p>3</table>", "table", ["| A | B\\| |\n| --- | --- |\n| 1 | 2 3 |"]),
        ("<table><tr><td><pre>1\n2</pre><td><pre>a  b\nc</pre></table>", "table", ["```\n1\n2\n```\n\n```\na  b\nc\n```"]),
        ("<div><b>x<pre>\n  y &lt; <i>z</i>\n</pre>w</b><script>no</script><style>no</style></div>", "div", ["**x**\n\n```\ny < z\n```\n\n**w**"]),
        ("<pre>a\n```\n\\```\nb</pre>", "pre", ["```\na\n\\```\n\\\\```\nb\n```"]),
        ("<article><h1>One<br><b>two</b></h1>x<h3> </h3><ul><li><h2>In</h2>y</ul></article>", "article", ["# One **two**\n\nx\n\n### Unnamed Section\n\n## In\n\n- y"]),
        ("<h1>T</h1>no such element", "p", []),
    ],
)
def test_by_hand(page, selector, texts):
    assert written(page, selector) == texts


def test_rows(spark):
    page = "<h1>Guide</h1><p>Intro.</p><h2>Run it</h2><article><p>First <b>this</b>:</p><pre>a\n```\n\\```\nb</pre><h3>Then</h3><pre>  c &lt; d</pre>text</article><h2>Later</h2><article> </article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", "<h1>x</h1>")], "id long, url string, html string")
    rows = extract.html_rows(df, "id", "html", "url", "article", "repo").collect()
    shown = lambda r: (r.position, r.type, r.code, r.description, tuple(r.section_path), tuple(r.code_line_span), r.original_source, r.html_selector, r.repo_link)
    by_page = {}
    for r in rows:
        by_page.setdefault((r.page, r.id), []).append(shown(r))
    want = lambda u: [
        (1, "paragraph", "First **this**:", "", ("Guide", "Run it"), (5, 5), u, "article", "repo"),
        (1, "code", "a\n```\n\\```\nb", "First **this**:", ("Guide", "Run it"), (7, 12), u, "article", "repo"),
        (1, "heading", "Then", "", ("Guide", "Run it", "Then"), (14, 14), u, "article", "repo"),
        (1, "code", "c < d", "First **this**:", ("Guide", "Run it", "Then"), (16, 18), u, "article", "repo"),
        (1, "paragraph", "text", "", ("Guide", "Run it", "Then"), (20, 20), u, "article", "repo"),
        (2, "paragraph", "", "", ("Guide", "Later"), (9, 9), u, "article", "repo"),
    ]
    assert sorted((i is None, sorted(found, key=lambda x: (x[0], x[5]))) for (_, i), found in by_page.items()) == [(False, want("u"))] * 2 + [(True, want(None))]


def test_rows_are_those_of_each_snippet(spark):
    rnd = random.Random(6)

    def part(depth):
        kind = rnd.choice(["h", "h", "p", "pre", "pre", "text", "div", "div", "ul", "quote"])
        word = f"w{rnd.randrange(10**6)} x"
        if kind == "h":
            level = rnd.randint(1, 6)
            return f"<h{level}>{rnd.choice(['', '2.1 ', '7. '])}{rnd.choice([word, word, ''])}</h{level}>"
        if kind in ("p", "text", "pre"):
            return {"p": f"<p>{word}", "text": word, "pre": f"<pre>{word}\n\n# {word}</pre>"}[kind]
        below = "".join(part(depth - 1) for _ in range(rnd.randint(0, 4) if depth else 0))
        return {"div": f"<div>{below}</div>", "ul": f"<ul><li>{below}<li>{word}</ul>", "quote": f"<blockquote>{below}</blockquote>"}[kind]

    pages = [(i, f"u{i}", "".join(part(3) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(pages, "id long, url string, html string")
    texts = []
    for i, _, page in pages:
        heads, position = [], 0
        for k, _, tag, before, text in html.find_snippets(page, html.parse_selector("div")):
            if k is None:
                heads.append("#" * int(tag[1]) + " " + (text or "Unnamed Section"))
            else:
                position += 1
                texts.append((f"{i}/{position}", "\n\n".join([*heads[:before], text])))
    columns = ["code", "code_type", "description", "code_line_span", "code_token_count", "description_token_count", "section_id", "section_path", "section_hash_path"]
    want = extract.code_rows(spark.createDataFrame(texts, "key string, text string"), "key", "text").select("file_path", *columns, "description_line_span")
    got = extract.html_rows(df, "id", "html", "url", "div").filter("type = 'code'").select(F.concat_ws("/", "id", "position"), *columns, "description_line_span")
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert len(rows) > 100 and rows == sorted(map(repr, map(tuple, want.collect())))


def test_a_paragraph_is_one_row_whatever_its_text(spark):
    rnd = random.Random(8)
    pieces = ["# ", "```", "~~~", "- ", "1. ", "* ", "> ", "| ", "---", "===", "\\", "`", "``", "<br>", "<br><br>", "\n\n", "    ", "<b>", "</b>", "<code>", "</code>", "<a href=x>", "&nbsp;", "&amp;", "é", " ", "word", "<img src=y>", "<li>", "<select><div>", "</select>", "<!-- page: 3 -->"]
    bodies = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, "u", f"<h2>t</h2><p>{b}</p>") for i, b in enumerate(bodies)], "id long, url string, html string")
    rows = extract.html_rows(df, "id", "html", "url", "p").groupBy("id", "type").count().collect()
    assert sorted(tuple(r) for r in rows) == [(i, "paragraph", 1) for i in range(len(bodies))]


@pytest.mark.parametrize("piece", ["<h2>x</h2><p>t</p>", "<p><b>t", "<p>a<br>*b*</p>", "<table><tr><td>", "<b><i><a href=x>"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        began = time.process_time()
        list(html.find_snippets(f"<div>{piece * n}</div>", html.parse_selector("div, p")))
        return time.process_time() - began

    seconds(500)
    assert seconds(10_000) < 25 * max(seconds(1000), 0.02)
