"""Blocks, sections, code, tables and metadata from structured texts.

A text is exploded into lines; what a line belongs to follows from running
counts over the lines of its text, so each text is one window and no state is
kept outside Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import count_tokens, section_title
from marlstone.operators import rst
from marlstone.operators.html import elements, snippets
from marlstone.sources.shared import written

#: File extensions and their languages.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "scala": "scala",
    "kt": "kotlin", "swift": "swift", "sh": "bash", "sql": "sql", "r": "r", "lua": "lua", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "rst": "rst",
}
HEADING, FENCE = r"^(#{1,6})\s+(.+)$", "```"
#: A line of code that ``markdown`` marked, as it would read as a fence.
FENCE_MARK = r"(?md)^\\(\\*```)"


def language(ext: Column) -> Column:
    """The language of an extension or code type; null where it is unknown."""
    return F.element_at(F.map_from_arrays(F.lit(list(LANGUAGES)), F.lit(list(LANGUAGES.values()))), F.lower(ext))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of all lines; null texts have none."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Headings, fenced code and paragraphs in order: (id, first_line, last_line, type, content, level, language).

    Blank lines end paragraphs; fences are not part of the code.
    """
    w = Window.partitionBy("id").orderBy("line_no")
    marked = lines(df, id_col, text_col).withColumn("fence", F.startswith("line", F.lit(FENCE)).cast("int")).withColumn("fences", F.sum("fence").over(w))
    inside = (F.col("fences") % 2 == 1) | (F.col("fence") == 1)
    marked = marked.withColumn("kind", F.when(inside, "code").when(F.col("line").rlike(HEADING), "heading").when(F.trim("line") == "", "blank").otherwise("paragraph"))
    before = F.lag("kind").over(w)
    opens = (F.col("fence") == 1) & (F.col("fences") % 2 == 1)
    starts = before.isNull() | (before != F.col("kind")) | (F.col("kind") == "heading") | opens
    runs = marked.withColumn("run", F.sum(starts.cast("int")).over(w)).filter("kind <> 'blank'")
    found = runs.groupBy("id", "run", "kind").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.array_sort(F.collect_list(F.when((F.col("kind") != "code") | (F.col("fence") == 0), F.struct("line_no", "line")))).alias("ls"),
        F.min_by("line", "line_no").alias("head"),
    )
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    is_heading = F.col("kind") == "heading"
    return found.select(
        "id", "first_line", "last_line", F.col("kind").alias("type"),
        F.when(is_heading, F.trim(F.regexp_extract("head", HEADING, 2))).otherwise(body).alias("content"),
        F.when(is_heading, F.length(F.regexp_extract("head", HEADING, 1))).alias("level"),
        F.when(F.col("kind") == "code", F.trim(F.substring("head", F.lit(4), F.length("head")))).alias("language"),
    )


def sections(block_rows: DataFrame) -> DataFrame:
    """Headings with their number and path: (id, first_line, level, number, title, path).

    A number before the title is taken as it is; the others are counted by level,
    a higher heading starting the lower counts again.
    """
    heads = block_rows.filter("type = 'heading'").select("id", "first_line", "level", "content")
    own = F.regexp_extract("content", r"^(\d+(?:\.\d+)*)\.?\s", 1)
    heads = heads.withColumn("own", own).withColumn("title", section_title(F.when(own != "", F.regexp_replace("content", r"^\d+(?:\.\d+)*\.?\s*", "")).otherwise(F.col("content"))))
    w = Window.partitionBy("id").orderBy("first_line")
    for level in range(1, 7):
        heads = heads.withColumn(f"above_{level}", F.sum(((F.col("level") < level) & (F.col("own") == "")).cast("int")).over(w))
        within = Window.partitionBy("id", f"above_{level}").orderBy("first_line")
        heads = heads.withColumn(f"n_{level}", F.sum(((F.col("level") == level) & (F.col("own") == "")).cast("int")).over(within))
        upper = Window.partitionBy("id", f"up_{level}").orderBy("first_line")
        heads = heads.withColumn(f"up_{level}", F.sum((F.col("level") < level).cast("int")).over(w))
        heads = heads.withColumn(f"t_{level}", F.last(F.when(F.col("level") == level, F.col("title")), True).over(upper))
    counts = F.filter(F.slice(F.array(*(F.col(f"n_{k}") for k in range(1, 7))), F.lit(1), F.col("level")), lambda n: n > 0)
    path = F.array_compact(F.slice(F.array(*(F.col(f"t_{k}") for k in range(1, 7))), F.lit(1), F.col("level")))
    number = F.when(F.col("own") != "", F.col("own")).otherwise(F.array_join(F.transform(counts, lambda n: n.cast("string")), "."))
    return heads.select("id", "first_line", "level", number.alias("number"), "title", path.alias("path"))


def code_rows(df: DataFrame, id_col: str, text_col: str, repo_link: str = "") -> DataFrame:
    """A row for each code block of a markdown text, with the paragraph before it and the section it stands in."""
    rows = blocks(df, id_col, text_col)
    heads = sections(rows).select("id", "first_line", F.struct("number", "title", "path").alias("section"))
    w = Window.partitionBy("id").orderBy("first_line")
    joined = rows.join(heads, ["id", "first_line"], "left")
    joined = joined.withColumn("in_section", F.last("section", True).over(w))
    described = joined.withColumn("description", F.last(F.when(F.col("type") == "paragraph", F.struct("content", "first_line", "last_line")), True).over(w))
    return described.filter("type = 'code'").select(F.col("id").alias("file_path"), F.lit(repo_link).alias("repo_link"), *_item())


def _item() -> list[Column]:
    """What a row says of its block, from a block with its section and the paragraph before it."""
    path = F.coalesce("in_section.path", F.array().cast("array<string>"))
    return [
        F.struct((F.col("first_line") + 1).alias("start"), (F.col("last_line") + 1).alias("end")).alias("code_line_span"),
        F.struct((F.col("description.first_line") + 1).alias("start"), (F.col("description.last_line") + 1).alias("end")).alias("description_line_span"),
        F.col("content").alias("code"), F.coalesce(F.nullif("language", F.lit("")), F.lit("text")).alias("code_type"), F.coalesce("description.content", F.lit("")).alias("description"),
        count_tokens(F.col("content")).alias("code_token_count"), count_tokens(F.col("description.content")).alias("description_token_count"),
        F.sha2("content", 256).alias("section_id"), path.alias("section_path"), F.transform(path, lambda p: F.sha2(p, 256)).alias("section_hash_path"),
    ]


def metadata(text: Column) -> Column:
    """Lines ``key: value`` as a map of lower-case keys, the last of a key counting; title, author and date also from their own forms."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?m)^[A-Za-z0-9_\- ]+:\s*.+$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.replace(F.lower(F.trim(F.substring_index(p, ":", 1))), F.lit(" "), F.lit("_")).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:\s*", "")).alias("value")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    for key, names in (("title", "Title|#"), ("author", "Author|By"), ("date", "Date|Published")):
        value = F.trim(F.regexp_extract(text, rf"(?m)^(?:{names})\s*[:.\s]*\s*(.+)$", 1))
        own = F.when(value != "", F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
        last = F.map_concat(F.map_filter(last, _other(key, value)), own)
    return last


def _other(key: str, value: Column):
    return lambda k, _: (k != key) | (value == "")


def allowed_metadata(meta: Column, keys: Sequence[str]) -> Column:
    """A map without null values and keys that are not asked for."""
    return F.map_filter(meta, lambda k, v: k.isin(list(keys)) & v.isNotNull())


def markdown_table(text: Column) -> Column:
    """(headers, rows) of a markdown table; rows of another width are dropped, null without a header and a rule."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))

    def ruled(lines: Column) -> Column:
        is_rule = (F.size(lines) >= 2) & F.get(lines, F.lit(1)).rlike(r"^\s*\|?[\s:|-]+\|?\s*$")
        whole = F.struct(cells(F.get(lines, F.lit(0))).alias("headers"), F.transform(F.slice(lines, F.lit(3), F.size(lines)), cells).alias("rows"))
        own = lambda x: F.struct(x["headers"].alias("headers"), F.filter(x["rows"], lambda r: F.size(r) == F.size(x["headers"])).alias("rows"))
        return F.when(is_rule, F.get(F.transform(F.array(whole), own), F.lit(0)))

    # lines and cells are bound once, as the one element of an array
    lines = F.filter(F.split(F.trim(text), "\n"), lambda x: F.trim(x) != "")
    return F.when(text.isNotNull(), F.get(F.transform(F.array(lines), ruled), F.lit(0)))


def image(text: Column) -> Column:
    """(alt, src) of the first markdown image; null where there is none."""
    pattern = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("alt"), F.regexp_extract(text, pattern, 2).alias("src")))


def rst_code(text: Column) -> Column:
    """Code by indentation (``rst.blocks``), and what the pattern of directives and literal blocks finds beyond it; each once, blanks aside."""
    block = r"(?m)^(?:\.\. (?:code-block|code|sourcecode)::[^\n]*|[^\n]*::)\n(?:[ \t]+:[^\n]*\n)*\n((?:(?:[ \t]+[^\n]*)?\n?)+?)(?=^\S|\z)"
    found = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(block), F.lit(1))
    by_pattern = F.filter(F.transform(found, lambda c: F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]{1,4}", ""), r"^\n+|\s+$", "")), lambda c: c != "")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")

    def united(x: Column) -> Column:
        known = F.transform(x["tree"], bare)
        return F.array_distinct(F.concat(x["tree"], F.filter(x["pattern"], lambda c: ~F.exists(known, lambda k: F.contains(k, bare(c))))))

    # both are bound once, as the one element of an array
    both = F.struct(F.transform(rst.blocks(text), lambda b: b["code"]).alias("tree"), by_pattern.alias("pattern"))
    return F.get(F.transform(F.array(both), united), F.lit(0))


def notebook_cells(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Code cells of notebooks with the markdown cell before them: (id, cell, code, description)."""
    shape = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = df.select(F.col(id_col).alias("id"), F.posexplode(F.from_json(json_col, shape)["cells"]).alias("cell", "c"))
    w = Window.partitionBy("id").orderBy("cell")
    source = F.array_join("c.source", "")
    told = F.last(F.when(F.col("c.cell_type") == "markdown", source), True).over(w)
    return cells.withColumn("description", F.coalesce(told, F.lit(""))).filter(F.col("c.cell_type") == "code").select("id", "cell", source.alias("code"), "description")


def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles and tags, the common entities replaced, blanks joined."""
    for pattern, put in ((r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " ")):
        html = F.regexp_replace(html, pattern, put)
    for mark, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(mark), F.lit(put))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def html_headings(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Headings of pages in order: (id, position, level, title)."""
    found = F.regexp_extract_all(html_col, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    each = df.select(F.col(id_col).alias("id"), F.posexplode(found).alias("position", "h"))
    return each.select("id", F.col("position").cast("long").alias("position"), F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), html_text(F.col("h")).alias("title"))


def html_code(df: DataFrame, id_col: str, html_col: str, selector: str = "pre") -> DataFrame:
    """Elements that a CSS selector meets, with the text of all headings before them: (id, position, code, headings, html_selector).

    Headings are listed once for a page, and each element takes the first of them.
    """
    heads = elements(df, id_col, html_col, ["h1, h2, h3, h4, h5, h6"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda h: h["code"]).alias("all"))
    found = elements(df, id_col, html_col, [selector]).join(heads, "id", "left")
    own = F.slice(F.coalesce("all", F.array().cast("array<string>")), F.lit(1), F.col("n_headings").cast("int"))
    return found.select("id", "position", "code", own.alias("headings"), "html_selector")


def task_files(text: Column) -> Column:
    """(name, content) of the parts that ``### [FILENAME: x]`` lines open."""
    names = F.regexp_extract_all(text, F.lit(r"### \[FILENAME: ([^\]]+)\]"), F.lit(1))
    bodies = F.slice(F.split(text, r"### \[FILENAME: [^\]]+\]"), F.lit(2), F.size(names))
    return F.zip_with(names, bodies, lambda n, b: F.struct(F.trim(n).alias("name"), F.regexp_replace(b, r"^\s+|\s+$", "").alias("content")))


def needs_script(html: Column) -> Column:
    """Whether a page seems to be made by a script: a framework's name, or hardly any text."""
    return F.lower(html).rlike(r"react|vue|angular|next\.js|nuxt") | (F.length(html_text(html)) < 1500)


def backtick_fences(text: Column) -> Column:
    """Fences of tildes, with or without attributes, as fences of backticks with the first class as language."""
    return F.regexp_replace(text, r"(?m)^~{3,}[ \t]*\{?\.?([A-Za-z0-9_+-]*)[^}\n]*\}?[ \t]*$", "```$1")


def nodes(block_rows: DataFrame) -> DataFrame:
    """Blocks as nodes: (id, node, parent, type, content, metadata), the parent being the heading that a block stands under, null at the top."""
    w = Window.partitionBy("id").orderBy("first_line").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("type") == "heading"
    above = lambda level: F.last(F.when(heading & (F.col("level") == level), F.col("first_line")), True).over(w)
    known = F.array(*(F.struct(above(k).alias("line"), F.lit(k).alias("level")) for k in range(1, 7)))
    upper = F.filter(known, lambda x: x["line"].isNotNull() & (~heading | (x["level"] < F.col("level"))))
    meta = F.map_filter(F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("language"), F.col("language")), lambda _, v: v.isNotNull() & (v != ""))
    return block_rows.select("id", F.col("first_line").alias("node"), F.array_max(F.transform(upper, lambda x: x["line"])).alias("parent"), "type", "content", meta.alias("metadata"))


PAGE_MARK = r"<!--\s*page:\s*(\d+)\s*-->"


def paged_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of a markdown text with page marks: (id, page, position, type, content, language). Types are heading, code, table, image and text; what stands before the first mark is page 1."""
    parts = F.split(F.concat(F.lit("<!-- page: 1 -->"), F.col(text_col)), r"(?=<!--\s*page:\s*\d+\s*-->)")
    pages = df.select(F.col(id_col).alias("id"), F.posexplode(F.filter(parts, lambda p: p != "")).alias("part", "p"))
    pages = pages.select("id", "part", F.regexp_extract("p", PAGE_MARK, 1).cast("long").alias("page"), F.regexp_replace("p", PAGE_MARK, "").alias("p"))
    rows = blocks(pages.select(F.struct("id", "part", "page").alias("key"), "p"), "key", "p")
    kind = (
        F.when(F.col("type") != "paragraph", F.col("type"))
        .when(markdown_table(F.col("content")).isNotNull(), "table")
        .when(F.trim("content").rlike(r"^!\[[^\]]*\]\([^)\s]+[^)]*\)$"), "image")
        .otherwise("text")
    )
    place = F.row_number().over(Window.partitionBy("id.id").orderBy("id.part", "first_line")).cast("long")
    return rows.select(F.col("id.id").alias("id"), F.col("id.page").alias("page"), place.alias("position"), kind.alias("type"), "content", "language")


def json_tables(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Tables of JSON texts [{page, rows}, ...] as (id, table_id, page, header, body), numbered in order."""
    each = df.select(F.col(id_col).alias("id"), F.posexplode(F.from_json(json_col, "array<struct<page:long,rows:array<array<string>>>>")).alias("n", "t"))
    return each.select("id", F.concat(F.lit("table_"), F.col("n") + 1).alias("table_id"), "t.page", F.get("t.rows", F.lit(0)).alias("header"), F.slice("t.rows", F.lit(2), F.greatest(F.size("t.rows") - 1, F.lit(0))).alias("body"))


def rst_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Code of RST texts with the paragraph before it: (id, position, code, description)."""
    text = F.col(text_col)
    each = df.select(F.col(id_col).alias("id"), text.alias("text"), F.posexplode(rst_code(text)).alias("position", "code"))
    line = F.substring_index("code", "\n", 1)
    before = F.regexp_replace(F.split_part("text", line, F.lit(1)), r"\s+$", "")
    told = F.element_at(F.split(before, r"\n\s*\n"), -1)
    return each.select("id", F.col("position").cast("long").alias("position"), "code", F.trim(F.regexp_replace(F.regexp_replace(told, r"(?m)^\.\. .*$", ""), r"::\s*$", ":")).alias("description"))


def html_rows(df: DataFrame, id_col: str, html_col: str, source_col: str, selector: str = "pre", repo_link: str = "") -> DataFrame:
    """Blocks of the Markdown of each element that a CSS selector meets, as rows with where they come from.

    An element's snippet is the headings that begin before it and the element; it is turned
    into Markdown, and that into blocks (``blocks``) with the section they stand in, as
    ``code_rows`` has them, and page (a number of the row in ``df``), id, position (of the
    element), type, original_source and html_selector. Lines are counted from the snippet's
    first. Rows of type code are those that ``code_rows`` would give, with the paragraph of
    the element before them as description; an element without text is one empty paragraph.
    """
    key = F.struct(F.monotonically_increasing_id().alias("page"), F.col(id_col).alias("id"), F.col(source_col).alias("original_source"))
    # written, as a page's number must be the same for its headings and its elements
    found = written(snippets(df.select(key.alias("key"), F.col(html_col).alias("html")), "key", "html", [selector]), "snippets")
    titles = found.filter("html_selector IS NULL").select(F.col("id.page").alias("id"), F.col("position").alias("first_line"), F.lit("heading").alias("type"), F.col("markdown").alias("content"), F.substring("tag", 2, 1).cast("int").alias("level"))
    heads = sections(titles).select(F.col("id").alias("page"), F.col("first_line").alias("heading"), F.struct("number", "title", "path").alias("in_section"))
    own = found.filter("html_selector IS NOT NULL").select(F.struct("id.page", "id.id", "id.original_source", "html_selector", "position", "n_headings").alias("id"), "markdown")
    w = Window.partitionBy("id").orderBy("first_line")
    # headings before take a line and a blank one each
    rows = blocks(own.filter("markdown <> ''"), "id", "markdown").withColumns({c: F.col(c) + 2 * F.col("id.n_headings") for c in ("first_line", "last_line")})
    rows = rows.withColumn("heading", F.col("id.n_headings") + F.count_if(F.col("type") == "heading").over(w))
    told = F.last(F.when(F.col("type") == "paragraph", F.struct("content", "first_line", "last_line")), True).over(w)
    rows = rows.withColumn("description", F.when(F.col("type") == "code", told))
    code = F.regexp_replace("content", FENCE_MARK, "$1")
    rows = rows.withColumn("content", F.when(F.col("type") == "code", code).otherwise(F.col("content")))
    line = 2 * F.col("id.n_headings")
    empty = own.filter("markdown = ''").select("id", line.alias("first_line"), line.alias("last_line"), F.lit("paragraph").alias("type"), F.lit("").alias("content"), F.col("id.n_headings").alias("heading"))
    rows = rows.unionByName(empty, allowMissingColumns=True).withColumn("page", F.col("id.page")).join(heads, ["page", "heading"], "left")
    place = [F.col(f"id.{c}").alias(c) for c in ("id", "position", "original_source", "html_selector")]
    return rows.select("page", *place, "type", F.lit(repo_link).alias("repo_link"), *_item())


def content_map(df: DataFrame, path_col: str, content_col: str, kind: str, language_col: str | None = None) -> DataFrame:
    """What is known of each file: (file_path, content, type, language, characters)."""
    lang = F.col(language_col) if language_col else F.lit(None).cast("string")
    return df.select(F.col(path_col).alias("file_path"), F.col(content_col).alias("content"), F.lit(kind).alias("type"), lang.alias("language"), F.length(content_col).cast("long").alias("characters"))


def pipeline(files: DataFrame, question: str, top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) of pages and markdown to rows (_key, content), all of them; and those that answer a question best."""
    from marlstone.operators import search

    plain = F.when(F.lower("path").rlike(r"\.html?$"), html_text(F.col("content"))).otherwise(F.col("content"))
    rows = blocks(files.select("path", plain.alias("content")), "path", "content")
    rows = rows.select(F.concat_ws("#", "id", "first_line").alias("_key"), "type", "content")
    return rows, search.bm25_search(rows, question, ["content"], top_n=top_n)
