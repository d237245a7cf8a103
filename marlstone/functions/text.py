"""Text expressions: tokens, sentences, counts, clean-up; all of them Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import jsons

#: Words of letters, digits and underscores in any script.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str) -> Column:
    """Lower-case words; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down: the deterministic stand-in for a model's tokenizer."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def sentences(text: Column) -> Column:
    """The parts between blanks that follow ``.``, ``!`` or ``?``; empty parts are dropped."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def shorten(text: Column, limit: int = 100) -> Column:
    """Texts longer than ``limit`` cut to end in three dots within it."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def middle_out(text: Column, max_tokens: int = 50) -> Column:
    """The first and last half of the words around dots where there are more than ``max_tokens``."""
    words = F.split(F.trim(text), r"\s+")
    half = max_tokens // 2
    short = F.concat_ws(" ", F.concat(F.slice(words, 1, half), F.array(F.lit("...")), F.slice(words, -half, half)))
    return F.when(F.size(words) > max_tokens, short).otherwise(text)


def normalize(text: Column) -> Column:
    """Plain running text: no line breaks, tags, links or addresses; bullets as dashes, the Greek alpha spelled out, a full stop at the end."""
    for pattern, put in ((r"[\r\n]+", " "), (r"<[^>]+>", ""), (r"https?://\S+", ""), (r"\S+@\S+\.\S+", ""), ("[•●▪]", "-"), ("α", "alpha"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, put)
    text = F.trim(text)
    return F.when((text == "") | text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def embedding_text(*parts: Column) -> Column:
    """Non-blank parts, a line break between them."""
    return F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def section_title(title: Column) -> Column:
    """A heading without control characters and outer blanks; blank ones get a name."""
    clean = F.trim(F.regexp_replace(title, r"\p{Cntrl}", ""))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("Unnamed Section")).otherwise(clean)


def file_name(text: Column, limit: int = 100) -> Column:
    """A safe file name: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.substring(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), 1, limit)


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def repository_name(url: Column) -> Column:
    """The last part of a repository's address, without ``.git``."""
    return F.regexp_replace(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), r"\.git$", "")


def collection_of(identifier: Column) -> Column:
    """The collection in ``collection/key``."""
    return F.split_part(identifier, F.lit("/"), F.lit(1))


def key_of(identifier: Column) -> Column:
    """The key in ``collection/key``."""
    return F.split_part(identifier, F.lit("/"), F.lit(2))


def lesson_key(role: Column, category: Column, identifier: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", role, category, identifier), " ", "_")


def first_json(text: Column) -> Column:
    """The first object or array of a text as a variant, repaired where none is whole; null where there is none."""
    return F.try_parse_json(jsons.first_json(text))


def truncate_value(text: Column, limit: int = 100) -> Column:
    """Embedded images by their size alone, other long values by both ends."""
    image = F.regexp_replace(text, r"(data:image/[a-z]+;base64,)[A-Za-z0-9+/=]{20,}", "$1...")
    half = limit // 2 - 2
    return F.when(F.length(image) > limit, F.concat(F.substring(image, 1, half), F.lit("..."), F.substring(image, -half, half))).otherwise(image)


def sanitize(text: Column, limit: int | None = None) -> Column:
    """A result that is put into a prompt: markup escaped, script schemes taken out, cut to ``limit`` if there is one."""
    for mark, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(put))
    text = F.regexp_replace(text, r"(?i)(javascript|vbscript|data):", "")
    return text if limit is None else F.substring(text, 1, limit)
