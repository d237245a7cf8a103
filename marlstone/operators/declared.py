"""What code of many languages declares: tokens that know strings and comments, and one rule for each way of declaring.

A text is cut to tokens once; brackets are matched on a stack, so parameters may
hold brackets, strings and commas of their own and go over many lines. Code that
breaks off gives what was whole before. Comments and strings declare nothing.
"""

from __future__ import annotations

import re


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DECLARATION = "struct<kind:string,name:string,parameters:array<struct<name:string,type:string,default:string,required:boolean>>,shown:array<string>,returns:string,docstring:string,line:int,depth:int>"
SCHEMA = f"array<{DECLARATION}>"

#: Words of languages.
COLON = frozenset({"typescript", "javascript", "rust", "kotlin", "swift", "scala", "python"})
TYPE_FIRST = frozenset({"java", "c", "cpp", "csharp"})
LANGUAGES = COLON | TYPE_FIRST | {"go", "php"}
FUNCTION_WORDS = {"javascript": {"function"}, "typescript": {"function"}, "php": {"function"}, "go": {"func"}, "swift": {"func"}, "rust": {"fn"}, "kotlin": {"fun"}, "scala": {"def"}, "python": {"def"}}
CLASS_WORDS = frozenset({"class", "interface", "struct", "trait", "enum", "object", "record", "impl"})
CONTROL = frozenset("if for while switch catch return else do try with match when sizeof synchronized using lock foreach unless elif defer select go case new throw typeof await yield super this assert".split())
MODIFIERS = frozenset("public private protected internal static final abstract virtual override async const constexpr inline extern unsafe sealed synchronized native default export explicit".split())
_COMMON = [
    ("comment", r"/\*.*?(?:\*/|\Z)|//[^\n]*"),
    ("string", r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)'),
]
_ENDS = [("word", r"[^\W\d][\w]*[!?]?(?=\s*\()|[$\w]+"), ("line", r"\n"), ("mark", r"\.\.\.|=>|->|::|:=|[=!<>+*/&|^%-]=|&&|\|\||[^\s\w]")]
#: One quoted character, so that what names a lifetime is none.
_CHARACTER, _QUOTED = ("string", r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"), ("string", r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)")
_PYTHON = [("comment", r"#[^\n]*"), ("string", r"(?:[rRbBuUfF]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))")]


def _pattern(language: str) -> re.Pattern:
    if language == "python":
        rules = [*_PYTHON, *_ENDS]
    else:
        quoted = _QUOTED if language in ("javascript", "typescript", "php") else _CHARACTER
        rules = [*_COMMON, quoted, *([("comment", r"#[^\n]*")] if language == "php" else []), *_ENDS]
    return re.compile("|".join(f"(?P<{kind}{i}>{p})" for i, (kind, p) in enumerate(rules)), re.DOTALL)


_PATTERNS = {language: _pattern(language) for language in LANGUAGES}
OPENS, SHUTS = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Code:
    """The tokens of a text without comments and line breaks, and what each bracket matches."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.words: list[str] = []
        self.begin: list[int] = []
        self.line: list[int] = []
        self.kind: list[str] = []
        self.comment: dict[int, str] = {}
        line, last = 1, 0
        for m in _PATTERNS[language].finditer(text):
            kind = m.lastgroup.rstrip("0123456789")
            line += text.count("\n", last, m.start())
            last = m.start()
            if kind == "comment":
                self.comment[len(self.words)] = m.group()
            elif kind != "line":
                self.words.append(m.group())
                self.begin.append(m.start())
                self.line.append(line)
                self.kind.append(kind)
        self.match: dict[int, int] = {}
        self.depth: list[int] = []
        stack, braces = [], 0
        for i, w in enumerate(self.words):
            braces -= w == "}"
            self.depth.append(max(0, braces))
            braces += w == "{"
            if self.kind[i] != "mark":
                continue
            if w in OPENS:
                stack.append(i)
            elif w in SHUTS:
                while stack and OPENS[self.words[stack[-1]]] != w:
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = i

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def shown(self, a: int, b: int) -> str:
        """The text of tokens from a to before b, blanks joined."""
        return " ".join(self.text[self.begin[a] : self.begin[b - 1] + len(self.words[b - 1])].split()) if a < b else ""

    def skip_generics(self, i: int) -> int:
        """Behind angle brackets that open at a token; the token itself where none do or they don't close."""
        if self.at(i) != "<":
            return i
        level = 0
        for j in range(i, min(len(self.words), i + 400)):
            level += (self.words[j] == "<") - (self.words[j] == ">")
            if self.words[j] in "{};":
                return i
            if level == 0:
                return j + 1
        return i

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Runs of tokens between commas that stand in no bracket."""
        out, begin, i, angles = [], a, a, 0
        while i < b:
            w = self.words[i]
            if w in OPENS and self.kind[i] == "mark":
                i = self.match.get(i, b)
            elif w == "<" and i > a and self.kind[i - 1] == "word":
                angles += 1
            elif w == ">" and angles:
                angles -= 1
            elif w == "," and not angles:
                out.append((begin, i))
                begin = i + 1
            i += 1
        return [(x, y) for x, y in [*out, (begin, b)] if x < y]

    def find(self, a: int, b: int, marks: tuple[str, ...]) -> int:
        """The first of some marks between two tokens that stands in no bracket, else b."""
        i = a
        while i < b:
            if self.words[i] in marks and self.kind[i] == "mark":
                return i
            i = self.match.get(i, i) + 1 if self.words[i] in OPENS else i + 1
        return b


def _parameter(code: _Code, a: int, b: int) -> dict | None:
    equal = code.find(a, b, ("=",))
    default = code.shown(equal + 1, b) or None
    rest = any(code.words[i] in ("...", "*", "**") for i in range(a, equal)) and code.language not in ("c", "cpp", "rust", "go")
    if code.language in COLON:
        colon = code.find(a, equal, (":",))
        named = [i for i in range(a, colon) if code.kind[i] == "word"]
        name = code.words[named[-1]] if named else None
        kind = code.shown(colon + 1, equal) or None
        optional = name is not None and name.endswith("?") or any(code.words[i] == "?" for i in range(a, colon))
    else:
        named = [i for i in range(a, equal) if code.kind[i] == "word"]
        pointed = next((i + 2 for i in range(a, equal - 2) if code.words[i : i + 2] == ["(", "*"] and code.kind[i + 2] == "word"), None)
        name = code.words[pointed or named[-1]] if named else None
        kind = None if not named else code.shown(a, equal) if pointed else code.shown(a, named[-1]) or None
        optional = False
    if name is None:
        return None
    return {"name": name.rstrip("?"), "type": kind, "default": default, "required": default is None and not rest and not optional}


def _parameters(code: _Code, a: int, b: int) -> tuple[list[dict], list[str]]:
    runs = code.parts(a, b)
    if code.language in ("c", "cpp") and [code.shown(x, y) for x, y in runs] == ["void"]:
        runs = []
    shown = [code.shown(x, y) for x, y in runs]
    if code.language != "go":
        return [p for p in (_parameter(code, x, y) for x, y in runs) if p], shown
    # names of one type share the one that follows
    out, kind = [], None
    for x, y in reversed(runs):
        kind = code.shown(x + 1, y) or kind
        out.append({"name": code.words[x], "type": kind, "default": None, "required": True})
    return out[::-1], shown


def _told(code: _Code, first: int, body: int | None) -> str | None:
    """The comment before a declaration, or the string that begins a body."""
    if code.language == "python":
        if body is None or body >= len(code.words) or code.kind[body] != "string":
            return None
        return re.sub(r"^[rRbBuUfF]*(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", code.words[body]).strip()
    said = code.comment.get(first)
    if said is None or not said.startswith("/**"):
        return None
    lines = (x.strip().lstrip("*").strip() for x in said[3:].removesuffix("*/").split("\n"))
    return "\n".join(x for x in lines if x and not (x.startswith("@") and code.language in TYPE_FIRST)) or None


def declarations(text: str | None, language: str) -> list[dict]:
    """Functions and classes that a text declares, in order; none in an unknown language."""
    if language not in LANGUAGES:
        return []
    code, out = _Code(text or "", language), []
    words, kind = code.words, code.kind
    indents: list[int] = []

    def add(what: str, name: str, first: int, runs: tuple[list[dict], list[str]], returns: str | None, body: int | None, place: int) -> None:
        depth = code.depth[place]
        if language == "python":
            own = code.text[code.text.rfind("\n", 0, code.begin[place]) + 1 : code.begin[place] + 1]
            indent = len(own) - len(own.lstrip())
            while indents and indents[-1] >= indent:
                indents.pop()
            depth = len(indents)
            indents.append(indent)
        out.append({"kind": what, "name": name, "parameters": runs[0], "shown": runs[1], "returns": returns or None, "docstring": _told(code, first, body), "line": code.line[place], "depth": depth})

    def start_of(i: int) -> int:
        """The first token of what a declaration is told with: modifiers and a type before it."""
        while i > 0:
            if words[i - 1] == ">":
                level, j = 1, i - 1
                while j > 0 and level and words[j - 1] not in "{};":
                    j -= 1
                    level += (words[j] == ">") - (words[j] == "<")
                if level:
                    return i
                i = j
            elif kind[i - 1] == "word" and words[i - 1] not in CONTROL or words[i - 1] in ("*", "&", "[", "]", "::", "."):
                i -= 1
            else:
                return i
        return i

    for i, w in enumerate(words):
        if kind[i] != "word":
            continue
        before = code.at(i - 1)
        if w in CLASS_WORDS and kind[i] == "word" and before not in (".", "::", ":") and i + 1 < len(words) and kind[i + 1] == "word":
            add("class", words[i + 1], start_of(i), ([], []), None, code.find(i, min(len(words), i + 200), (":",)) + 1 if language == "python" else None, i)
            continue
        if w in FUNCTION_WORDS.get(language, ()):
            j = i + 1
            if language == "go" and code.at(j) == "(":
                j = code.match.get(j, len(words)) + 1
            if language == "kotlin":
                j = code.skip_generics(j)
            name = words[j] if j < len(words) and kind[j] == "word" else None
            j = code.skip_generics(j + 1 if name else j)
            while language == "kotlin" and code.at(j) == "." and name:
                name, j = code.at(j + 1), code.skip_generics(j + 2)
            if name is None and before == "=" and kind[i - 2 :][:1] == ["word"]:
                name = words[i - 2]
            shut = code.match.get(j) if code.at(j) == "(" else None
            if name is None or shut is None:
                continue
            stop = code.find(shut + 1, min(len(words), shut + 60), ("{", ";", "=", "=>") if language != "python" else (":",))
            led = code.at(shut + 1) in (":", "->")
            returns = code.shown(shut + 1 + led, stop) if led or language == "go" else None
            if returns and language == "rust":
                returns = returns.split(" where ")[0]
            add("function", name, start_of(i), _parameters(code, j + 1, shut), returns, stop + 1, i)
        elif language in ("javascript", "typescript") and w in ("const", "let", "var") and i + 2 < len(words):
            j = code.find(i + 2, min(len(words), i + 60), ("=", ";", ",")) + 1
            j += code.at(j) == "async"
            j = code.skip_generics(j)
            shut = code.match.get(j) if code.at(j) == "(" else None
            arrow = None if shut is None else code.find(shut + 1, min(len(words), shut + 60), ("=>", ";", "{", ","))
            if arrow is not None and code.at(arrow) == "=>":
                returns = code.shown(shut + 2, arrow) if code.at(shut + 1) == ":" else None
                add("function", words[i + 1], i, _parameters(code, j + 1, shut), returns, None, i)
        elif language in TYPE_FIRST or language in ("javascript", "typescript"):
            j = code.skip_generics(i + 1)
            shut = code.match.get(j) if code.at(j) == "(" else None
            if shut is None or w in CONTROL or w in FUNCTION_WORDS.get(language, ()) or before in FUNCTION_WORDS.get(language, ()) or before in (".", "=", "(", ",", "!", "&&", "||", "?", "=>", "return", "new", "throw", "await", "->", ":=", "+", "-"):
                continue
            open_at = code.find(shut + 1, min(len(words), shut + 60), ("{", ";", "=", "}", "=>", ")"))
            between = words[shut + 1 : open_at]
            if code.at(open_at) != "{" or between and not (between[0] in ("throws", "const", "noexcept", "override", "final", ":", "->", "where")):
                continue
            first = start_of(i)
            if language in TYPE_FIRST:
                typed = [k for k in range(first, i) if words[k] not in MODIFIERS]
                returns = code.shown(typed[0], i) if typed else None
                if code.at(first - 1) == "#":
                    continue  # a macro
                if not typed and before not in MODIFIERS and before not in ("", "{", "}", ";"):
                    continue
            else:
                if code.depth[i] == 0:
                    continue  # a call that a block follows
                returns = code.shown(shut + 2, open_at) if between[:1] == [":"] else None
            add("function", w, first, _parameters(code, j + 1, shut), returns, None, i)
    return out


def declared(text: Column, language: Column | str) -> Column:
    """What each text declares, as an array of structs."""

    @F.pandas_udf(SCHEMA)
    def found(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([declarations(t, lang or "") for t, lang in zip(texts, languages, strict=True)], dtype=object)

    return found(text, F.lit(language) if isinstance(language, str) else language)


def functions_in(text: Column, language: Column | str) -> Column:
    """(name, parameters) of the functions that a piece of code declares, in order; empty for an unknown language."""
    functions = F.filter(declared(text, language), lambda x: x["kind"] == "function")
    return F.transform(functions, lambda x: F.struct(x["name"].alias("name"), x["shown"].alias("parameters")))


