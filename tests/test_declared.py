"""Declarations of many languages: by hand, in code that breaks off, and in time that grows with the text."""

import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators.declared import LANGUAGES, declarations, declared, functions_in


def short(text, language):
    return [(x["name"], [p["name"] for p in x["parameters"]], x["returns"], x["depth"]) for x in declarations(text, language) if x["kind"] == "function"]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("javascript", "// function no(a) {}\nfunction f(a,\n  b = \"x, ) y\", ...rest) { return `function no() {}` }", [("f", ["a", "b", "rest"], None, 0)]),
        ("javascript", "const g = async (x, w = [1, (2)]) => x; var h = function(t) { }; foo(1); if (a) { b(c) }", [("g", ["x", "w"], None, 0), ("h", ["t"], None, 0)]),
        ("javascript", "class A { constructor(q) { super(q); } static of(v) { return new A(v) } }", [("constructor", ["q"], None, 1), ("of", ["v"], None, 1)]),
        ("typescript", "function m<T, U>(xs: Map<string, T>, f?: (t: T) => U): Promise<U[]> { const k = <V,>(a: V): V => a }", [("m", ["xs", "f"], "Promise<U[]>", 0), ("k", ["a"], "V", 1)]),
        ("java", 'class A { public static <K> Map<String, List<K>> s(final Map<String, K> m, int... xs)\n throws E, F { if (a(b)) { } }\n A(int x) { } String t = "void no(int y) { }"; }', [("s", ["m", "xs"], "<K> Map<String, List<K>>", 1), ("A", ["x"], None, 1)]),
        ("go", "func (s *S) F(ctx c.C, a, b int) (int, error) { g := func(q int) int { return 1 } }", [("F", ["ctx", "a", "b"], "(int, error)", 0)]),
        ("rust", "impl<'a> X<'a> { pub fn g<'b, T: I<S>>(&self, x: &'a str) -> R<T, E> where T: C { let c = '\"'; } } /* fn no() */", [("g", ["self", "x"], "R<T, E>", 1)]),
        ("c", "int p(int a);\n#define M(a) { a }\nstatic char *n(const char *s, int (*cb)(int)) { for (;;) { f(s); } }\nint main(void)\n{\n}", [("n", ["s", "cb"], "char *", 0), ("main", [], "int", 0)]),
        ("python", "class A:\n    def f(self, a: int = 3, *args, b=(1, 2)) -> dict[str,\n            int]:\n        def g(x): pass\n        s = 'def no(): pass'\n# def no(): pass\nasync def h(): ...", [("f", ["self", "a", "args", "b"], "dict[str, int]", 1), ("g", ["x"], None, 2), ("h", [], None, 0)]),
        ("kotlin", "fun <T> List<T>.second(a: Int = 1, b: (Int) -> Unit): T? = this[1]", [("second", ["a", "b"], "T?", 0)]),
        ("php", "function go(?array $a, string $b = 'x') : ?int { # function no()\n}", [("go", ["$a", "$b"], "?int", 0)]),
        ("swift", "func add(to x: Int, y: [Int] = []) -> Int { }", [("add", ["x", "y"], "Int", 0)]),
        ("scala", "def f(a: Int, b: Map[Int, String]): Seq[Int] = { }", [("f", ["a", "b"], "Seq[Int]", 0)]),
        ("cobol", "function f() {}", []),
    ],
)
def test_by_hand(language, text, want):
    assert short(text, language) == want


def test_types_defaults_and_comments():
    (f,) = [x for x in declarations("/** Adds.\n * more\n * @param a x */\npublic int f(int a) { }", "java") if x["kind"] == "function"]
    assert (f["docstring"], f["line"], f["parameters"]) == ("Adds.\nmore", 4, [{"name": "a", "type": "int", "default": None, "required": True}])
    (f,) = declarations("def f(a: int = 3):\n    '''Told.'''", "python")
    assert f["docstring"] == "Told." and f["parameters"] == [{"name": "a", "type": "int", "default": "3", "required": False}]
    assert [(x["kind"], x["name"]) for x in declarations("interface P { } enum E { A }", "typescript")] == [("class", "P"), ("class", "E")]


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_code_that_breaks_off(language):
    text = 'class A { function f(a, b = "x") { int g(int y) { def h(z): fn i<T>(q: T) { /* "'
    for cut in range(len(text)):
        declarations(text[:cut], language)
    for odd in (None, "", "((((", "))))", "\0", "'", '"', "`", "/*", "é = \u2028", "function", "func (", "def f(", "int f(int"):
        declarations(odd, language)


def test_time_grows_with_the_text():
    def seconds(n):
        began = time.process_time()
        for piece, language in (("function f(a, b) { g(a); }\n", "javascript"), ("int f(int a) { g(a, h(b)); }\n", "c"), ("(", "java"), ("a<", "java"), ("x ", "typescript"), ("def f(a):\n  g(a)\n", "python")):
            declarations(piece * n, language)
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 25 * max(seconds(800), 0.01)


def test_columns(spark):
    df = spark.createDataFrame([("go", "func f(a int) {}"), ("python", "def g(b): pass"), (None, "def h(c): pass"), ("python", None)], "lang string, t string")
    got = df.select(declared(F.col("t"), F.col("lang")).alias("d")).collect()
    assert [[x.name for x in r.d] for r in got] == [["f"], ["g"], [], []]
    assert df.limit(1).select(functions_in(F.col("t"), "go").alias("f")).first().f[0].parameters == ["a int"]
