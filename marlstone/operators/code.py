"""What a piece of Python code defines."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA = "struct<functions:array<struct<name:string,parameters:array<string>,returns:string,docstring:string,line:int>>,classes:array<string>,assignments:array<string>,tries:int,comprehensions:int,error:string>"


def describe(code: str | None) -> dict:
    """Functions with parameters (type and default included), classes, assigned names, and counts; ``error`` for what does not parse."""
    out: dict = {"functions": [], "classes": [], "assignments": [], "tries": 0, "comprehensions": 0, "error": None}
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return out | {"error": type(e).__name__}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            args = node.args
            plain = [*args.posonlyargs, *args.args]
            defaults = dict(zip([a.arg for a in plain][len(plain) - len(args.defaults) :], args.defaults, strict=True)) | {a.arg: d for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True) if d is not None}
            shown = [ast.unparse(a) + (f" = {ast.unparse(defaults[a.arg])}" if a.arg in defaults else "") for a in [*plain, *args.kwonlyargs]]
            out["functions"].append({"name": node.name, "parameters": shown, "returns": ast.unparse(node.returns) if node.returns else None, "docstring": ast.get_docstring(node), "line": node.lineno})
        elif isinstance(node, ast.ClassDef):
            out["classes"].append(node.name)
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            out["assignments"] += [ast.unparse(t) for t in targets]
        elif isinstance(node, ast.Try):
            out["tries"] += 1
        elif isinstance(node, ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
            out["comprehensions"] += 1
    return out


def _described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([describe(code) for code in batch], columns=list(describe("")))


def metadata(code: Column | str) -> Column:
    """What each piece of code defines, as a struct."""
    return F.pandas_udf(_described, METADATA)(code)


def parameter(text: Column) -> Column:
    """(name, type, default) of a parameter such as ``x: int = 5``; what is not given is null."""
    found = lambda i: F.nullif(F.trim(F.regexp_extract(text, r"^\s*\**([A-Za-z_]\w*)\s*(?::([^=]+))?(?:=(.*))?$", i)), F.lit(""))
    return F.struct(found(1).alias("name"), found(2).alias("type"), found(3).alias("default"))
