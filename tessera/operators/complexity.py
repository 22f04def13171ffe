"""Cyclomatic complexity of functions: Python by the standard parser, other languages by outline."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import outline

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.With, ast.AsyncWith)


def of_source(content: str) -> list[tuple[str, int, int]]:
    """(name, line, 1 + branches) of each outermost function, most complex first; inner ones count in it. [] if it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((child.name, child.lineno, 1 + sum(isinstance(n, _BRANCHES) for n in ast.walk(child))))
            else:
                walk(child)

    walk(tree)
    return sorted(out, key=lambda x: -x[2])


def of_file(path: str, content: str) -> list[tuple[str, str, str, int, int]]:
    """(path, language, name, line, complexity) of the functions of a text; none for other extensions."""
    language = outline.LANGUAGES.get("." + path.lower().rpartition(".")[2])
    if not language or not content:
        return []
    return [(path, language, *f) for f in (of_source(content) if language == "python" else outline.functions(content, language))]


def function_complexity(files: DataFrame) -> DataFrame:
    """``path, language, name, line_start, complexity`` of the functions in ``files(path, content)``; null paths and contents have none."""

    def run(batches):
        for batch in batches:
            rows = [f for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in of_file(p or "", c or "")]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "language", "name", "line_start", "complexity"])

    return files.select("path", "content").mapInArrow(run, "path string, language string, name string, line_start int, complexity int")
