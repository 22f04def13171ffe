"""Splitting texts into chunks: by definitions (Python by the standard parser, other languages by outline), or by characters.

A chunk is ``chunk_id, text, source, symbol_type, symbol_name, class_name, line_start, line_end, chunk_index``.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import outline

# Characters of a chunk and of its overlap, separators in order.
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 150
SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK = "chunk_id string, text string, source string, symbol_type string, symbol_name string, class_name string, line_start int, line_end int, chunk_index int"


def _merge(pieces: list[str], joint: str, size: int, overlap: int) -> list[str]:
    """Join pieces into chunks of at most ``size``; the next starts with as many last pieces as ``overlap`` holds."""
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(joint) + len(piece) > size:
            out.append(joint.join(held))
            while held and (total > overlap or total + len(joint) + len(piece) > size):
                total -= len(held.pop(0)) + (len(joint) if held else 0)
        total += len(piece) + (len(joint) if held else 0)
        held.append(piece)
    if held:
        out.append(joint.join(held))
    return [c for c in (x.strip() for x in out) if c]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that occurs, long pieces at the next ones."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(k for k, s in enumerate(separators) if not s or s in text)
    if not separators[at]:
        step = max(1, size - overlap)
        return [c for c in (text[i : i + size].strip() for i in range(0, max(1, len(text) - overlap), step)) if c]
    out, small = [], []
    for piece in text.split(separators[at]):
        if len(piece) <= size:
            small += [piece] if piece else []
            continue
        out += _merge(small, separators[at], size, overlap)
        small = []
        out += split_text(piece, size, overlap, separators[at + 1 :])
    return out + _merge(small, separators[at], size, overlap)


def _symbols(content: str) -> list[tuple[str, str, str, str, int, int]]:
    """(text, type, name, class, first line, last line) of top-level definitions and methods; the rest of the module in one."""
    tree, rows = ast.parse(content), content.split("\n")
    cut = lambda node: (min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno)
    body = lambda a, b: "\n".join(rows[a - 1 : b])
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    out, rest = [], []
    for node in tree.body:
        a, b = cut(node)
        if isinstance(node, functions):
            out.append((body(a, b), "function", node.name, "", a, b))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, functions)]
            out += [(f"# Class: {node.name}\n{body(*cut(m))}", "method", m.name, node.name, *cut(m)) for m in methods] or [(body(a, b), "class", node.name, node.name, a, b)]
        else:
            rest.append((a, b))
    if not out:
        raise ValueError("no definition")
    if rest:
        out.append(("\n".join(body(a, b) for a, b in rest), "module", "module_level", "", 1, len(rows)))
    return out


def _outlined(content: str, language: str) -> list[tuple[str, str, str, str, int, int]]:
    """The same for a language without a parser here; a class with methods is its methods, another one is whole."""
    line = lambda at: content.count("\n", 0, at) + 1
    out, rest, upto = [], [], 0
    for d in outline.definitions(content, language):
        rest.append(content[upto : d.start])
        upto = d.end
        text = content[d.start : d.end]
        if d.kind == "class":
            inner = outline.methods(content, language, d.body) if d.body else []
            out += [(f"# Class: {d.name}\n{content[m.start : m.end]}", "method", m.name, d.name, line(m.start), line(m.end)) for m in inner] or [(text, "class", d.name, d.name, line(d.start), line(d.end))]
        else:
            out.append((text, "function", d.name, "", line(d.start), line(d.end)))
    if not out:
        raise ValueError("no definition")
    left = "\n".join(x.strip() for x in [*rest, content[upto:]] if x.strip())
    return [*out, (left, "module", "module_level", "", 1, line(len(content)))] if left else out


def chunk_file(path: str, content: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple]:
    """Rows of a chunk table for one text: by its definitions where its extension names a language, else, and where none is found, by characters."""
    symbols, language = None, outline.LANGUAGES.get("." + path.lower().rpartition(".")[2])
    if language:
        try:
            symbols = _symbols(content) if language == "python" else _outlined(content, language)
        except (SyntaxError, ValueError, RecursionError):
            symbols = None
    out = []
    if symbols is None:
        symbols = [(content, "text", "", "", 0, 0)]
    for text, kind, name, owner, a, b in symbols:
        for i, piece in enumerate(split_text(text, size, overlap)):
            ident = f"{path}_{kind}_{owner + '.' if owner else ''}{name}_{a}_{i}"
            out.append((ident, piece, path, kind, name, owner, a, b, i))
    return out


#: Rows of a batch that are read at a time, and characters of chunks that a task holds before it hands them on.
READ, HELD = 64, 1 << 21


def _rows(batch: pa.RecordBatch, size: int, overlap: int):
    """Chunks of the texts of a batch, in lists of some HELD characters."""
    held, characters = [], 0
    for at in range(0, batch.num_rows, READ):
        part = batch.slice(at, READ)
        for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if not content or not content.strip():
                continue
            for row in chunk_file(path or "", content, size, overlap):
                held.append(row)
                characters += len(row[1]) + 100
                if characters > HELD:
                    yield held
                    held, characters = [], 0
    yield held


def chunk_texts(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of ``files(path, content)``; blank and null contents give none. Rows stay where they are."""

    names = [c.split(" ")[0] for c in CHUNK.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int32()] * 3

    def run(batches):
        for batch in batches:
            for rows in _rows(batch, size, overlap):
                columns = list(zip(*rows)) if rows else [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, CHUNK)
