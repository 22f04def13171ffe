"""File trees, decoded texts, notes and commit logs as DataFrames."""

from __future__ import annotations

import os
from itertools import islice
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import base_name, extension, js_imports, python_imports, strip

# Directories left out, and extensions by kind.
IGNORED_DIRS = frozenset(".git node_modules .ai venv .venv __pycache__ .idea .vscode dist build target vendor bin obj out logs tmp temp .cache .gradle .pytest_cache .mypy_cache .ruff_cache htmlcov .coverage .tox".split())
IGNORED_DIR_SUFFIX = ".egg-info"
BINARY = frozenset(".pyc .pyo .pyd .so .dll .class .exe .bin .obj .o .a .lib .dylib .jpg .jpeg .png .gif .bmp .ico .svg .mp4 .mp3 .wav .avi .mov .pdf .zip .tar .gz .rar .7z".split())
CODE = frozenset(".py .js .ts .jsx .tsx .java .c .cpp .h .hpp .cs .go .rs .rb .php .swift .kt .scala .r .m .mm .sh .bash .zsh .fish".split())
TEXT = frozenset(".txt .md .rst .json .yaml .yml .toml .xml .html .css .scss .sass .sql .graphql .proto".split())
MAX_FILE_BYTES = 10 * 1024 * 1024

#: Folders of a store that the driver finds before tasks list what is below them.
FOLDERS = 64


def max_file_bytes() -> int:
    """The size limit; ``MAX_FILE_SIZE_MB`` in the environment overrides it if it is a positive number."""
    try:
        size = float(os.environ.get("MAX_FILE_SIZE_MB", ""))
        return int(size * 1024 * 1024) if size > 0 else MAX_FILE_BYTES
    except ValueError:
        return MAX_FILE_BYTES


def is_dir_ignored(name: str, ignored: frozenset[str] = IGNORED_DIRS) -> bool:
    return name in ignored or name.endswith(IGNORED_DIR_SUFFIX)


def validate_path(path: str, root: str) -> str:
    """The path relative to the root ('' for the root itself); ValueError for what is not a path inside it."""
    if not isinstance(path, str) or not path.strip():
        raise ValueError("path must be a non-empty string")
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"{path} is outside the project")
    return "" if full == base else full.relative_to(base).as_posix()


def read_ignore_patterns(spark: SparkSession, *uris: str) -> list[str]:
    """Lines of the first ignore file that exists, without blanks and comments, in order and once."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):  # its name starts with a dot, so Spark's own sources pass over it
            stream = system.open(path)
            rows = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            stream.close()
            return list(dict.fromkeys(x.strip() for x in rows if x.strip() and not x.lstrip().startswith("#")))
    return []


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else ISO-8859-1; no byte order mark; line ends as \\n."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def _walk_local(root: str, ignored: frozenset[str]):
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not is_dir_ignored(d, ignored))
        for name in sorted(names):
            full = os.path.join(folder, name)
            if os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/"), full, os.path.getsize(full), os.path.getmtime(full)


def _list_below(uri: str, base: str, ignored: frozenset[str]):
    """``path, uri, size, seconds`` of the files below a folder of a store; run by tasks."""
    system, top = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    todo = [("", top)]
    while todo:
        under, folder = todo.pop()
        for found in system.get_file_info(fs.FileSelector(folder)):
            name = found.base_name
            if found.type == fs.FileType.Directory:
                todo += [] if is_dir_ignored(name, ignored) else [(f"{under}{name}/", found.path)]
            elif found.type == fs.FileType.File:
                yield f"{base}{under}{name}", f"{uri}/{under}{name}", found.size, (found.mtime_ns or 0) / 1e9


_LISTED = "path string, uri string, size long, seconds double"


def store_tree(spark: SparkSession, root: str, ignored: frozenset[str], least: int = FOLDERS) -> DataFrame:
    """The files below a folder of a store: the driver opens folders until it knows ``least`` of them, tasks list these."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rows, todo = [], [("", root.rstrip("/"))]
    while todo and len(todo) < least:
        base, folder = todo.pop(0)
        for s in system.listStatus(path(folder)):
            name = s.getPath().getName()
            if not s.isDirectory():
                rows.append((base + name, f"{folder}/{name}", s.getLen(), s.getModificationTime() / 1000))
            elif not is_dir_ignored(name, ignored):
                todo.append((f"{base}{name}/", f"{folder}/{name}"))
    known = spark.createDataFrame(rows, _LISTED)
    if not todo:
        return known

    def run(batches):
        for batch in batches:
            for base, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _list_below(uri, base, ignored)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["path", "uri", "size", "seconds"])

    return known.unionAll(spark.createDataFrame(todo, "base string, uri string").repartition(len(todo)).mapInArrow(run, _LISTED))


def tree(spark: SparkSession, root: str, ignored: frozenset[str] = IGNORED_DIRS) -> DataFrame:
    """``path, ext, size, mtime, uri`` of all files below ``root`` outside ignored directories; paths are relative.

    Spark's own file source passes over names that start with an underscore, so trees are listed here, ignored
    directories are never entered, and no file is opened. A root without a scheme, or with ``file``, is a folder of the
    driver's machine and listed there; other stores are listed by tasks.
    """
    local = root.removeprefix("file://")
    found = spark.createDataFrame(list(_walk_local(local, ignored)), _LISTED) if "://" not in local else store_tree(spark, root, ignored)
    return found.select("path", extension(F.col("path")).alias("ext"), "size", F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long")).alias("mtime"), "uri")


def _read_bytes(uri: str) -> bytes:
    if "://" not in uri or uri.startswith("file:"):
        with open(uri.removeprefix("file://").removeprefix("file:"), "rb") as f:
            return f.read()
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    with system.open_input_file(path) as f:
        return f.read()


def with_content(files: DataFrame) -> DataFrame:
    """``files`` (from ``tree``, after filters) with their bytes as ``content``; tasks open the files."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                content = pa.array([_read_bytes(u) for u in part.column("uri").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, content], names=[*part.schema.names, "content"])

    return files.select("path", "ext", "size", "mtime", "uri").mapInArrow(run, "path string, ext string, size long, mtime timestamp, uri string, content binary")


def indexable(patterns: list[str] = (), max_bytes: int | None = None) -> Column:
    """Not binary; a known extension or none; no pattern inside the path; not too large."""
    known = F.col("ext") == ""
    keep = ~F.col("ext").isin(*sorted(BINARY)) & (known | F.col("ext").isin(*sorted(CODE | TEXT))) & (F.col("size") <= (max_bytes or max_file_bytes()))
    for p in patterns:
        keep &= ~F.contains(F.col("path"), F.lit(p))
    return keep


def scan_indexable(spark: SparkSession, root: str, patterns: list[str] = (), ignored: frozenset[str] = IGNORED_DIRS, max_files: int | None = 20_000) -> DataFrame:
    """Files to index, in order of path, the first ``max_files``."""
    found = tree(spark, root, ignored).filter(indexable(patterns))
    return found if max_files is None else found.orderBy("path").limit(max_files)


def scan_code(spark: SparkSession, root: str, ignored: frozenset[str] = IGNORED_DIRS, max_files: int | None = 5000) -> DataFrame:
    """Code files outside ignored and dotted directories."""
    dotted = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda x: x.startswith("."))
    found = tree(spark, root, ignored).filter(~dotted & F.col("ext").isin(*sorted(CODE)))
    return found if max_files is None else found.orderBy("path").limit(max_files)


def texts(files: DataFrame) -> DataFrame:
    """``path, ext, size, mtime, text``."""
    return with_content(files).select("path", "ext", "size", "mtime", decode(F.col("content")).alias("text"))


def import_graph(files: DataFrame) -> DataFrame:
    """``src, dst`` of imports between ``files(path, ext, text)``: the first candidate path that is a file, itself left out."""
    folder = F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/$", "")
    under = lambda base, tail: F.when(base == "", tail).otherwise(F.concat(base, F.lit("/"), tail))
    py = files.filter("ext = '.py'").select("path", folder.alias("dir"), F.explode(python_imports(F.col("text"))).alias("imp"))
    module = F.replace("imp", F.lit("."), F.lit("/"))
    package = lambda base: under(base, F.when(module == "", F.lit("__init__.py")).otherwise(F.concat(module, F.lit("/__init__.py"))))
    py = py.select("path", F.posexplode(F.array(under(F.col("dir"), F.concat(module, F.lit(".py"))), F.concat(module, F.lit(".py")), package(F.col("dir")), package(F.lit("")))).alias("rank", "dst"), "imp")
    js = files.filter(F.col("ext").isin(".js", ".ts", ".jsx", ".tsx")).select("path", folder.alias("dir"), F.explode(js_imports(F.col("text"))).alias("imp")).filter("imp like '.%'")
    endings = F.array(*[F.lit(x) for x in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")])
    js = js.select("path", F.posexplode(F.transform(endings, lambda e: _plain_path(under(F.col("dir"), F.concat(F.col("imp"), e))))).alias("rank", "dst"), "imp")
    real = files.select(F.col("path").alias("dst")).distinct()
    met = py.unionByName(js).join(real, "dst").filter("path <> dst")
    return met.groupBy("path", "imp").agg(F.min_by("dst", "rank").alias("dst")).select(F.col("path").alias("src"), "dst").distinct()


def _plain_path(path: Column) -> Column:
    """Without . and .. parts; null where it leaves the tree."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.array_append(acc, x)),
    )
    return F.array_join(fold, "/")


def directory_listing(files: DataFrame, path: str = "", depth: int = 1, max_items: int = 100) -> DataFrame:
    """``name, parent, is_dir, size, mtime`` of what lies up to ``depth`` levels below ``path``: directories first, then by name."""
    depth, max_items = min(3, max(1, depth)), min(500, max(1, max_items))
    base = path.strip("/")
    inside = files.filter(F.col("path").startswith(base + "/")) if base else files
    parts = F.split(F.substr("path", F.lit(len(base) + 2)) if base else F.col("path"), "/")
    rows = inside.select(parts.alias("p"), "size", "mtime").select("p", "size", "mtime", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth)))).alias("level"))
    rows = rows.select(F.element_at("p", F.col("level")).alias("name"), F.array_join(F.slice("p", 1, F.col("level") - 1), "/").alias("parent"), (F.col("level") < F.size("p")).alias("is_dir"), "size", "mtime")
    grouped = rows.groupBy("parent", "name", "is_dir").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    return grouped.orderBy("parent", F.desc("is_dir"), F.lower("name")).limit(max_items)


def file_summary(files: DataFrame, path: str, max_lines: int = 50) -> DataFrame:
    """One row: lines, imports, classes, functions, exports and a preview of one text of ``files(path, text)``."""
    rows = F.split("text", "\n")
    take = lambda cond: F.transform(F.filter(rows, cond), F.trim)
    start = lambda x, *heads: F.ltrim(x).rlike("^(?:" + "|".join(heads) + ")")
    return files.filter(F.col("path") == path).select(
        "path", base_name(F.col("path")).alias("name"), F.size(rows).alias("lines"),
        take(lambda x: start(x, r"import\s", r"from\s+\S+\s+import", r"const .*require\(")).alias("imports"),
        take(lambda x: start(x, r"class\s", r"export (?:default )?class\s")).alias("classes"),
        take(lambda x: start(x, r"def\s", r"async def\s", r"(?:export )?(?:async )?function\s")).alias("functions"),
        take(lambda x: start(x, r"export\s", r"module\.exports")).alias("exports"),
        F.slice(rows, 1, min(500, max(0, max_lines))).alias("preview"),
    )


def coverage_percent(files: DataFrame) -> DataFrame:
    """``path, percent`` of coverage reports; null where the page names none."""
    found = F.regexp_extract("text", r'<span class="pc_cov">(\d+)%</span>', 1)
    return files.select("path", F.when(found != "", found.cast("int")).alias("percent"))


def read_git_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``commits`` and ``commit_files`` from a text export of a log: for each commit a line
    ``commit<TAB>hash<TAB>short<TAB>author<TAB>epoch seconds<TAB>subject``, then its paths, one to a line."""
    rows = spark.read.text(path, lineSep="\n\n", wholetext=False).filter("trim(value) <> ''").select(F.split(strip(F.col("value")), "\n").alias("l"))
    head = F.split(F.element_at("l", 1), "\t", 6)
    rows = rows.filter(F.element_at("l", 1).startswith("commit\t")).select(head.alias("h"), F.slice("l", F.lit(2), F.size("l")).alias("paths"))
    field = lambda k: F.get("h", F.lit(k))
    commits = rows.select(field(1).alias("hash"), field(2).alias("short_hash"), field(5).alias("message"), F.when(field(3) == "", "Unknown").otherwise(field(3)).alias("author"), F.timestamp_seconds(field(4).cast("long")).alias("date"))
    return commits, rows.select(field(1).alias("hash"), F.explode("paths").alias("path"))
