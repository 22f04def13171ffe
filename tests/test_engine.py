import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import js_imports, python_imports, tokens
from tessera.operators.chunks import CHUNK_SIZE, chunk_file, split_text
from tessera.operators.complexity import of_source
from tessera.plans.engine import Engine
from tessera.sources import files as fs
from tessera.sources import manifests
from tessera.streaming.index_stream import compact, current_chunks, keep_index

APP = "import util\nfrom . import helper\n\nclass Cart:\n    def add(self, item):\n        # TODO: check stock\n        if item and self:\n            return item\n\n    def total(self):\n        return 0\n\n\ndef checkout(cart):\n    return cart.total()\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    write = lambda name, text: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_bytes(text if isinstance(text, bytes) else text.encode()))
    write("src/app.py", APP)
    write("src/util.py", "def stock(item):\n    return 1\n")
    write("src/helper.py", "import util\n")
    write("src/__init__.py", "")
    write("tests/test_app.py", "import app\n\ndef test_cart():\n    assert True\n")
    write("web/main.ts", "import { x } from './lib/x';\nconst y = require('../src/none');\n")
    write("web/lib/x.ts", "export const x = 1; // FIXME later\n")
    write("node_modules/a/index.js", "ignored")
    write("pkg.egg-info/x.py", "ignored = 1")
    write("logo.png", b"\x89PNG")
    write("notes.txt", b"Caf\xe9 \xe0 la carte\r\nline")
    write("pyproject.toml", '[project]\ndependencies = [\n    "fastapi>=0.1",\n    "numpy==2.0 ; x",\n]\n[tool.ruff]\n[tool.pytest]\n')
    write("requirements.txt", "# c\n-r x\nflask\nnumpy>1\n")
    write("package.json", '{"dependencies": {"react": "^1"}, "devDependencies": {"jest": "~2", "x": "3.0"}}')
    write("go.mod", "module m\nrequire (\n\ta/b v1 // indirect\n)\nrequire (\n\tc v2\n)\n")
    write("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\n[dev]\ny = "2"\n')
    write("htmlcov/index.html", '<span class="pc_cov">87%</span>')
    return root


@pytest.fixture(scope="module")
def engine(spark, project, tmp_path_factory):
    commits = spark.createDataFrame([("abcdef0123", "abcdef0", "Fix stock", "Alice", "2024-05-01 10:00:00")], "hash string, short_hash string, message string, author string, d string").withColumn("date", F.col("d").cast("timestamp")).drop("d")
    files = spark.createDataFrame([("abcdef0123", "src/app.py")], "hash string, path string")
    return Engine(spark, str(project), str(tmp_path_factory.mktemp("state")), commits, files)


def test_scan(spark, project):
    got = {r.path for r in fs.scan_indexable(spark, str(project)).collect()}
    assert "src/app.py" in got and not any(x in p for p in got for x in ("node_modules", "egg-info", ".png", "htmlcov"))
    assert fs.scan_indexable(spark, str(project), max_files=5).count() == 5
    assert not any("test" in r.path for r in fs.scan_indexable(spark, str(project), ["test"]).collect())


def test_stores_are_listed_by_tasks(spark, tmp_path):
    for i in range(12):
        for name in (f"a{i}/b c/é.py", f"a{i}/node_modules/x.js", f"a{i}/_x.txt", f"d{i}/e/f/g/h.md"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(name)
    (tmp_path / "top.py").write_text("")
    want = {(r.path, r.size) for r in fs.tree(spark, str(tmp_path)).collect()}
    assert len(want) == 37
    for least in (1, 7, 64):
        got = fs.store_tree(spark, f"file://{tmp_path}", fs.IGNORED_DIRS, least).collect()
        assert {(r.path, r.size) for r in got} == want and len(got) == 37
        assert all(fs._read_bytes(r.uri) == (tmp_path / r.path).read_bytes() for r in got)


def test_decoding(spark):
    rows = [(b"Caf\xe9 \xe0",), ("Привет \U0001f600".encode(),), (b"\xef\xbb\xbfbom",), (b"a\r\nb\rc",)]
    got = [r[0] for r in spark.createDataFrame([(bytearray(x[0]),) for x in rows], "content binary").select(fs.decode(F.col("content"))).collect()]
    assert got == ["Café à", "Привет \U0001f600", "bom", "a\nb\nc"]


def test_paths(project):
    assert fs.validate_path(".", str(project)) == "" and fs.validate_path("src/app.py", str(project)) == "src/app.py"
    for bad in ("../../etc/passwd", "/etc/passwd", "", 123, None):
        with pytest.raises(ValueError):
            fs.validate_path(bad, str(project))


def test_imports(spark):
    text = "import a.b\nfrom c.d import e\nimport f, g\nfrom . import h"
    assert spark.createDataFrame([(text,)], "t string").select(python_imports(F.col("t"))).first()[0] == ["a", "c", "f", ""]
    js = "import x from 'm';\nrequire(\"n\");\nimport {y} from './z'"
    assert spark.createDataFrame([(js,)], "t string").select(js_imports(F.col("t"))).first()[0] == ["m", "n", "./z"]
    assert spark.createDataFrame([(" A\xa0b\tC ",)], "t string").select(tokens(F.col("t"))).first()[0] == ["a", "b", "c"]


def test_import_graph(engine):
    assert {(r.src, r.dst) for r in engine.edges().collect()} == {("src/app.py", "src/util.py"), ("src/app.py", "src/__init__.py"), ("src/helper.py", "src/util.py"), ("web/main.ts", "web/lib/x.ts")}


def test_manifests(engine):
    got = {(r.manifest, r.scope, r.name, r.version) for r in manifests.all_dependencies(engine._at_root()).collect()}
    assert got == {
        ("pyproject.toml", "prod", "fastapi", ">=0.1"), ("pyproject.toml", "prod", "numpy", "==2.0 ; x"), ("requirements.txt", "prod", "flask", ""), ("requirements.txt", "prod", "numpy", ">1"),
        ("package.json", "prod", "react", "^1"), ("package.json", "dev", "jest", "~2"), ("package.json", "dev", "x", "3.0"), ("go.mod", "prod", "a/b", "v1"), ("go.mod", "prod", "c", "v2"), ("Cargo.toml", "prod", "serde", "1.0"),
    }


def test_reports(engine):
    row = engine.detect_project_conventions().first()
    assert row.primary_language == "Python" and "ruff" in row.linting and "FastAPI" in row.framework and "pytest" in row.tests and row.test_pattern == "test_*.py"
    assert {(r.path, r.tag) for r in engine.find_todos().collect()} == {("src/app.py", "TODO"), ("web/lib/x.ts", "FIXME")}
    totals = engine.complexity_totals().first()
    assert totals.functions == 5 and totals.languages == {"python": 3}
    assert engine.analyze_code_complexity().count() == 0 and engine.analyze_code_quality().count() >= 1
    assert engine.get_test_coverage_info().first().percent == 87
    rows = engine.get_file_relations("src/util.py").collect()
    assert [r.other for r in rows if r.role == "imported by"] == ["src/app.py", "src/helper.py"] and {r.level for r in rows} == {"MEDIUM"}
    alone = engine.get_file_relations("src/__init__.py").collect()
    assert {r.role for r in alone} <= {"imported by", None}
    rows = engine.analyze_change_impact("src/util.py").collect()
    assert {(r.node, r.direct, r.total, r.level) for r in rows} == {("src/util.py", 2, 2, "MEDIUM")}
    assert [(r.path, r.depth) for r in rows if r.role == "dependent"] == [("src/app.py", 1), ("src/helper.py", 1)]
    assert [r.path for r in rows if r.role == "test"] == ["tests/test_app.py"]
    nothing = engine.analyze_change_impact("web/main.ts").collect()
    assert len(nothing) == 1 and (nothing[0].total, nothing[0].level, nothing[0].role) == (0, "MINIMAL", None)
    listing = engine.explore_directory("src").collect()
    assert [r.name for r in listing if r.short_hash] == ["app.py"]
    summary = engine.get_file_summary("src/app.py").first()
    assert summary.classes == ["class Cart:"] and "def checkout(cart):" in summary.functions
    assert {r.name for r in engine.extract_tech_stack().collect()} >= {"Python", "TypeScript", "React", "FastAPI"}
    assert engine.analyze_project_structure().filter("name = 'src'").first().n == 4
    assert engine.get_project_overview().first().commits == 1 and engine.generate_project_summary().first().python_files == 5
    assert engine.dependency_classes().first().total == 4
    assert set(engine.project_onboarding()) == {"overview", "conventions", "todos", "dependencies"}
    assert [(r.depth, r.path) for r in engine.get_dependencies_with_depth("src/app.py").collect()][:2] == [(1, "src/__init__.py"), (1, "src/util.py")]
    assert engine.find_dependency_path("src/helper.py", "src/util.py").first().length == 1
    assert [r.path for r in engine.get_module_cluster("src/app.py").collect()] == ["src/helper.py"]
    overview = engine.get_project_overview().first()
    assert overview.branch == "unknown" and row.test_folders == ["tests"]
    assert summary.commits == ["2024-05-01 [abcdef0] Fix stock (Alice)"] and summary.notes == []
    strategy = engine.dependency_strategy().first()
    assert (strategy.caret, strategy.tilde, strategy.exact) == (1, 1, 1)
    assert {(r.name, r.times, r.in_prod_and_dev) for r in engine.check_dependencies().filter("manifest = 'package.json'").collect()} == {("react", 1, False), ("jest", 1, False), ("x", 1, False)}
    assert engine.read_memory(None).filter("section = 'Onboarding'").count() == 1 and engine.read_memory(1).first().more > 0


def test_index_and_search(engine, project):
    with pytest.raises(ValueError):
        engine.search_codebase("cart")
    first = engine.index_codebase().first()
    assert first.status == "ready" and first.chunks > 5
    assert engine.search_codebase("checkout(cart):").first().source == "src/app.py"
    assert engine.search_codebase("checkout(cart):").first().source == "src/app.py"
    cached = engine.get_cache_stats().first()
    assert (cached.hits, cached.misses, cached.hit_rate, cached.size) == (1, 1, 50.0, 1)
    assert engine.search_summary("checkout(cart):").first().n_results == 1
    assert engine.search_codebase_advanced("def", 5, [".py"], ["tests"]).count() >= 1
    assert {r.path for r in engine.search_with_dependencies("checkout(cart):").collect()} >= {"src/app.py", "src/util.py"}
    assert engine.search_for_errors("stock").filter("category = 'commit'").count() == 1
    assert engine.search_for_feature("stock(item):").count() >= 1 and engine.search_architecture("stock(item):").count() >= 1
    for bad in (("", 5), ("  ", 5), ("x", -1), ("x", 100)):
        with pytest.raises(ValueError):
            engine.search_codebase(*bad)
    with pytest.raises(ValueError):
        engine.search_codebase_advanced("x", min_relevance=1.5)
    (project / "src" / "util.py").write_text("def renamed_thing(item):\n    return 2\n")
    import os

    os.utime(project / "src" / "util.py", (2_000_000_000, 2_000_000_000))
    (project / "src" / "fresh.py").write_text("def brandnew():\n    pass\n")
    engine.index_changed_files()
    assert engine.search_codebase("renamed_thing(item):").first().source == "src/util.py" and engine.search_codebase("brandnew():").count() == 1
    (project / "src" / "fresh.py").unlink()
    engine.index_codebase()
    assert engine.search_codebase("brandnew():").count() == 0
    bare = lambda: sorted(tuple(r) for r in engine.chunks().collect())
    before = bare()
    engine.index_codebase(force=True)
    assert bare() == before
    assert engine.session_init().first().changed_files == 1  # the empty file is tried again


def test_ignore_file_and_clearing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "keep.py").write_text("def kept():\n    pass\n")
    (tmp_path / "a" / "skip.py").write_text("def left_out():\n    pass\n")
    (tmp_path / ".indexignore").write_text("# comment\n\nskip\nskip\n")
    (tmp_path / "package.json").write_text('{"workspaces": []}')
    own = Engine(spark, str(tmp_path), str(tmp_path / "state-x"), branch="main")
    assert own._patterns() == ["skip"] and own.index_codebase().first().status == "ready"
    assert {r.source for r in own.chunks().collect()} >= {"a/keep.py"} and "a/skip.py" not in {r.source for r in own.chunks().collect()}
    assert own.get_project_overview().first().branch == "main" and own.detect_project_conventions().first().architecture == ["monorepo"]
    assert own.clear_index().first().status == "missing" and own.chunks().count() == 0


def test_logger(tmp_path):
    import json

    from tessera.log import setup_logger

    for _ in range(2):
        logger = setup_logger("tessera.test", str(tmp_path / "x.log"))
    logger.info("done %d", 3, extra={"rows": 7})
    (line,) = (tmp_path / "x.log").read_text().splitlines()
    assert {k: v for k, v in json.loads(line).items() if k != "time"} == {"level": "INFO", "logger": "tessera.test", "message": "done 3", "rows": 7}


def test_headers_inside_notes(engine):
    engine.clear_memory(keep_template=False)
    engine.update_memory("intro\n## Old Plan\nx\n### detail\ny\n## Next\nz", "Plans")
    assert not engine.delete_memory_section("nothing") and engine.delete_memory_section("old plan")
    assert [r.line for r in engine.read_memory(None).collect()] == ["intro", "## Next", "z"]
    assert engine.delete_memory_section("plans") and engine.read_memory(None).count() == 0


def test_hybrid_search(spark, project, tmp_path):
    def encoder(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(t.count(c)) for c in "abcdefgh"])

    own = Engine(spark, str(project), str(tmp_path / "s"), encoder=encoder)
    own.index_codebase()
    got = own.search_codebase("checkout cart", 5).collect()
    assert len(got) == 5 and any(r.distance is not None for r in got)


def test_memory(engine):
    assert engine.update_memory("use Spark") and not engine.update_memory("use Spark")
    assert engine.ingest_git_history() == 1 and engine.ingest_git_history() == 0
    assert engine.auto_update_memory_from_commits() == 1
    assert engine.save_conventions_to_memory() and engine.read_memory(1).count() == 1
    version = engine.save_memory_version("v")
    assert engine.delete_memory_section("decisions")
    engine.restore_memory_version(version)
    assert engine.read_memory(None).filter("line = 'use Spark'").count() == 1 and engine.list_memory_versions().count() == 2
    assert engine.get_recent_changes_summary().first().author == "Alice"
    engine.clear_memory()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=400), st.integers(5, 60))
def test_split_invariants(text, size):
    pieces = split_text(text, size, size // 10)
    assert all(0 < len(p) <= size for p in pieces)
    assert "".join(c for c in text if not c.isspace()) == "" or pieces
    if len(text) <= size:
        assert pieces == ([text] if text.strip() else [])


def test_chunks_of_python():
    rows = chunk_file("a.py", APP)
    assert [(r[3], r[4], r[5], r[6]) for r in rows] == [("method", "add", "Cart", 5), ("method", "total", "Cart", 10), ("function", "checkout", "", 14), ("module", "module_level", "", 1)]
    assert rows[0][1].startswith("# Class: Cart\n") and len({r[0] for r in rows}) == len(rows)
    assert chunk_file("b.py", "x = (")[0][3] == "text"
    long = "word " * 2000
    assert all(len(r[1]) <= CHUNK_SIZE for r in chunk_file("c.txt", long)) and [r[8] for r in chunk_file("c.txt", long)] == list(range(len(chunk_file("c.txt", long))))


def test_complexity():
    assert of_source("def a(x):\n    if x and x > 1:\n        return 1\n    for i in x:\n        pass\n") == [("a", 1, 4)] and of_source("x = (") == []


def test_git_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("commit\th1\th\tAnn\t1700000000\tOne\na.py\nb.py\n\ncommit\th2\th\t\t1600000000\tTwo\nc.py\n")
    commits, files = fs.read_git_log(spark, str(tmp_path / "log.txt"))
    assert {(r.hash, r.author) for r in commits.collect()} == {("h1", "Ann"), ("h2", "Unknown")} and files.count() == 3


def test_streamed_index(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, content string, mtime long"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        keep_index(spark.readStream.schema(schema).json(source), at, str(tmp_path / "ck")).awaitTermination()
        return {(r.source, r.text) for r in current_chunks(spark, at).collect()}

    assert feed([("a.txt", "one", 1), ("b.txt", "two", 1)]) == {("a.txt", "one"), ("b.txt", "two")}
    assert feed([("a.txt", "three", 2), ("b.txt", None, 2), (None, "x", 2)]) == {("a.txt", "three")}
    assert compact(spark, at) == 1 and {(r.source, r.text) for r in current_chunks(spark, at).collect()} == {("a.txt", "three")}
    assert feed([("b.txt", "four", 3)]) == {("a.txt", "three"), ("b.txt", "four")} and compact(spark, at) == 2 == compact(spark, at)
    assert feed([("a.txt", None, 4)]) == {("b.txt", "four")} and compact(spark, str(tmp_path / "none")) == -1
