"""Repositories made by the git program, read as tables, against the program's own listing of the same history."""

import os
import random
import shutil
import subprocess
from datetime import UTC, datetime

import pytest

from tessera.plans.engine import Engine
from tessera.sources import repository as R

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git program")


def git(at, *args, date=None, data=None):
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1", "HOME": str(at), "LC_ALL": "C.UTF-8"}
    if date is not None:
        env |= {"GIT_AUTHOR_DATE": f"{date - 50} +0200", "GIT_COMMITTER_DATE": f"{date} +0100"}
    who = ["-c", "user.name=Änne Example", "-c", "user.email=a@example.org", "-c", "core.quotePath=false"]
    return subprocess.run(["git", *who, *args], cwd=at, env=env, input=data, check=True, capture_output=True).stdout


def write(at, name, text):
    (at / name).parent.mkdir(parents=True, exist_ok=True)
    (at / name).write_text(text)


def commit(at, date, message="change"):
    git(at, "add", "-A")
    git(at, "commit", "-q", "--allow-empty", "-m", message, date=date)


def history(at, seed=0):
    """Changes, moves, removals, folders that become files, modes, branches, merges, an empty and an unreachable commit."""
    rng = random.Random(seed)
    git(at, "init", "-q", "-b", "main")
    now = 1_700_000_000
    for i in range(25):
        now += rng.randrange(1, 5000)
        for _ in range(rng.randrange(0, 4)):
            write(at, f"{rng.choice('bc' if i in (7, 8, 9) else 'abc')}/{rng.choice('xyz')}/{rng.randrange(4)}.txt", "line\n" * rng.randrange(1, 300) + str(rng.random()))
        write(at, "long.txt", "\n".join(f"row {k} {k // (i + 1)}" for k in range(3000)))
        if i == 5:
            git(at, "mv", "long.txt", "moved é.txt")
        if i == 7:
            shutil.rmtree(at / "a", ignore_errors=True)
            (at / "a").write_text("now a file")
        if i == 9:
            (at / "a").unlink()
            write(at, "a/x/again.txt", "folder again")
        if i == 11 and (at / "a/x/again.txt").exists():
            os.chmod(at / "a/x/again.txt", 0o755)
        commit(at, now, f"step {i}\n\nbody of {i} — ü\n")
        if i in (6, 12, 18):
            git(at, "checkout", "-q", "-b", f"side{i}", "HEAD~2")
            for k in range(3):
                now += 60
                write(at, f"side{i}/{k}.txt", f"{i} {k}")
                commit(at, now, f"side {i} {k}")
            git(at, "checkout", "-q", "main")
            now += 60
            git(at, "merge", "-q", "--no-ff", "-m", f"merge {i}", f"side{i}", date=now)
    git(at, "checkout", "-q", "-b", "loose-end", "HEAD~4")
    write(at, "never/merged.txt", "x")
    commit(at, now + 5, "not on main")
    git(at, "checkout", "-q", "main")
    commit(at, now + 9, "empty")


def listed(at, *what):
    """The program's listing: commits, and the paths each changed against its first parent."""
    raw = git(at, "log", "--format=%x01%H%x02%h%x02%B%x02%an%x02%ct%x02%P%x02", "--name-status", "--no-renames", "--diff-merges=first-parent", "--abbrev=7", "-z", *what).decode()
    commits, files = {}, set()
    for part in raw.split("\x01")[1:]:
        key, short, message, author, stamp, parents, rest = part.split("\x02")
        commits[key] = (short, message.strip(), author, int(stamp), parents.split())
        cells = [c for c in rest.strip("\n").split("\0") if c.strip("\n")]
        files |= {(key, path, status.strip("\n")) for status, path in zip(cells[::2], cells[1::2])}
    return commits, files


def as_read(spark, at, earlier=None):
    commits, files = R.read_log(spark, R.Repository.find(str(at)), earlier)
    rows = {r.hash: (r.short_hash, r.message, r.author, int(r.date.timestamp()), r.parents) for r in commits.collect()}
    return rows, {(r.hash, r.path, r.status) for r in files.collect()}


@pytest.fixture(scope="module")
def loose(tmp_path_factory):
    at = tmp_path_factory.mktemp("loose")
    history(at)
    return at


@pytest.fixture(scope="module")
def packed(loose, tmp_path_factory):
    """The same repository with two packs, one with long chains of deltas, and some objects of their own."""
    at = tmp_path_factory.mktemp("packed") / "repo"
    shutil.copytree(loose, at)
    git(at, "repack", "-q", "-a", "-d", "--depth=40", "--window=40")
    for i in range(4):
        write(at, f"later/{i}.txt", "x" * i)
        commit(at, 1_800_000_000 + i, f"later {i}")
    git(at, "repack", "-q", "-d")
    write(at, "last.txt", "x")
    commit(at, 1_800_000_100, "last")
    git(at, "pack-refs", "--all")
    return at


def test_loose_objects(spark, loose):
    assert as_read(spark, loose) == listed(loose)
    assert len(listed(loose)[0]) == 26 + 12


def test_packs_with_deltas(spark, packed):
    assert len(list((packed / ".git/objects/pack").glob("*.idx"))) == 2
    depths = git(packed, "verify-pack", "-v", *map(str, (packed / ".git/objects/pack").glob("*.idx"))).decode()
    assert any(" tree " in line and len(line.split()) == 7 for line in depths.split("\n"))
    assert as_read(spark, packed) == listed(packed)


def test_deltas_by_name(spark, packed, tmp_path):
    shutil.copytree(packed, tmp_path / "repo")
    pack = tmp_path / "repo/.git/objects/pack"
    names = git(packed, "rev-list", "--objects", "--all").decode().split("\n")
    made = git(packed, "pack-objects", "--stdout", "--no-reuse-delta", "--depth=20", "--window=20", data="\n".join(n.split(" ")[0] for n in names if n).encode())
    for old in [*pack.iterdir()]:
        os.chmod(old, 0o644)
        old.unlink()
    shutil.rmtree(tmp_path / "repo/.git/objects/00", ignore_errors=True)
    git(tmp_path / "repo", "index-pack", "--stdin", data=made)
    assert as_read(spark, tmp_path / "repo") == listed(packed)
    (only,) = (R.Pack(str(p)) for p in pack.glob("*.pack"))
    offsets = [r["at"] for p in R.EntriesReader([str(pack.parent)]).partitions() for b in R.EntriesReader([]).read(p) for r in b.to_pylist()]
    assert any(only._head(at)[0] == R.NAME_DELTA for at in offsets if at is not None)


def test_ranges_of_an_index(spark, packed, monkeypatch):
    spark.dataSource.register(R.RepositoryEntries)
    whole = {(r.id, r.place, r.at) for r in spark.read.format("repository_entries").option("stores", f'["{packed}/.git/objects"]').load().collect()}
    monkeypatch.setattr(R, "ENTRIES", 37)
    monkeypatch.setattr(R, "ROWS", 5)
    reader = R.EntriesReader([f"{packed}/.git/objects"])
    parts = reader.partitions()
    assert len(parts) > 20
    cut = {(x["id"], x["place"], x["at"]) for p in parts for b in reader.read(p) for x in b.to_pylist()}
    assert cut == whole and any(at is None for _, _, at in cut)


def test_branches_and_heads(spark, loose, tmp_path):
    found = R.Repository.find(str(loose / "b/x"))
    assert found.branch == "main" and found.head == git(loose, "rev-parse", "HEAD").decode().strip()
    assert R.Repository.find(str(tmp_path)) is None
    at = tmp_path / "copy"
    shutil.copytree(loose, at)
    git(at, "checkout", "-q", "side12")
    assert R.Repository.find(str(at)).branch == "side12"
    assert as_read(spark, at) == listed(at)
    git(at, "checkout", "-q", "--detach", "HEAD~1")
    assert R.Repository.find(str(at)).branch == "unknown"
    assert as_read(spark, at)[0] == listed(at)[0]
    git(at, "worktree", "add", "-q", str(tmp_path / "tree"), "main")
    assert R.Repository.find(str(tmp_path / "tree")).branch == "main"
    assert as_read(spark, tmp_path / "tree") == listed(tmp_path / "tree")
    git(tmp_path, "clone", "-q", "--shared", "--bare", str(loose), "bare.git")
    assert as_read(spark, tmp_path / "bare.git") == listed(loose)


def test_before_the_first_commit_and_shallow(spark, loose, tmp_path):
    (tmp_path / "new").mkdir()
    git(tmp_path / "new", "init", "-q", "-b", "main")
    assert as_read(spark, tmp_path / "new") == ({}, set())
    git(tmp_path, "clone", "-q", "--depth", "3", f"file://{loose}", "shallow")
    commits, files = as_read(spark, tmp_path / "shallow")
    want = listed(tmp_path / "shallow")
    assert set(commits) == set(want[0]) and files == want[1]


def test_only_new_commits_are_compared(spark, loose, packed):
    found = R.Repository.find(str(loose))
    earlier = R.read_log(spark, found)
    assert as_read(spark, packed, earlier) == listed(packed)


def test_odd_commits():
    raw = b"tree aa\nparent bb\nparent cc\nauthor  <> 1 +0000\ncommitter X <x@y> 7 -0500\nencoding latin1\ngpgsig -----\n parent dd\n\n\n caf\xe9 \n"
    assert R.parsed_commit(raw) == ("aa", ["bb", "cc"], "Unknown", 7, "café")
    assert R.parsed_commit(b"tree aa\nencoding nonsense\n\n\xff") == ("aa", [], "Unknown", 0, "�")
    assert R.patched(b"0123456789", bytes([10, 6, 0b10010001, 2, 3, 3]) + b"xyz") == b"234xyz"
    with pytest.raises(ValueError):
        R.patched(b"0123456789", bytes([10, 9, 3]) + b"xyz")


def test_engine_reads_its_own_repository(spark, packed, tmp_path):
    engine = Engine(spark, str(packed), str(tmp_path / "state"))
    row = engine.get_project_overview().first()
    assert row.branch == "main" and row.commits == len(listed(packed)[0])
    want = listed(packed)[0]
    newest = max(want.values(), key=lambda c: c[3])
    assert row.last_commit == datetime.fromtimestamp(newest[3], UTC).replace(tzinfo=None)
    told = [r.short_hash for r in engine.get_recent_changes_summary(365).selectExpr("explode(messages) short_hash").collect()]
    assert told
    shown = engine.get_file_summary("last.txt").first()
    assert len(shown.commits) == 1 and "last" in shown.commits[0]
    write(packed, "more.txt", "y")
    commit(packed, 1_800_000_200, "more")
    assert engine.get_project_overview().first().commits == len(want) + 1
    assert len(engine.get_file_summary("more.txt").first().commits) == 1


def test_packs_that_tasks_write(spark, loose, tmp_path):
    """Objects of a repository, written again as packs, are what the program itself reads."""
    names = [n.split(" ")[0] for n in git(loose, "rev-list", "--objects", "--all").decode().split("\n") if n]
    kinds = {n: git(loose, "cat-file", "-t", n).decode().strip() for n in names}
    rows = [(n, k, git(loose, "cat-file", k, n)) for n, k in kinds.items()]
    assert all(R.object_name(k, c) == n for n, k, c in rows)
    git(tmp_path, "init", "-q", "--bare", "-b", "main", "made.git")
    R.write_packs(spark.createDataFrame(rows + rows[:5], "id string, kind string, content binary").repartition(4), str(tmp_path / "made.git"))
    git(tmp_path / "made.git", "update-ref", "refs/heads/main", R.Repository.find(str(loose)).head)
    git(tmp_path / "made.git", "fsck", "--strict")
    assert listed(tmp_path / "made.git") == listed(loose) == as_read(spark, tmp_path / "made.git")
    tree, parents, author, seconds, message = R.parsed_commit(R.commit_content("aa", ["bb"], "me", 5, "x\n"))
    assert (tree, parents, author, seconds, message) == ("aa", ["bb"], "me", 5, "x")
