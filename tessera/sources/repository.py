"""A git repository as tables: its commits, and which paths each of them changed.

``repository_entries`` is a data source over the object store: a partition is a range of a pack's index, or some folders of
loose objects. The entries are dealt to tasks in order of pack and offset, so that deltas mostly meet a base that their
task has just inflated; commits and trees are decoded, file contents are left alone. What a commit changed comes from
joins of its tree with its first parent's, level by level: equal subtrees have equal ids and go no further.

Reads ``.git`` folders and files (worktrees), bare repositories, alternates, loose objects, packs with index version 2 and
both kinds of deltas, packed and loose refs; SHA-1 names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections import Counter, OrderedDict
from dataclasses import dataclass
from itertools import accumulate, islice
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.shared import cut_lineage, stored

#: Entries of a pack's index in a partition, and folders of loose objects in one.
ENTRIES, LOOSE_FOLDERS = 1 << 16, 16
#: Rows of a batch that a partition is read in.
ROWS = 1 << 14
#: Bytes of inflated objects that a task keeps for the deltas that follow, and offsets whose kind it remembers.
KEPT_BYTES, KNOWN_KINDS = 32 << 20, 1 << 20

# Fixed values of the pack format.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAME_DELTA = 6, 7
INDEX_MAGIC, INDEX_HEAD, FANOUT = b"\xfftOc\x00\x00\x00\x02", 8, 1024
FOLDER_MODE = "40000"

_ENTRY = "id string, place string, at long"
_OBJECT = "id string, kind string, content binary"
_COMMIT = "hash string, short_hash string, message string, author string, date timestamp, tree string, parents array<string>"
_TREE = "tree string, name string, mode string, child string"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parsed.path)) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def _read(system: fs.FileSystem, path: str) -> str | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as source:
        return source.read().decode("utf-8", "replace")


def _is_folder(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.Directory


@dataclass(frozen=True)
class Repository:
    """Where a repository lies: its folder, the folder shared by its worktrees, the commit and branch it stands at."""

    uri: str
    common: str
    head: str | None
    branch: str

    @classmethod
    def find(cls, root: str) -> Repository | None:
        """The repository of a folder or the nearest one above it; None if there is none.

        ``branch`` is "unknown" where no branch is checked out; ``head`` is null before the first commit.
        """
        system, at = _place(root)
        at = at.rstrip("/") or "/"
        while True:
            for found in (f"{at.rstrip('/')}/.git", at):
                told = _read(system, found)
                if told is not None and told.startswith("gitdir:"):
                    found = told[7:].strip()
                    found = found if found.startswith("/") else f"{at}/{found}"
                head = _read(system, f"{found}/HEAD")
                if head is not None and (_is_folder(system, f"{found}/objects") or _read(system, f"{found}/commondir") is not None):
                    return cls._made(system, root, found, head.strip())
            if at == "/" or "/" not in at:
                return None
            at = at.rpartition("/")[0] or "/"

    @classmethod
    def _made(cls, system: fs.FileSystem, root: str, found: str, head: str) -> Repository:
        common = (_read(system, f"{found}/commondir") or "").strip()
        common = found if not common else common if common.startswith("/") else f"{found}/{common}"
        scheme = urlparse(root).scheme
        uri = lambda path: path if scheme in ("", "file") else f"{scheme}://{urlparse(root).netloc}{path[path.index('/'):]}"
        if not head.startswith("ref:"):
            return cls(uri(found), uri(common), head, "unknown")
        ref = head[4:].strip()
        name = next((t.strip() for t in (_read(system, f"{x}/{ref}") for x in (found, common)) if t), None)
        if name is None:
            packed = re.search(rf"^([0-9a-f]{{40}}) {re.escape(ref)}$", _read(system, f"{common}/packed-refs") or "", re.M)
            name = packed[1] if packed else None
        return cls(uri(found), uri(common), name, ref.removeprefix("refs/heads/"))

    def stores(self) -> list[str]:
        """The object folders, alternates included."""
        system, at = _place(f"{self.common}/objects")
        found, look = [], [at]
        while look:
            one = look.pop()
            if one in found or not _is_folder(system, one):
                continue
            found.append(one)
            more = (_read(system, f"{one}/info/alternates") or "").split("\n")
            look += [x if x.startswith("/") else f"{one}/{x}" for x in map(str.strip, more) if x and not x.startswith("#")]
        return found if isinstance(system, fs.LocalFileSystem) else [f"{self.common}/objects"]


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``last`` of a pack's index, or the folders of loose objects with these numbers."""

    place: str
    first: int
    last: int
    loose: bool


class RepositoryEntries(DataSource):
    """``id, place, at``: each object of the folders in the option ``stores`` (JSON): the file it is in, its offset there (null: a file of its own)."""

    @classmethod
    def name(cls) -> str:
        return "repository_entries"

    def schema(self) -> str:
        return _ENTRY

    def reader(self, schema) -> EntriesReader:
        return EntriesReader(json.loads(self.options["stores"]))


class EntriesReader(DataSourceReader):
    def __init__(self, stores: list[str]):
        self.stores = stores

    def partitions(self) -> list[Range]:
        out = []
        for store in self.stores:
            system, at = _place(store)
            out += [Range(store, k, k + LOOSE_FOLDERS, True) for k in range(0, 256, LOOSE_FOLDERS)]
            for x in system.get_file_info(fs.FileSelector(f"{at}/pack", allow_not_found=True)):
                if x.base_name.endswith(".idx"):
                    with system.open_input_file(x.path) as index:
                        n = _count(index)
                    out += [Range(f"{store}/pack/{x.base_name}", k, min(n, k + ENTRIES), False) for k in range(0, n, ENTRIES)]
        return out

    def read(self, part: Range):
        system, at = _place(part.place)
        rows = _loose(system, at, part) if part.loose else _indexed(system, at, part)
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.int64()))], names=["id", "place", "at"])


def _loose(system: fs.FileSystem, at: str, part: Range):
    for k in range(part.first, part.last):
        for x in system.get_file_info(fs.FileSelector(f"{at}/{k:02x}", allow_not_found=True)):
            if re.fullmatch(r"[0-9a-f]{38}", x.base_name):
                yield f"{k:02x}{x.base_name}", f"{part.place}/{k:02x}/{x.base_name}", None


def _count(index) -> int:
    """How many objects an index names."""
    if index.read(INDEX_HEAD) != INDEX_MAGIC:
        raise ValueError("only pack indexes of version 2 can be read")
    index.seek(INDEX_HEAD + FANOUT - 4)
    return struct.unpack(">I", index.read(4))[0]


def _offset(index, n: int, row: int) -> int:
    """The offset of an index row; from 2 GiB on it stands in a table of its own."""
    index.seek(INDEX_HEAD + FANOUT + 24 * n + 4 * row)
    low = struct.unpack(">I", index.read(4))[0]
    if low < 1 << 31:
        return low
    index.seek(INDEX_HEAD + FANOUT + 28 * n + 8 * (low & 0x7FFFFFFF))
    return struct.unpack(">Q", index.read(8))[0]


def _indexed(system: fs.FileSystem, at: str, part: Range):
    pack = part.place.removesuffix(".idx") + ".pack"
    with system.open_input_file(at) as index:
        n, size = _count(index), part.last - part.first
        index.seek(INDEX_HEAD + FANOUT + 20 * part.first)
        names = index.read(20 * size)
        index.seek(INDEX_HEAD + FANOUT + 24 * n + 4 * part.first)
        offsets = struct.unpack(f">{size}I", index.read(4 * size))
        for k, low in enumerate(offsets):
            yield names[20 * k : 20 * k + 20].hex(), pack, low if low < 1 << 31 else _offset(index, n, part.first + k)


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base."""
    _, at = _size(delta, 0)
    total, at = _size(delta, at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:  # copy: the bits say which bytes of offset and size follow
            parts = []
            for bit in range(7):
                parts.append(delta[at] if op >> bit & 1 else 0)
                at += op >> bit & 1
            start, size = int.from_bytes(bytes(parts[:4]), "little"), int.from_bytes(bytes(parts[4:]), "little") or 0x10000
            out += base[start : start + size]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != total:
        raise ValueError("a delta does not fit its base")
    return bytes(out)


def _size(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 0x7F) << shift, shift + 7
        if byte < 0x80:
            return value, at


class Pack:
    """One open pack: kinds and contents by offset, through chains of deltas."""

    def __init__(self, place: str):
        self.system, self.at = _place(place)
        self.file = self.system.open_input_file(self.at)
        self.index = None
        self.kinds: dict[int, str] = {}
        self.kept: OrderedDict[int, bytes] = OrderedDict()
        self.bytes = 0

    def close(self) -> None:
        self.file.close()
        if self.index:
            self.index.close()

    def _head(self, at: int) -> tuple[int, int, int]:
        """The type of an entry, the offset of its base (-1 for none), and where its data starts."""
        self.file.seek(at)
        raw = self.file.read(64)
        kind, k = raw[0] >> 4 & 7, 1
        while raw[k - 1] & 0x80:
            k += 1
        if kind == OFFSET_DELTA:
            back, k = raw[k] & 0x7F, k + 1
            while raw[k - 1] & 0x80:
                back, k = (back + 1) << 7 | raw[k] & 0x7F, k + 1
            return kind, at - back, at + k
        if kind == NAME_DELTA:
            return kind, self._named(raw[k : k + 20]), at + k + 20
        return kind, -1, at + k

    def _named(self, name: bytes) -> int:
        """The offset of an object of this pack, by a search of its index."""
        if self.index is None:
            self.index = self.system.open_input_file(self.at.removesuffix(".pack") + ".idx")
        self.index.seek(0)
        n = _count(self.index)
        low, high = 0, n - 1
        while low <= high:
            mid = (low + high) // 2
            self.index.seek(INDEX_HEAD + FANOUT + 20 * mid)
            found = self.index.read(20)
            if found == name:
                return _offset(self.index, n, mid)
            low, high = (mid + 1, high) if found < name else (low, mid - 1)
        raise ValueError(f"the base {name.hex()} is not in its pack")

    def _inflated(self, start: int) -> bytes:
        self.file.seek(start)
        made, out = zlib.decompressobj(), []
        while not made.eof:
            raw = self.file.read(1 << 13)
            if not raw:
                raise ValueError("a pack ends inside an object")
            out.append(made.decompress(raw))
        return b"".join(out)

    def kind(self, at: int) -> str:
        chain = []
        while at not in self.kinds:
            chain.append(at)
            kind, base, _ = self._head(at)
            if base < 0:
                self.kinds[at] = KINDS[kind]
            else:
                at = base
        for one in chain:
            self.kinds[one] = self.kinds[at]
        if len(self.kinds) > KNOWN_KINDS:
            self.kinds = {at: self.kinds[at]}
        return self.kinds[at]

    def content(self, at: int) -> bytes:
        deltas, where = [], at
        while where not in self.kept:
            _, base, start = self._head(where)
            deltas.append((where, start))
            if base < 0:
                break
            where = base
        else:
            self.kept.move_to_end(where)
        out = self.kept.get(where)
        for one, start in reversed(deltas):
            raw = self._inflated(start)
            out = raw if out is None else patched(out, raw)
            self._keep(one, out)
        return out

    def _keep(self, at: int, content: bytes) -> None:
        self.kept[at] = content
        self.bytes += len(content)
        while self.bytes > KEPT_BYTES and len(self.kept) > 1:
            self.bytes -= len(self.kept.popitem(last=False)[1])


def _decoded(batches):
    pack, name = None, None
    for batch in batches:
        out = []
        for key, place, at in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None:
                system, path = _place(place)
                with system.open_input_stream(path, compression=None) as source:
                    head, _, content = zlib.decompress(source.read()).partition(b"\0")
                kind = head.split(b" ")[0].decode()
            else:
                if place != name:
                    if pack:
                        pack.close()
                    pack, name = Pack(place), place
                kind = pack.kind(at)
                content = pack.content(at) if kind in ("commit", "tree") else b""
            if kind in ("commit", "tree"):
                out.append((key, kind, content))
        columns = zip(*out) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()))], names=["id", "kind", "content"])


def objects(spark: SparkSession, repository: Repository) -> DataFrame:
    """``id, kind, content`` of all commits and trees of the object store, each once, as a table of its own."""
    spark.dataSource.register(RepositoryEntries)
    entries = spark.read.format("repository_entries").option("stores", json.dumps(repository.stores())).load()
    once = entries.groupBy("id").agg(F.min(F.struct("place", "at")).alias("x")).select("id", "x.place", "x.at")
    # Neighbours in a pack go to one task in order; objects of their own files are dealt out by their names.
    dealt = once.repartitionByRange("place", "at").sortWithinPartitions("place", "at")
    return stored(dealt.mapInArrow(_decoded, _OBJECT), "objects")


def parsed_commit(content: bytes) -> tuple[str, list[str], str, int, str]:
    """``tree, parents, author, seconds, message`` of a commit object; seconds are the committer's."""
    head, _, message = content.partition(b"\n\n")
    tree, parents, author, seconds, code = "", [], "", 0, "utf-8"
    for line in head.split(b"\n"):
        name, _, value = line.partition(b" ")
        if name == b"tree":
            tree = value.decode()
        elif name == b"parent":
            parents.append(value.decode())
        elif name == b"author":
            author = value.rpartition(b" <")[0]
        elif name == b"committer":
            stamp = re.search(rb"> (-?\d+)", value)
            seconds = int(stamp[1]) if stamp else 0
        elif name == b"encoding":
            code = value.decode("ascii", "replace")
    try:
        "".encode(code)
    except LookupError:
        code = "utf-8"
    text = lambda x: x.decode(code, "replace") if x else ""
    return tree, parents, text(author).strip() or "Unknown", seconds, text(message).strip()


def all_commits(found: DataFrame) -> DataFrame:
    """``hash, short_hash, message, author, date, tree, parents`` of every commit object, reachable or not."""

    def run(batches):
        for batch in batches:
            rows = [(key, *parsed_commit(raw)) for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            key, tree, parents, author, seconds, message = zip(*rows) if rows else [()] * 6
            micros = pa.array([s * 1_000_000 for s in seconds], pa.int64()).cast(pa.timestamp("us", "UTC"))
            text = lambda x: pa.array(x, pa.string())
            columns = [text(key), text([k[:7] for k in key]), text(message), text(author), micros, text(tree), pa.array(parents, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "short_hash", "message", "author", "date", "tree", "parents"])

    return found.filter("kind = 'commit'").select("id", "content").mapInArrow(run, _COMMIT)


def all_trees(found: DataFrame) -> DataFrame:
    """``tree, name, mode, child``: the entries of every tree object."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                while at < len(raw):
                    cut = raw.index(b"\0", at)
                    mode, _, name = raw[at:cut].partition(b" ")
                    rows.append((key, name.decode("utf-8", "replace"), mode.decode().lstrip("0"), raw[cut + 1 : cut + 21].hex()))
                    at = cut + 21
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["tree", "name", "mode", "child"])

    return found.filter("kind = 'tree'").select("id", "content").mapInArrow(run, _TREE)


def ancestors(commits: DataFrame, head: str) -> DataFrame:
    """The rows of ``commits(hash, parents, ...)`` that ``head`` stands on, itself included.

    First parents make a tree, so what lies behind a set of commits along them is found by jumps of one, two, four
    steps and so on, whatever the length of the history; other parents found that way start the next round. A commit
    whose parent is missing (a shallow history) has none there.
    """
    links = stored(commits.select("hash", F.posexplode("parents").alias("nth", "parent")), "links")
    tips = commits.join(links.select(F.col("parent").alias("hash")), "hash", "left_anti").select("hash").limit(2).collect()  # two say enough
    if [t.hash for t in tips] == [head]:
        return commits
    jump = cut_lineage(links.filter("nth = 0").select("hash", F.col("parent").alias("to")))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = cut_lineage(jump.join(jump.select(F.col("hash").alias("to"), F.col("to").alias("next")), "to").select("hash", F.col("next").alias("to")))
    others = links.filter("nth > 0").select("hash", "parent")
    new = commits.sparkSession.createDataFrame([(head,)], "hash string")
    known = None
    while True:
        for jump in jumps:
            new = cut_lineage(new.union(new.join(jump, "hash").select("to")).distinct())
        known = new if known is None else cut_lineage(known.union(new).distinct())
        new = cut_lineage(others.join(new, "hash", "left_semi").select(F.col("parent").alias("hash")).distinct().join(known, "hash", "left_anti"))
        if new.isEmpty():
            return commits.join(known, "hash", "left_semi")


def changed_paths(commits: DataFrame, before: DataFrame, trees: DataFrame) -> DataFrame:
    """``hash, path, status`` (A, M or D) of what each of ``commits`` changed against its first parent in ``before``.

    Renames are a D and an A; a first commit, and one whose parent is missing, adds everything; a change of mode is an M.
    One pair of joins for each level of folders, over those subtrees alone that differ.
    """
    old = before.select(F.col("hash").alias("parent"), F.col("tree").alias("old"))
    pairs = commits.select("hash", F.lit("").alias("prefix"), F.col("tree").alias("new"), F.get("parents", F.lit(0)).alias("parent")).join(old, "parent", "left")
    pairs = cut_lineage(pairs.select("hash", "prefix", "new", "old").filter(~F.col("new").eqNullSafe(F.col("old"))))
    out = None
    while out is None or not pairs.isEmpty():
        side = lambda c: pairs.join(trees, F.col(c) == F.col("tree")).select("hash", "prefix", "name", F.struct("mode", "child").alias(c))
        both = side("new").join(side("old"), ["hash", "prefix", "name"], "full").filter(~F.col("new").eqNullSafe(F.col("old")))
        path = F.concat(F.col("prefix"), F.col("name"))
        folder = lambda c: F.when(F.col(c)["mode"] == FOLDER_MODE, F.col(c)["child"])
        plain = lambda c: F.coalesce(F.col(c)["mode"] != FOLDER_MODE, F.lit(False)).alias(f"{c}_file")
        level = stored(both.select("hash", path.alias("path"), folder("new").alias("new"), folder("old").alias("old"), plain("new"), plain("old")), "level")
        status = F.when(~F.col("old_file"), "A").when(~F.col("new_file"), "D").otherwise("M")
        files = level.filter("new_file or old_file").select("hash", "path", status.alias("status"))
        out = files if out is None else out.unionByName(files)
        pairs = level.filter("new is not null or old is not null").select("hash", F.concat("path", F.lit("/")).alias("prefix"), "new", "old")
    return out


def read_log(spark: SparkSession, repository: Repository, earlier: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``commits`` (as in ``all_commits``, those that the head stands on) and ``commit_files(hash, path, status)``.

    ``earlier``, what was read when the head stood elsewhere, saves comparing the trees of its commits again.
    """
    found = objects(spark, repository)
    every = stored(all_commits(found), "commits")
    commits = ancestors(every, repository.head) if repository.head else every.limit(0)
    fresh = commits if earlier is None else commits.join(earlier[0].select("hash"), "hash", "left_anti")
    files = changed_paths(fresh, every, stored(all_trees(found), "trees"))
    if earlier is not None:
        files = files.unionByName(earlier[1].join(commits.select("hash"), "hash", "left_semi"))
    return commits, files


def object_name(kind: str, content: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


def tree_content(entries: list[tuple[str, str, str]]) -> bytes:
    """A tree object of ``mode, name, id``; folders sort as if their names ended in a slash."""
    order = sorted(entries, key=lambda e: e[1].encode() + (b"/" if e[0] == FOLDER_MODE else b""))
    return b"".join(mode.encode() + b" " + name.encode() + b"\0" + bytes.fromhex(key) for mode, name, key in order)


def commit_content(tree: str, parents: list[str], author: str, seconds: int, message: str) -> bytes:
    who = f"{author} <{author}> {seconds} +0000"
    return "\n".join([f"tree {tree}", *(f"parent {p}" for p in parents), f"author {who}", f"committer {who}", "", message]).encode()


def packed(rows: list[tuple[str, str, bytes]]) -> tuple[bytes, bytes]:
    """A pack of ``id, kind, content`` (different ids), without deltas, and its index."""
    kinds = {v: k for k, v in KINDS.items()}
    body, places = [struct.pack(">4sII", b"PACK", 2, len(rows))], []
    at = len(body[0])
    for key, kind, content in rows:
        size, head = len(content), []
        byte, size = kinds[kind] << 4 | size & 15, size >> 4
        while size:
            head.append(byte | 0x80)
            byte, size = size & 0x7F, size >> 7
        entry = bytes([*head, byte]) + zlib.compress(content)
        places.append((bytes.fromhex(key), zlib.crc32(entry), at))
        body.append(entry)
        at += len(entry)
    pack = b"".join(body)
    pack += hashlib.sha1(pack).digest()
    places.sort()
    if at >= 1 << 31:
        raise ValueError("a pack of 2 GiB or more")
    firsts = Counter(p[0][0] for p in places)
    index = INDEX_MAGIC + struct.pack(">256I", *accumulate(firsts[k] for k in range(256))) + b"".join(p[0] for p in places)
    index += struct.pack(f">{len(places)}I", *(p[1] for p in places)) + struct.pack(f">{len(places)}I", *(p[2] for p in places)) + pack[-20:]
    return pack, index + hashlib.sha1(index).digest()


#: Bytes of contents in a pack, about.
PACK_BYTES = 64 << 20


def write_packs(rows: DataFrame, common: str) -> None:
    """Write objects (``id, kind, content``) into a repository folder; each task writes packs of bounded size.

    Objects that come twice are written once; a pack is named by what it holds, so a task that runs again writes the
    same file.
    """
    once = rows.groupBy("id").agg(F.first(F.struct("kind", "content")).alias("x")).select("id", "x.kind", "x.content")

    def put(held):
        system, at = _place(f"{common}/objects/pack")
        system.create_dir(at, recursive=True)
        name = hashlib.sha1("".join(sorted(k for k, _, _ in held)).encode()).hexdigest()
        for data, ending in zip(packed(held), ("pack", "idx")):
            with system.open_output_stream(f"{at}/pack-{name}.{ending}", compression=None) as out:
                out.write(data)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["pack", "objects"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2])
                if size >= PACK_BYTES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    once.mapInArrow(run, "pack string, objects long").count()
