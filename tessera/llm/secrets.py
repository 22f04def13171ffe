"""Secret scan: wide candidate rules over whole texts, then a random forest that removes false positives.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, the path it
was found in and the words around it. It is trained on labelled findings: a table of ``path, before, value, after,
label``, or by default on findings generated from rules with a fixed seed (no table of labelled secrets is public).
"""

from __future__ import annotations

import base64
import random
import re
import string
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.forest import Forest, train

#: Labelled findings used for training at most (the first by content hash), and how many are generated by default.
TRAINING_ROWS = 6000
THRESHOLD = 0.5
AROUND = 60
MASK = "[SECRET]"

# Words near secrets, words near harmless identifiers, common words, common letter pairs, known key shapes.
KEYWORDS = "secret token password passwd pwd passphrase apikey api_key api-key access_key accesskey auth bearer credential private_key client_secret signing_key connection_string".split()
HARMLESS = "example sample dummy placeholder test fixture changeme checksum sha sha1 sha256 sha512 md5 hash commit digest revision uuid guid integrity etag nonce build version color".split()
PATHS = "test tests example examples sample samples doc docs fixture fixtures mock mocks vendor lock".split()
DICTIONARY = (
    "about above account action address after again against allow always another answer application array author before begin between block board body bottom branch break bring build button "
    "cache call change channel character check child class clear click client close code column command comment common config connect content context control convert copy count create current custom "
    "data database date debug default delete design detail device direct display document domain double down download driver edit element email empty enable engine enter entry error event every "
    "example execute exist export factory false field file filter find first float folder follow format forward found frame function general global group handler header height hello help hidden "
    "history house image import index info input insert integer item java json label large layer layout length level library light line link list load local lock logger long loop main manager "
    "master match memory message method model module mouse move name native network node normal note null number object offset open option order other output owner package page panel param parent "
    "parse path pattern people person place plugin point port position print private process product profile program project property public query queue random read record region release remove "
    "render report request reset resource response result return right role root route rule sample scale schema screen script search select sequence server service session setting shadow shape "
    "shell should simple single size small sort source space special split stack standard start state static status step stop storage store stream string style submit success support switch "
    "system table target task template text theme thread time title token toggle tool total trace transform tree trigger type under undo unique unit update upload user value vector version video "
    "view visible warning widget width window with word world write your"
).split()
PAIRS = set("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur io ne me li co ro ll ic ta el ma om ec us ca".split())
KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_", "AIza", "eyJ")

_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ASSIGNED = re.compile(r"""[=:]>?[ \t]*["'`]?([^\s"'`,;<>(){}\[\]]{6,})""")
_KEYWORD = re.compile("(?i)" + "|".join(map(re.escape, KEYWORDS)))
_NAMED = re.compile(r"(?i)(?:" + "|".join(map(re.escape, KEYWORDS)) + r")\w*[\"'\])]*\s*$")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[A-Za-z][a-z0-9]+|[A-Z0-9]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_HEX = re.compile(r"(?i)[0-9a-f]+")


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans worth a look, by position and without overlaps: known key shapes, long runs with a digit, assigned values."""
    found = []
    digits = _DIGIT.search(text) is not None
    if digits:
        found += [m.span() for m in _LONG.finditer(text) if _DIGIT.search(m.group())]
    if any(start in text for start in _STARTS):
        found += [m.span() for m in KNOWN.finditer(text)]
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if _NAMED.search(text, max(0, m.start() - AROUND), m.start()):
                found.append(m.span(1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _covered(value: str, words: frozenset = frozenset(w for w in DICTIONARY if len(w) >= 4)) -> float:
    low, at, total = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(11, len(low) - at), 3, -1) if low[at : at + k] in words), 0)
        total, at = total + size, at + (size or 1)
    return total / max(1, len(low))


def features(path: str, before: str, value: str, after: str) -> list[float]:
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    letters = [value[i : i + 2].lower() for i in range(len(value) - 1) if value[i : i + 2].isalpha()]
    near = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", before[-AROUND:] + " " + after[:AROUND])]
    keyword = [m.end() for m in _KEYWORD.finditer(before)]
    lead = before.rstrip(" \t")
    where = {w.lower() for w in _WORD.findall(path or "")}
    return [
        float(np.log(n)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(p in PAIRS for p in letters) / max(1, len(letters)) if letters else 0.0,
        float(entropy),
        float(entropy / np.log2(n + 1)),
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        _covered(value),
        float(bool(_HEX.fullmatch(value)) and not value.isdigit()),
        float(value.isdigit()),
        float(bool(_UUID.search(value))),
        float(bool(KNOWN.search(value))),
        max(counts.values(), default=0) / n,
        float(bool(where & set(PATHS))),
        1.0 / (1 + len(before) - keyword[-1]) if keyword else 0.0,
        float(sum(w in HARMLESS or any(w.startswith(h) for h in ("sha", "md5", "checksum")) for w in near)),
        float(any(h in value.lower() for h in ("example", "your", "xxxx", "changeme", "placeholder", "dummy"))),
        float(lead[-1:] in "=:" or lead[-2:-1] in "=:") if lead else 0.0,
        float(before[-1:] in "\"'`") if before else 0.0,
        float("://" in before[-AROUND:].split(" ")[-1] or before[-1:] == "/" or "://" in value),
    ]


def generated_findings(rows: int = TRAINING_ROWS, seed: int = 42) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings ``path, before, value, after, label`` made by rule: half secrets, half harmless look-alikes."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    syllables = ["".join(p) for p in (rng.choices("bcdfghlmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices(["", "n", "r", "s"], k=1) for _ in range(60))]
    word = lambda: rng.choice(DICTIONARY) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(2, 9)))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"

    def secret():
        return rng.choice([
            lambda: pick(hexes, rng.choice([32, 40, 48, 64])), lambda: pick(hexes.upper(), rng.choice([32, 40, 64])),
            lambda: pick(alnum, rng.randrange(16, 65)), lambda: base64.b64encode(rng.randbytes(rng.randrange(15, 50))).decode(),
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36),
            lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24),
            lambda: pick(alnum + "!@#$%^&*-_", rng.randrange(9, 24)),
        ])()

    out = []
    for i in range(rows):
        path = rng.choice(["src", "lib", "app", "config", "web", f"src{rng.randrange(40)}", ""]) if rng.random() < 0.85 else rng.choice(PATHS)
        quote = rng.choice(['"', "'", "", '"'])
        if i % 2 == 0:
            name = rng.choice(KEYWORDS)
            name = rng.choice([name, name.upper(), f"my_{name}", f"{word()}_{name}", name.title()])
            before = f"{prose()} {name}{rng.choice([' = ', '=', ': ', ':', ' := ', ' => '])}{quote}"
            value, after = secret(), quote + " " + prose()
            if rng.random() < 0.08:
                before, value = prose() + " ", rng.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36)])
            out.append((path, before, value, after, 1))
            continue
        kind = rng.randrange(10)
        before, after, label = prose() + " ", " " + prose(), 0
        if kind == 0:
            before, value = f"{before}{rng.choice(['commit ', 'revision ', 'sha1: ', 'sha256:', 'md5 = ', 'checksum ', 'etag: ', 'digest = '])}{quote}", pick(hexes, rng.choice([32, 40, 64]))
        elif kind == 1:
            before, value = f"{before}{rng.choice(['id = ', 'uuid: ', '', 'session ', 'request_id='])}", str(uuid.UUID(int=rng.getrandbits(128)))
        elif kind == 2:
            value = pick(string.digits, rng.randrange(16, 22))
        elif kind == 3:
            value = "".join(w.title() for w in (word() for _ in range(rng.randrange(3, 7)))) + rng.choice(["", "2", "V1", "64"])
        elif kind == 4:
            before, value = f"{before}https://{word()}.com/", "/".join(word() for _ in range(4)) + f"/{rng.randrange(10**6)}"
        elif kind == 5:
            before, value = f"{before}{rng.choice(KEYWORDS)} = {quote}", rng.choice(["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "changeme", "<placeholder>", "EXAMPLEKEY12345678", "os.environ.get", "None", "undefined", "process.env.TOKEN", "get_token_from_store"])
        elif kind == 6:
            before, value = f"{before}{word()}: ", "_".join(word() for _ in range(4)) + f"_{rng.randrange(100)}"
        elif kind == 7:
            value = "".join(rng.choices(syllables, k=rng.randrange(7, 14))) + rng.choice(["", "1", "24"])
        elif kind == 8:
            before, value = f'{before}integrity="', "sha512-" + base64.b64encode(rng.randbytes(48)).decode()
        else:
            before, value = before + rng.choice(["", "(", "on "]), f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}-00-00-{rng.randrange(1000)}"
        out.append((path, before, value, after, label))
    return out


def fit(findings: list[tuple] | DataFrame | None = None, rows: int = TRAINING_ROWS) -> Forest:
    """The forest from labelled findings; of a table the first ``rows`` by content hash, so that the bound is fixed."""
    if findings is None:
        findings = generated_findings(rows)
    elif isinstance(findings, DataFrame):
        named = findings.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("path", "before", "value", "after")], F.col("label").cast("int").alias("label"))
        chosen = named.filter("label is not null").orderBy(F.xxhash64("path", "before", "value", "after"), "path", "before", "value", "after", "label").limit(rows)
        findings = [tuple(r) for r in chosen.collect()]
    x = np.array([features(*f[:4]) for f in findings], dtype=float).reshape(len(findings), -1)
    return train(x if len(findings) else np.zeros((0, len(features("", "", "", "")))), np.array([f[4] for f in findings], dtype=float))


def scan(forest: Forest, text: str, path: str) -> list[tuple[int, int, float]]:
    """``start, end, score`` of all candidates in a text."""
    spans = candidates(text)
    if not spans:
        return []
    x = np.array([features(path, text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) for a, b in spans])
    return [(a, b, float(s)) for (a, b), s in zip(spans, forest.score(x))]


def redact(text: str, spans: list[tuple[int, int, float]], threshold: float = THRESHOLD) -> str:
    out, at = [], 0
    for a, b, score in spans:
        if score >= threshold:
            out += [text[at:a], MASK]
            at = b
    return "".join(out) + text[at:] if out else text


def secret_findings(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, candidates, secrets, redacted`` for each row of ``docs`` (``doc_id, text, source``).

    ``candidates`` are (start, end, score) in code points, end exclusive; ``secrets`` those that the forest keeps;
    ``redacted`` is the text with these masked. ``source`` is the path; it may be missing or null. Null and empty
    texts have no candidates and an empty ``redacted``; repeated rows repeat; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(findings))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        forest = held.value
        for batch in batches:
            texts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            every = [scan(forest, t or "", p or "") for t, p in zip(texts, paths)]
            asdict = lambda spans: [{"start": a, "end": b, "score": s} for a, b, s in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([asdict(x) for x in every], pa.list_(span)),
                    pa.array([asdict(s for s in x if s[2] >= threshold) for x in every], pa.list_(span)),
                    pa.array([redact(t or "", x, threshold) for t, x in zip(texts, every)], pa.string()),
                ],
                names=["doc_id", "candidates", "secrets", "redacted"],
            )

    source = F.col("source") if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.cast("string").alias("source"))
    spans = "array<struct<start:int,end:int,score:double>>"
    return rows.mapInArrow(run, f"doc_id long, candidates {spans}, secrets {spans}, redacted string")


def mask_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with the kept findings masked in ``text``, and ``n_chars`` (if there) as it is then."""
    held = docs.sparkSession.sparkContext.broadcast(fit(findings))
    names, schema = docs.columns, docs.schema

    def run(batches):
        forest = held.value
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            paths = batch.column(names.index("source")).to_pylist() if "source" in names else [""] * len(texts)
            new = [None if t is None else redact(t, scan(forest, t, str(p or "")), threshold) for t, p in zip(texts, paths)]
            changed = [k for k, (a, b) in enumerate(zip(texts, new)) if a is not b]
            columns = {n: batch.column(k) for k, n in enumerate(names)}
            if changed:
                columns["text"] = pa.array(new, batch.schema.field("text").type)
                if "n_chars" in names:
                    sizes = columns["n_chars"].to_pylist()
                    for k in changed:
                        sizes[k] = len(new[k])
                    columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, schema)
