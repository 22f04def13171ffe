"""Unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

White space is marked, not lost: a text is encoded as a marker followed by the text with every space as a marker.
Pieces only hold markers at their start, so the best segmentation never crosses from another character to a marker,
and such words are segmented once and remembered (in a bounded table). Characters without a piece become the byte
pieces of their UTF-8 form.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: How an unknown piece is shown.
UNKNOWN = " ⁇ ".encode()
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words in each half of a worker's memory (about 70 MB a half).
REMEMBER = 150_000
#: Characters of a word that is not remembered any more, so that the memory is bounded in bytes too.
LONG = 64
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as arrays: the trie (base, check, piece id), code points to codes, scores, bytes to print."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    alphabet: dict[str, int]
    scores: np.ndarray
    shown: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    by_word: bool


def _double_array(keys: dict[str, int], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Child of state s by code c: t = base[s] + c if check[t] == s. State 0 is the root; codes start at 1."""
    children: list[dict[int, int]] = [{}]
    ends = {}
    for key, value in keys.items():
        at = 0
        for c in key:
            at = children[at].setdefault(alphabet[c], len(children)) or at
            if at == len(children):
                children.append({})
        ends[at] = value
    size = 4 * len(children) + 2 * len(alphabet) + 1024
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    place, floor = {0: 0}, 1
    order = [0]
    for node in order:
        at = place[node]
        if node in ends:
            piece[at] = ends[node]
        if not children[node]:
            continue
        codes = np.array(sorted(children[node]))
        start = max(floor - int(codes[0]), 1)
        while True:
            tries = np.arange(start, min(start + 4096, size - int(codes[-1])))
            if not tries.size:
                grow = lambda a, v: np.concatenate([a, np.full(size, v, a.dtype)])
                base, check, piece, used = grow(base, 0), grow(check, -1), grow(piece, -1), grow(used, False)
                size *= 2
                continue
            tries = tries[~used[tries + codes[0]]]
            free = tries[~used[tries[:, None] + codes].any(1)] if tries.size else tries
            if free.size:
                break
            start += 4096
        base[at] = free[0]
        targets = free[0] + codes
        used[targets] = True
        check[targets] = at
        for c, t in zip(codes.tolist(), targets.tolist()):
            place[children[node][c]] = t
            order.append(children[node][c])
        while floor < size and used[floor]:
            floor += 1
    top = int(np.flatnonzero(used)[-1]) + 1 + len(alphabet) + 1
    pad = max(0, top - size)
    return tuple(np.pad(a[:top], (0, pad), constant_values=v) for a, v in ((base, 0), (check, -1), (piece, -1)))


def build(vocabulary: list[tuple[str, float, str]]) -> Pieces:
    """``vocabulary``: piece, log score and kind (normal, byte, control, unknown or unused) by id."""
    keys = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "normal" and p}
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for p in keys for c in p}))}
    base, check, piece = _double_array(keys, alphabet)
    byte_ids, shown, unknown = [-1] * 256, [], -1
    for i, (p, _, kind) in enumerate(vocabulary):
        if kind == "byte":
            byte_ids[int(p[1:-1], 16)] = i
        unknown = i if kind == "unknown" else unknown
        text = {"normal": p.replace(MARK, " "), "unknown": UNKNOWN.decode()}.get(kind, "")
        shown.append(bytes([int(p[1:-1], 16)]) if kind == "byte" else text.encode())
    scores = np.array([s for _, s, _ in vocabulary], dtype=np.float64)
    lowest = min((vocabulary[i][1] for i in keys.values()), default=0.0)
    by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in keys)
    return Pieces(base, check, piece, alphabet, scores, shown, byte_ids, unknown, lowest - UNKNOWN_PENALTY, by_word)


def load(model_file: str) -> Pieces:
    """The pieces of a SentencePiece model file; their scores are taken as log scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "unused" if model.is_unused(i) else "normal"
    return build([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])


class Encoder:
    """Encodes and decodes with one vocabulary; keeps plain lists for the walk and a bounded memory of words."""

    def __init__(self, pieces: Pieces, remember: int = REMEMBER):
        self.p = pieces
        self.base, self.check, self.piece = pieces.base.tolist(), pieces.check.tolist(), pieces.piece.tolist()
        self.scores = pieces.scores.tolist()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remember = remember

    def segment(self, text: str) -> list[int]:
        """Piece ids of the best path; of equal paths the one whose last piece starts first."""
        base, check, piece, scores = self.base, self.check, self.piece, self.scores
        codes = [self.p.alphabet.get(c, 0) for c in text]
        n = len(codes)
        best, back, ids = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, state, single = best[i], 0, False
            for j in range(i, n):
                code = codes[j]
                state_next = base[state] + code
                if not code or check[state_next] != state:
                    break
                state = state_next
                found = piece[state]
                if found >= 0:
                    single = single or j == i
                    total = here + scores[found]
                    if best[j + 1] is None or total > best[j + 1]:
                        best[j + 1], back[j + 1], ids[j + 1] = total, i, found
                if not base[state]:
                    break
            if not single:
                total = here + self.p.unknown_score
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], back[i + 1], ids[i + 1] = total, i, -1
        out, at = [], n
        while at:
            start = back[at]
            if ids[at] >= 0:
                out.append(ids[at])
            else:
                raw = [self.p.byte_ids[b] for b in text[start:at].encode("utf-8", "replace")]
                out += reversed(raw) if min(raw) >= 0 else [self.p.unknown_id]
            at = start
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; none for an empty text."""
        if not text:
            return b""
        if not self.p.by_word:
            return np.array(self.segment(MARK + text.replace(" ", MARK)), dtype="<i4").tobytes()
        if "  " in text or text[0] == " " or MARK in text:
            chunks = _CHUNKS.findall(MARK + text.replace(" ", MARK))
        else:
            chunks = text.split(" ")
        found = list(map(self.known.get, chunks))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._learn(chunks[i])
        return b"".join(found)

    def _learn(self, chunk: str) -> bytes:
        """A word's ids, remembered. The memory has two halves: when the new one is full, it becomes the old one."""
        ids = self.known.get(chunk) or self.old.get(chunk)
        if ids is None:
            ids = array("i", self.segment(chunk if chunk[:1] == MARK else MARK + chunk)).tobytes()
        if len(chunk) > LONG:
            return ids
        if len(self.known) >= self.remember:
            self.old, self.known = self.known, {}
        self.known[chunk] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids; one that the vocabulary does not have is shown as an unknown piece."""
        shown, n = self.p.shown, len(self.p.shown)
        raw = b"".join([shown[i] if 0 <= i < n else UNKNOWN for i in np.frombuffer(ids, dtype="<i4").tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _pieces(model_file: str | None) -> Pieces:
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return _loaded(model_file, os.path.getmtime(model_file), os.path.getsize(model_file))


@lru_cache(2)
def _loaded(model_file: str, changed: float, size: int) -> Pieces:
    """The trie of a file is built once in a process, until the file changes."""
    return load(model_file)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row of ``docs`` (``doc_id, text``; other columns are not read).

    Null and empty texts have no ids; a null doc_id stays null; repeated rows repeat. The vocabulary (a file of
    fixed size) is sent to the executors as arrays.
    """
    held = docs.sparkSession.sparkContext.broadcast(_pieces(model_file))

    def run(batches):
        coder = Encoder(held.value)
        for batch in batches:
            raw = [coder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), ids], names=["doc_id", "n_tokens", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: a null list gives the empty text; a null id in it, and one that the vocabulary
    does not have, negative ones too, is shown as an unknown piece."""
    held = encoded.sparkSession.sparkContext.broadcast(_pieces(model_file))

    def run(batches):
        coder = Encoder(held.value)
        for batch in batches:
            texts = [coder.decode(np.array([-1 if i is None else i for i in x or []], dtype="<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Encode each text, decode its ids again, and return ``doc_id, n_tokens, ids_crc32, decoded_sha256, lossless``.

    The digests are of all ids (little-endian, 32 bits) and of the decoded text. Lossless is false only where a text
    holds the marker character itself, which decodes to a space.
    """
    held = docs.sparkSession.sparkContext.broadcast(_pieces(model_file))

    def run(batches):
        coder = Encoder(held.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                back = coder.decode(ids)
                out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            n, crc, sha, same = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
