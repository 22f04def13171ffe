"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a
span classifier is trained on what it believes.

Base spans follow fixed patterns and always stay. Other candidates (looser forms, and names) are added where the
final classifier is sure. The votes of a candidate and its features are small integers, so all candidates of the
corpus are counted by pattern in Spark, and the models are fitted on that table of patterns: every span counts, and
what reaches the driver is bounded by the number of patterns.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
BASE = KINDS[:4]
#: How sure the classifier must be of a span that is not a base one.
SURE = 0.9

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"(?i)[A-Za-z0-9._%+-]{1,64}\s?[\[({]at[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[({]dot[\])}]|\.)\s?[A-Za-z0-9-]{1,63})+")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<![A-Za-z])(?=([A-Z][a-z]{2,15} [A-Z][a-z]{2,20})(?![A-Za-z]))")
_BRACKET_AT = re.compile(r"(?i)[\[({]at[\])}]")
_NON_DIGIT = re.compile(r"[^0-9]")

# Fixed values of the gazetteers and of the context labeler.
GIVEN = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Paul Emily Steven Anna Andrew Laura Peter Maria Hans Ursula Klaus Petra Stefan Sabine Jean Marie Pierre Sophie Claire Louis Camille Jose Carmen Juan Lucia Carlos Elena Luis Isabel Ana Miguel".split())
TOP_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca au ch at be jp".split())
CONTACT = frozenset("mail email contact write phone tel telephone mobile cell call fax card credit debit visa mastercard payment iban account ssn social name called mr mrs ms dr ip address host client from reach".split())
TECHNICAL = frozenset("version build release id order isbn sku serial part item page figure section chapter model number no ref ticket checksum hash total price".split())


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the address pattern, found from each @ so that long runs cost no more than their length."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by kind and start, and the card- and address-like matches that failed their test."""
    kept, failed = [], []
    if "@" in text:
        kept += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            parts = [text[m.start() : m.start(1)], m[1][1:], m[2][1:], m[3][1:]]
            ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
            (kept if ok else failed).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NON_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19:
            (kept if _luhn(digits) else failed).append(("card", *m.span()))
    if "+" in text:
        kept += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return kept, failed


def _listed(name: str) -> bool:
    return name.partition(" ")[0] in GIVEN


def _names(text: str) -> list[tuple[int, int]]:
    """Spans of the shape of a name that don't overlap: those with a listed given name first, then the leftmost."""
    every = [m.span(1) for m in _NAME.finditer(text)]
    out, upto = [], 0
    for k, (a, b) in enumerate(every):
        rival = k + 1 < len(every) and every[k + 1][0] < b and _listed(text[slice(*every[k + 1])]) and not _listed(text[a:b])
        if a >= upto and not rival:
            out.append((a, b))
            upto = b
    return out


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and other candidates that don't overlap them or each other."""
    base, loose = base_spans(text)
    if _BRACKET_AT.search(text):
        loose += [("email", *m.span()) for m in _AT.finditer(text)]
    loose += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    if "-" in text:
        loose += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    loose += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    loose += [("name", a, b) for a, b in _names(text) if _listed(text[a:b])]
    taken = sorted((a, b) for _, a, b in base)
    out, k, upto = [], 0, 0
    for kind, a, b in sorted(loose, key=lambda s: (s[1], -s[2], s[0])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= upto and not (k < len(taken) and taken[k][0] < b):
            out.append((kind, a, b))
            upto = b
    return base, out


LABELERS = 5


def votes(text: str, kind: str, a: int, b: int, valid: bool) -> list[int]:
    """1 for personal, -1 against, 0 no opinion: pattern, gazetteer, context, repetition, borders."""
    value = text[a:b]
    digits = _NON_DIGIT.sub("", value)
    if valid:
        pattern = 1
    elif kind in ("card", "ip"):
        pattern = -1
    elif kind == "iban":
        plain = value.replace(" ", "")
        pattern = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    elif kind == "ssn":
        pattern = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    else:
        pattern = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", value.lower())[-1] in TOP_DOMAINS or re.search(r"[A-Za-z]+", value[::-1])[0][::-1].lower() in TOP_DOMAINS else -1
    elif kind == "card":
        gazetteer = 1 if re.match(r"4|5[1-5]|3[47]|6011|65|2[2-7]", digits) else -1
    elif kind == "ip":
        gazetteer = -1 if re.match(r"(0|10|127|255|169\.254|192\.168)\.", value) else 0
    elif kind == "name":
        gazetteer = 1
    else:
        gazetteer = 0
    near = [w.lower() for w in re.findall(r"[A-Za-z]+", text[max(0, a - 40) : a])[-4:]]
    context = 1 if any(w in CONTACT for w in near) else -1 if any(w in TECHNICAL for w in near) else 0
    repetition = -1 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 1 if len(set(digits)) >= 5 else 0
    borders = -1 if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum() else 1 if text[a - 1 : a].isspace() and text[b : b + 1].isspace() else 0
    return [pattern, gazetteer, context, repetition, borders]


def traits(text: str, kind: str, a: int, b: int) -> list[int]:
    """What the final classifier sees of a span: kind, length, share of digits, separators, what stands around it."""
    value = text[a:b]
    share = sum(c.isdigit() for c in value) / (b - a)
    marks = len({c for c in value if not c.isalnum()})
    near = {w.lower() for w in re.findall(r"[A-Za-z]+", text[max(0, a - 40) : a])[-4:]}
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return [KINDS.index(kind), min(5, (b - a) // 6), min(3, int(share * 4)), min(3, marks), side(text[a - 1 : a] if a else ""), side(text[b : b + 1]), int(bool(near & CONTACT)), int(bool(near & TECHNICAL)), int(_luhn(_NON_DIGIT.sub("", value)))]


_SIZES = (len(KINDS), 6, 4, 4, 4, 4, 2, 2, 2)


def _one_hot(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(n)[rows[:, k]] for k, n in enumerate(_SIZES)] + [np.ones((len(rows), 1))], axis=1)


@dataclass(frozen=True)
class Model:
    reliability: np.ndarray  # labeler, truth, vote (-1, 0, 1)
    weights: np.ndarray

    def probability(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-_one_hot(np.array(rows, dtype=int)) @ self.weights)) if rows else np.zeros(0)


def fit(patterns: list[tuple[list[int], list[int], int]], rounds: int = 60) -> Model:
    """Expectation-maximisation over (votes, traits, count), then a logistic classifier of the traits on its beliefs.

    Starts from the majority, with smoothed counts; the share of personal spans is estimated for each kind.
    """
    if not patterns:
        return Model(np.full((LABELERS, 2, 3), 1 / 3), np.append(np.zeros(sum(_SIZES)), -9.0))
    v = np.array([p[0] for p in patterns]) + 1
    x = np.array([p[1] for p in patterns])
    n = np.array([p[2] for p in patterns], dtype=float)
    belief = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
    reliability = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        for truth, share in ((0, 1 - belief), (1, belief)):
            for k in range(LABELERS):
                reliability[k, truth] = np.bincount(v[:, k], weights=n * share, minlength=3) + 1.0
        reliability /= reliability.sum(2, keepdims=True)
        by_kind = np.bincount(x[:, 0], weights=n * belief, minlength=len(KINDS)) + 1.0
        prior = by_kind / (np.bincount(x[:, 0], weights=n, minlength=len(KINDS)) + 2.0)
        logs = np.log(reliability)
        odds = np.log(prior / (1 - prior))[x[:, 0]] + sum(logs[k, 1, v[:, k]] - logs[k, 0, v[:, k]] for k in range(LABELERS))
        belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    design = _one_hot(x)
    weights, scale = np.zeros(design.shape[1]), n / n.sum()
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-design @ weights))
        slope = design.T @ (scale * (p - belief)) + 1e-3 * weights
        bend = (design * (scale * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(weights))
        weights -= np.linalg.solve(bend, slope)
    return Model(reliability, weights)


_SPAN = "struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,traits:array<int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("traits", pa.list_(pa.int32()))]))


def candidate_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` for every row: all candidates of the whole text with votes and traits."""

    def run(batches):
        for batch in batches:
            every = []
            for text in batch.column(1).to_pylist():
                base, loose = candidates(text or "")
                every.append([{"kind": k, "start": a, "end": b, "base": is_base, "votes": votes(text, k, a, b, is_base), "traits": traits(text, k, a, b)} for is_base, spans in ((True, base), (False, loose)) for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, _ARROW)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, found array<{_SPAN}>")


def personal_data(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs`` (``doc_id, text``; other columns are not read).

    Both are arrays of (kind, start, end), by kind as in ``KINDS`` and then start; positions count code points, ends
    are exclusive. ``spans`` holds all of ``base``. Null and empty texts have none; a null doc_id is kept; repeated
    rows repeat; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(candidate_spans(docs), "candidates")
    counted = found.select(F.explode("found").alias("s")).groupBy("s.votes", "s.traits").agg(F.count("*").alias("n"))
    model = fit(sorted((list(r.votes), list(r.traits), r.n) for r in counted.collect()))  # a row per pattern
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for batch in batches:
            base, every = [], []
            for row in batch.column(1).to_pylist():
                row = sorted(row, key=lambda s: (order[s["kind"]], s["start"]))
                certain = model.probability([s["traits"] for s in row]) >= sure
                bare = [{k: s[k] for k in ("kind", "start", "end")} for s in row]
                base.append([x for x, s in zip(bare, row) if s["base"]])
                every.append([x for x, s, ok in zip(bare, row, certain) if ok or s["base"]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(every, spans)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return found.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """What the query reports of spans in order."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
