"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are all matches of the four base patterns, and texts of similar shape that these miss or reject: phone numbers
without a plus, spelled-out e-mail addresses, cards that fail their check digit, long network addresses. Pattern, gazetteer
and context labelers each vote yes (1), no (-1) or abstain (0). Candidates with equal votes are counted together (a table
whose size is bounded by the number of labelers, kinds and shapes, not by the data); expectation-maximisation over it
estimates how reliable every labeler is, and its posteriors are the soft labels of a logistic span classifier. Spans of the
base patterns always stay; others are added if the classifier finds them likelier than not and they overlap no base span.

Matching is linear in the text's length. Offsets count code points. Rows: null texts count as empty and have no spans;
repeated rows give repeated rows; an empty table gives an empty result and an untrained classifier that adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.storage import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# fixed values: the base patterns' parts
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS_NUMBER = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# candidates beyond the base patterns
LOOSE_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])++")
SPELLED_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[\w-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63})+", re.I
)
LONG_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
GROUPED_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")

# gazetteers and context words
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk us in eu ch at it nl".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
NEAR_WORDS = {
    EMAIL: frozenset("email mail e-mail contact write address reach".split()),
    IP: frozenset("ip address host server login client connected ping".split()),
    CARD: frozenset("card visa mastercard amex credit debit payment pay".split()),
    PHONE: frozenset("call phone tel telephone mobile cell fax contact whatsapp number reach".split()),
}
FAR_WORDS = frozenset("version release isbn issn page pages order invoice id token key hash serial ref section chapter line".split())
WORD = re.compile(r"[a-z][a-z-]*")
CONTEXT = 40

LABELERS = ("base", "shape", "gazetteer", "near_word", "far_word", "edges")
SHAPES = 3
CODES = 3 ** len(LABELERS)
ROUNDS, SETTLED, ADD_ABOVE = 50, 1e-6, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """From every @, the run of local characters to its left (up to the last match) and the host to its right."""
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        size = len(before) - len(before.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if size else None
        if host:
            yield at - size, host.end(), True
        last = host.end() if host else at + 1
        at = text.find("@", last)


def ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Dotted numbers, four at a time from the left; the flag tells whether all parts are at most 255."""
    for chain in NUMBERS.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in DIGIT_CHAIN.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 37 else ""
        if digits:
            yield m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PLUS_NUMBER.finditer(text):
        yield m.start(), m.end(), 10 <= len(_digits(m.group())) <= 15


FINDERS = (emails, ips, cards, phones)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, base) of the base spans and of other candidates, in the order of the start, then of the kind."""
    found = {(a, b, kind): True for kind, finder in enumerate(FINDERS) for a, b, good in finder(text) if good}
    taken = sorted(found)

    def add(a: int, b: int, kind: int) -> None:
        if not any(x < b and a < y for x, y, _ in taken):
            found.setdefault((a, b, kind), False)

    rejected = [(a, b, k) for k, finder in ((IP, ips), (CARD, cards)) for a, b, good in finder(text) if not good]
    for a, b, kind in rejected:
        if kind == IP or 13 <= len(_digits(text[a:b])) <= 19:
            add(a, b, kind)
    for m in LOOSE_NUMBER.finditer(text):
        shown = m.group()
        if m.end() - m.start() <= 40 and 7 <= len(_digits(shown)) <= 15 and any(c in " ().-" for c in shown) and (m.start(), m.end(), IP) not in found:
            add(m.start(), m.end(), PHONE)
    low = text.lower() if "at" in text or "AT" in text else ""
    if "dot" in low:
        for m in SPELLED_EMAIL.finditer(text):
            add(m.start(), m.end(), EMAIL)
    if text.count(":") >= 7:
        for m in LONG_IP.finditer(text):
            add(m.start(), m.end(), IP)
    return [(a, b, kind, base) for (a, b, kind), base in sorted(found.items(), key=lambda x: (x[0][0], x[0][2], x[0][1]))]


def votes(text: str, start: int, end: int, kind: int, base: bool) -> tuple[int, ...]:
    """One vote per labeler, in the order of ``LABELERS``."""
    shown = text[start:end]
    digits = _digits(shown)
    if kind == EMAIL:
        shape = 1 if "." in shown.rpartition("@")[2] or "dot" in shown.lower() else -1
        known = 1 if re.split(r"[.\s\])]+", shown.lower().strip())[-1] in ENDINGS else 0
    elif kind == IP:
        shape = 1 if ":" in shown or all(p == "0" or (p[0] != "0" and len(p) <= 3) for p in shown.split(".") if p) else -1
        known = -1 if digits.strip("0") in ("", "1", "255") else 0
    elif kind == CARD:
        shape = 1 if len(digits) in (15, 16) and (shown == digits or re.fullmatch(r"(?:[0-9]{4}[ -]){3}[0-9]{4}", shown)) else -1
        known = 1 if digits.startswith(ISSUERS) else -1
    else:
        shape = 1 if "(" in shown or GROUPED_PHONE.search(shown) else (-1 if shown.count(".") and not shown.startswith("+") else 0)
        known = 1 if shown[0] == "+" and digits.startswith(DIAL_CODES) else (-1 if len(set(digits)) < 3 else 0)
    around = set(WORD.findall(text[max(0, start - CONTEXT) : start].lower()))
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    rejects = kind in (IP, CARD) and ":" not in shown
    return (
        1 if base else (-1 if rejects else 0), shape, known, 1 if around & NEAR_WORDS[kind] else 0,
        -1 if around & FAR_WORDS else 0, -1 if glued else 1,
    )


def _shape(kind: int, start: int, end: int) -> int:
    return min((end - start) // 12, SHAPES - 1)


def _code(kind: int, shape: int, vote: tuple[int, ...]) -> int:
    code = kind * SHAPES + shape
    for v in vote:
        code = code * 3 + v + 1
    return code


def _decode(code: int) -> tuple[int, int, tuple[int, ...]]:
    head, rest, vote = code // CODES, code % CODES, []
    for _ in LABELERS:
        vote.append(rest % 3 - 1)
        rest //= 3
    return head // SHAPES, head % SHAPES, tuple(reversed(vote))


def reliabilities(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """EM over vote patterns: per class (no, yes) and labeler the shares of votes -1, 0, 1; and each pattern's posterior."""
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    vote = np.array([_decode(c)[2] for c in codes], int).reshape(len(codes), len(LABELERS)) + 1
    share = np.empty((2, len(LABELERS), 3))
    share[0], share[1] = (0.5, 0.35, 0.15), (0.1, 0.35, 0.55)
    prior = 0.5
    rows = np.arange(len(LABELERS))
    for _ in range(ROUNDS if codes else 0):
        logit = math.log(prior / (1 - prior)) + np.log(share[1][rows, vote] / share[0][rows, vote]).sum(axis=1)
        yes = 1 / (1 + np.exp(-logit))
        new = np.empty_like(share)
        for k, w in enumerate((weight * (1 - yes), weight * yes)):
            for j, v in product(range(len(LABELERS)), range(3)):
                new[k, j, v] = w[vote[:, j] == v].sum() + (1.0, 1.0, 1.0)[v]
            new[k] /= new[k].sum(axis=1, keepdims=True)
        # a labeler is never held to be worse than chance
        new[1, :, 2], new[0, :, 2] = np.maximum(new[1, :, 2], new[0, :, 2]), np.minimum(new[1, :, 2], new[0, :, 2])
        new[0, :, 0], new[1, :, 0] = np.maximum(new[1, :, 0], new[0, :, 0]), np.minimum(new[1, :, 0], new[0, :, 0])
        new /= new.sum(axis=2, keepdims=True)
        prior = min(max((weight * yes).sum() / weight.sum(), 0.05), 0.95)
        moved, share = np.abs(new - share).max(), new
        if moved < SETTLED:
            break
    logit = math.log(prior / (1 - prior)) + np.log(share[1][rows, vote] / share[0][rows, vote]).sum(axis=1) if codes else np.zeros(0)
    return share, np.array([1 - prior, prior]), dict(zip(codes, (1 / (1 + np.exp(-logit))).tolist()))


def _features(code: int) -> np.ndarray:
    kind, shape, vote = _decode(code)
    x = np.zeros(1 + 2 * len(LABELERS) + len(KINDS) + SHAPES)
    x[0] = 1
    for j, v in enumerate(vote):
        if v:
            x[1 + 2 * j + (v > 0)] = 1
    x[1 + 2 * len(LABELERS) + kind] = 1
    x[1 + 2 * len(LABELERS) + len(KINDS) + shape] = 1
    return x


def span_classifier(counts: dict[int, int], soft: dict[int, float], steps: int = 30, ridge: float = 1.0) -> dict[int, float]:
    """Logistic regression on the soft labels by Newton steps; the probability of each pattern seen."""
    codes = sorted(counts)
    if not codes:
        return {}
    x, w, y = np.stack([_features(c) for c in codes]), np.array([counts[c] for c in codes], float), np.array([soft[c] for c in codes])
    w = w / w.sum() * min(w.sum(), 10_000.0)  # keeps the ridge's weight at any number of spans
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-(x @ beta)))).tolist()))


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("base", pa.bool_()), ("code", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    interesting = re.compile("[0-9@]")
    for batch in batches:
        out = []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = candidates(text) if interesting.search(text) or "dot" in text.lower() else []
            out.append([
                {"start": a, "end": b, "kind": k, "base": base, "code": _code(k, _shape(k, a, b), votes(text, a, b, k, base))}
                for a, b, k, base in spans
            ])
        yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(_SPAN))], names=["doc_id", "spans"])


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def chosen(spans: list[dict], likely: dict[int, float]) -> list[tuple[int, int, int]]:
    """The base spans and the likely others; of overlapping others the likeliest stays."""
    kept = [(s["start"], s["end"], s["kind"]) for s in spans if s["base"]]
    others = [s for s in spans if not s["base"] and likely.get(s["code"], 0.0) > ADD_ABOVE]
    added: list[tuple[int, int, int]] = []
    for s in sorted(others, key=lambda s: (-likely[s["code"]], s["start"], s["kind"])):
        if not any(s["start"] < b and a < s["end"] for a, b, _ in added):
            added.append((s["start"], s["end"], s["kind"]))
    return kept + added


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    scanned = docs.select("doc_id", "text").mapInArrow(
        _scan, "doc_id bigint, spans array<struct<start:int,end:int,kind:tinyint,base:boolean,code:int>>"
    )
    scanned = materialize(scanned, "spans")
    patterns = scanned.select(F.explode("spans.code").alias("code")).groupBy("code").count()
    # at most kinds x shapes x 3^labelers rows, whatever the data
    counts = {row["code"]: row["count"] for row in patterns.collect()}
    likely = span_classifier(counts, reliabilities(counts)[2])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sums, written = [], [], []
            for spans in batch.column(1).to_pylist():
                base = [(s["start"], s["end"], s["kind"]) for s in spans if s["base"]]
                numbers.append([sum(k == kind for _, _, k in base) for kind in range(len(KINDS))])
                sums.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(chosen(spans, likely)))
            columns = [pa.array([n[kind] for n in numbers], pa.int64()) for kind in range(len(KINDS))]
            yield pa.record_batch(
                [batch.column(0), *columns, pa.array(sums, pa.string()), pa.array(written, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    numbers = ", ".join(f"n_{k} bigint" for k in KINDS)
    return scanned.mapInArrow(finish, f"doc_id bigint, {numbers}, base_sha256 string, spans string")
