"""Toxicity by embeddings of subword bags and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with its borders) and of the word as a whole, found by hash among
``BUCKETS`` vectors; a misspelt or inflected word shares most n-grams with the known one. A passage of ``PASSAGE`` words is
the mean of its different words (missing ones count as zero), and a linear softmax over it gives the passage's log odds. A
text is as toxic as its most toxic passage, so a few words decide in a text of any length; all passages are scored.

Vectors and softmax learn together by gradient steps on a bounded sample of labelled rows: at most ``SAMPLE`` of each label,
those of the smallest hash, texts above ``SAMPLE_CHARS`` aside. At first every passage of a clean text counts as clean and the
passages of a toxic text share its label; then the passages with the largest log odds decide on both sides. N-grams in fewer
than ``TEXTS`` sampled texts have no vector. A fifth of the sample takes no part in this; a logistic fit on it turns the
largest log odds of a text into its probability.

Since the softmax is linear, a scored word needs only its share of the log odds. A worker keeps the shares of the words it
meets, and starts anew before a text once they are more than ``KNOWN_WORDS``.

Rows: null, empty and wordless texts have one passage without words; a text's score depends on the text alone; a null
``doc_id`` is never learnt from and never held out. A repeated ``doc_id`` lends its smallest text to the sample, contrary
labels count as toxic, null ones are left out. Without labels of both kinds every score is the toxic share of the
labels, 0 without any. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS, TEXTS = 2000, 40_000, 5
BUCKETS, SIZE, NGRAMS, PASSAGE = 1 << 20, 8, (3, 4, 5), 2
STEPS, FIRST_STEPS, RATE, DECAY, SOFT, SCALE = 60, 20, 1.2, 1e-4, 5.0, 10.0
AT_ONCE = 1 << 18            # vectors gathered at once in training
KNOWN_WORDS = 1 << 18        # words whose share of the log odds a worker keeps
FOLDS = 5
WORD = re.compile(r"\w+")
_DIGITS = str.maketrans("0123456789", "0" * 10)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower().translate(_DIGITS))


def subwords(word: str) -> list[int]:
    """Buckets of the word with its borders and of its n-grams."""
    bound = f"<{word}>"
    parts = {bound: None} | {bound[i : i + n]: None for n in NGRAMS for i in range(len(bound) - n + 1)}
    return [xxhash.xxh32_intdigest(p) % BUCKETS for p in parts]


def passages(found: list[str]) -> list[list[str]]:
    """The different words of each stretch of ``PASSAGE`` words."""
    return [list(dict.fromkeys(found[i : i + PASSAGE])) for i in range(0, len(found), PASSAGE)] or [[]]


class _Known(dict):
    """Words by number; ``shares`` has what each adds to the log odds. Filled as words are asked for."""

    def __init__(self, of_bucket: np.ndarray):
        self.of_bucket, self.shares = memoryview(of_bucket), array("d")

    def __missing__(self, word: str) -> int:
        buckets = subwords(word)
        self.shares.append(sum(map(self.of_bucket.__getitem__, buckets)) / len(buckets))
        self[word] = len(self)
        return len(self) - 1


@dataclass
class Model:
    """``shares``: what each bucket adds to the log odds of a passage; ``slope``, ``base``: from log odds to those of the text."""

    shares: np.ndarray
    bias: float
    slope: float
    base: float
    known: _Known | None = None

    def odds(self, text: str | None) -> float:
        """The log odds of the text's most toxic passage."""
        if self.known is None or len(self.known) > KNOWN_WORDS:
            self.known = _Known(self.shares)
        found = words(text)
        if not found:
            return self.bias
        ids = np.full(-(-len(found) // PASSAGE) * PASSAGE, -1, np.int64)
        ids[: len(found)] = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        values = np.frombuffer(self.known.shares)[ids]
        values[ids < 0] = 0
        ids, values = ids.reshape(-1, PASSAGE), values.reshape(-1, PASSAGE)
        for i in range(1, PASSAGE):   # a word counts once in a passage
            values[(ids[:, :i] == ids[:, i : i + 1]).any(axis=1), i] = 0
        return float(values.sum(axis=1).max()) / PASSAGE + self.bias

    def score(self, text: str | None) -> float:
        return float(_logistic(self.slope * self.odds(text) + self.base))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}


class _Bags:
    """Groups of numbers: sums of the groups' vectors, and sums of the groups over each number."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, numbers: int):
        self.items, self.sizes = items.astype(np.int32), sizes
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[np.argsort(items, kind="stable")]
        self.counts = np.bincount(items, minlength=numbers)

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        return _sums(vectors, self.items, self.sizes)

    def back(self, vectors: np.ndarray) -> np.ndarray:
        return _sums(vectors, self.owner, self.counts)


def _sums(vectors: np.ndarray, items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each stretch of items, about ``AT_ONCE`` items at once; an empty stretch gives zero."""
    out = np.zeros((len(sizes), *vectors.shape[1:]), vectors.dtype)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    low = 0
    while low < len(full):
        begin = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, begin + AT_ONCE, "right")), low + 1)
        starts = ends[low:high] - sizes[full[low:high]] - begin
        out[full[low:high]] = np.add.reduceat(vectors[items[begin : ends[high - 1]]], starts, axis=0)
        low = high
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _embeddings(texts: list[list[str]], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Joint training; the buckets' shares of the log odds, and the bias."""
    number: dict[str, int] = {}
    in_passages, lengths, sizes, seen = array("i"), array("i"), [], []
    for text in texts:
        split = passages(text)
        lengths.extend(map(len, split))
        ids = array("i", (number.setdefault(w, len(number)) for p in split for w in p))
        in_passages.extend(ids)
        sizes.append(len(split))
        seen.append(np.unique(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
    of_word = [np.array(subwords(w), np.int32) for w in number]
    in_texts = np.zeros(BUCKETS, np.int32)
    for ids in seen:
        if len(ids):
            in_texts[np.unique(np.concatenate([of_word[w] for w in ids]))] += 1
    buckets, own = np.flatnonzero(in_texts >= min(TEXTS, len(texts))), np.full(BUCKETS, -1, np.int32)
    own[buckets] = np.arange(len(buckets))
    parts = np.array([len(w) for w in of_word], np.int64)
    flat = own[np.concatenate([*of_word, np.zeros(0, np.int32)])]
    with_vector = np.bincount(np.repeat(np.arange(len(parts)), parts)[flat >= 0], minlength=len(parts))
    grams = _Bags(flat[flat >= 0], with_vector, len(buckets))
    bags = _Bags(np.array(in_passages, np.int32), np.array(lengths, np.int64), len(number))
    parts, sizes = parts.astype(np.float32)[:, None], np.array(sizes)
    del of_word, flat, seen, in_passages, lengths
    starts, text_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    clean = toxic[text_of] == 0

    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 0.1, (len(buckets), SIZE)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, SIZE).astype(np.float32), np.float32(0)
    moving, turning, norms = np.zeros_like(vectors), np.zeros_like(weights), np.zeros(2)
    for step in range(STEPS):
        by_word = grams.sums(vectors) / parts
        by_passage = bags.sums(by_word) / PASSAGE
        odds = SCALE * (by_passage @ weights) + bias
        soft = SOFT if step < FIRST_STEPS else 1.0
        part = np.exp((odds - np.maximum.reduceat(odds, starts)[text_of]) / soft)
        part /= np.add.reduceat(part, starts)[text_of]
        of_text = np.add.reduceat(part * odds, starts)
        off = _logistic(of_text) - toxic
        off *= np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
        slope = part * off[text_of]
        every = 1.0 if step < FIRST_STEPS else 0.3
        slope[clean] = (1 - every) * slope[clean] + every * 0.5 * _logistic(odds[clean]) / max(clean.sum(), 1)
        slope = slope.astype(np.float32)
        turn = SCALE * (slope @ by_passage)
        back = bags.back(SCALE / PASSAGE * slope[:, None] * weights[None])
        move = grams.back(back / parts) + DECAY * vectors
        norms += (float((move * move).sum()), float(turn @ turn))
        moving, turning = 0.9 * moving + move, 0.9 * turning + turn
        vectors -= RATE * moving / np.sqrt(norms[0] + 1e-12) * 4
        weights -= RATE * turning / np.sqrt(norms[1] + 1e-12) * 0.1
        bias -= np.float32(RATE * slope.sum())
    shares = np.zeros(BUCKETS, np.float32)
    shares[buckets] = SCALE * (vectors @ weights)
    return shares, float(bias)


def _fit_line(odds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the log odds, with a weak pull to slope 1 of the standardised odds."""
    middle, spread = float(np.median(odds)), float(odds.std()) + 1e-6
    x = np.stack([(odds - middle) / spread, np.ones(len(odds))], 1)
    w, pull = np.array([1.0, 0.0]), np.array([0.05, 1e-3])
    for _ in range(50):
        p = _logistic(x @ w)
        slope = x.T @ (p - toxic) + pull * (w - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts, which do not depend on their order."""
    rows = sorted(zip((xxhash.xxh64_intdigest(t.encode()) for t in texts), texts, toxic))
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(toxic)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 30.0 if share > 0.5 else -30.0)
    split = [words(t) for _, t, _ in rows]
    # every fifth text of each label is left to the logistic fit, if there are enough
    turn = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    aside = (turn % FOLDS == 0) if min(y.sum(), (1 - y).sum()) >= 2 * FOLDS else np.zeros(len(y), bool)
    shares, bias = _embeddings([t for t, a in zip(split, aside) if not a], y[~aside])
    model = Model(shares, bias, 1.0, 0.0)
    if aside.any():
        odds = np.array([model.odds(r[1]) for r, a in zip(rows, aside) if a])
        model.slope, model.base = _fit_line(odds, y[aside])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: at most ``sample`` of each label, none of a held-out document."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("toxic") == label).orderBy(*order).limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * sample rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= SAMPLE_CHARS)
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            scores = np.array([of.score(t.as_py()) for t in batch.column(2)], np.float64)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return texts.mapInArrow(rows, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores of all documents by a model of their labels."""
    return scored(docs, train(*labelled_sample(docs, labels, sample)))
