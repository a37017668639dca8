"""Byte-level BPE by rank files: encoding and decoding as a reduction over a tree of halves.

A pre-token (one match of the split pattern) longer than a leaf is cut in halves, the halves are encoded on their own, and
the two token lists are joined: a window around the seam is re-encoded and grows until both of its edges are stable. An edge
is stable when encoding the two tokens beside it together gives these two tokens again. A list all of whose neighbours are
stable in that sense is the encoding of its bytes, and the neighbours inside a window and outside of it are stable by
construction, so that the test of the two edges proves the whole. Decoding concatenates bytes up the same kind of tree.

Texts that have no adjacent white space are split at blanks and line feeds before the pattern runs: the pattern starts anew
there whatever stands beside it. A worker keeps the encodings of up to ``KEPT_WORDS`` words of at most 64 characters, and
of one text on top.

Rows: null and empty texts give no ids; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LEAF = 12            # bytes that are merged at once
KEPT_WORDS = 700_000  # words whose encoding a worker keeps
DECODE_LEAF = 4_096
ADJACENT = re.compile(r"\s\s|^\s|\s\Z")
# white space as the rank files' own library knows it
WHITE = r"\t-\r \x85\xa0  -     　"


def split_pattern(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    inside = pattern.replace(r"[^\s\p", rf"[^{WHITE}\p")
    return regex.compile(inside.replace(r"(?!\S)", rf"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]"))


class Ranks:
    """Tokens and merges of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.stable: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}

    def merge(self, a: int, b: int) -> int:
        """The id of the two tokens together, which is its rank; a large number if there is none."""
        found = self.merged.get((a, b))
        if found is None:
            found = self.ids.get(self.tokens[a] + self.tokens[b], 1 << 60)
            if len(self.merged) > 2_000_000:
                self.merged.clear()
            self.merged[a, b] = found
        return found

    def leaf(self, data: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, the leftmost first, until none has a rank."""
        ids = [self.single[b] for b in data]
        ranks = list(map(self.merge, ids, ids[1:]))
        while ranks:
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
            del ranks[i]
            if i:
                ranks[i - 1] = self.merge(ids[i - 1], low)
            if i < len(ranks):
                ranks[i] = self.merge(low, ids[i + 1])
        return ids

    def window(self, data: bytes) -> list[int]:
        """The same merges with a heap, for windows that have grown."""
        if len(data) <= 64:
            return self.leaf(data)
        ids, left, right = [self.single[b] for b in data], list(range(-1, len(data) - 1)), list(range(1, len(data) + 1))
        right[-1] = -1
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.merge(a, b)) < 1 << 60]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or self.merge(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j], right[i] = rank, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (r := self.merge(rank, ids[right[i]])) < 1 << 60:
                    heapq.heappush(heap, (r, i))
            if left[i] >= 0 and (r := self.merge(ids[left[i]], rank)) < 1 << 60:
                heapq.heappush(heap, (r, left[i]))
        return [x for x in ids if x >= 0]

    def together(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when they are encoded as one text."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > 500_000:
                self.stable.clear()
            found = self.stable[a, b] = self.window(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i, j, step = max(len(left) - 1, 0), min(1, len(right)), 1
        while True:
            inner = self.window(self.decode(left[i:] + right[:j]))
            open_left = i > 0 and not self.together(left[i - 1], inner[0])
            open_right = j < len(right) and not self.together(inner[-1], right[j])
            if not open_left and not open_right:
                return left[:i] + inner + right[j:]
            step *= 2
            i = max(i - step, 0) if open_left else i
            j = min(j + step, len(right)) if open_right else j

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ids.get(data)
        return [whole] if whole is not None else self.tree(data)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class Words(dict):
    """Encodings (ids as unsigned 32-bit little-endian bytes) of texts put after ``before``, worked out when missing."""

    def __init__(self, ranks: Ranks, pattern: regex.Pattern, before: str):
        super().__init__()
        self.ranks, self.pattern, self.before = ranks, pattern, before

    def __missing__(self, word: str) -> bytes:
        ids = [i for p in self.pattern.findall(self.before + word) for i in self.ranks.piece(p.encode())]
        data = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = data
        return data


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = Ranks(path), split_pattern(pattern)
        self.first, self.after = Words(self.ranks, self.pattern, ""), Words(self.ranks, self.pattern, " ")

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian numbers."""
        if not text:
            return b""
        if len(self.after) + len(self.first) > KEPT_WORDS:   # at most the words of one text come on top
            self.after.clear()
            self.first.clear()
        if ADJACENT.search(text):
            return b"".join([self.first[p] for p in self.pattern.findall(text)])
        out, feed, after = [], self.first["\n"], self.after
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(feed)
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out += [after[w] for w in rest]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.ranks.decode(np.frombuffer(ids, "<u4").tolist())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a rank file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``ids`` (binary, unsigned 32-bit little-endian) and ``n_tokens`` of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in _parts(batch, "_text"):
                ids = [own.encode(t.as_py() or "") for t in part.column("_text")]
                yield pa.record_batch(
                    [part.column(c) for c in keep] + [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                    names=[*keep, "ids", "n_tokens"],
                )

    rows = docs.select(*keep, docs["text"].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, ids binary, n_tokens bigint")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids of each text, and the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = map(list, zip(*out)) if out else ([], [], [])
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _parts(batch: pa.RecordBatch, name: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes, so that an output batch stays small."""
    sizes = np.fromiter((len(x.as_py() or "") for x in batch.column(name)), np.int64, batch.num_rows)
    turns = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
