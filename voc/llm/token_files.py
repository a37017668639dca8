"""Token ids of documents in range-coded files, written in ascending ``doc_id`` order and read back in parallel.

File: blocks of ``rans.BLOCK`` tokens (final states, then words), then an index compressed as one piece, then the index's
place. The index holds the documents' ids and token counts, the frequency table that all blocks of the file share, and
a checkpoint per block: offset, tokens, states, words, checksum. A reader that wants some documents takes the blocks that
the checkpoints name, checks and decodes them, and needs no other block.

A task sorts its range of ids, cuts it into files of about ``FILE_TOKENS`` tokens, and names them in the rows it returns:
one row per stretch of documents with about ``STRETCH_TOKENS`` tokens (the whole file, as it is set). Files of attempts that failed are named nowhere.

Rows: null texts count as empty; every document ends with ``end``; documents without id come first; repeated ids are ordered
by text; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voc.llm import rans, shared_files
from voc.storage import materialize, scratch_path

FILE_TOKENS, STRETCH_TOKENS = 4 << 20, 4 << 20
KEPT_WORDS = 600_000
ENCODED_BYTES = 4 << 20   # of text, encoded at once
WHOLE_TEXTS = 16          # encoded by the library in one call
MAGIC = b"VOCRANS1"
_PARTS = ("ids", "<i8"), ("known", "u1"), ("counts", "<i8"), ("symbols", "<u4"), ("freq", "<u4"), ("blocks", "<i8")


class Words:
    """Words and their ids, one behind the other in plain arrays: a fourth of what Python texts in a dictionary take."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where it is not known."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: list[str], ids: list[bytes]) -> np.ndarray:
        """The places of words that were not known."""
        places = np.arange(len(self), len(self) + len(words))
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)])
        return places

    def drop(self, n: int) -> None:
        """The first words added go."""
        self.words = pa.concat_arrays([self.words.slice(n)])
        self.ids, self.starts = self.ids[self.starts[n] :].copy(), self.starts[n:] - self.starts[n]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids by the tokenizers library, with a table of the words seen.

    The library's split begins anew at a blank or line feed that has no white space beside it. A text in which that holds for
    all of them has the ids of its words in turn, and each different word is encoded once. Other texts are encoded whole:
    they show by a word that is empty or begins or ends with white space. So are texts that hold an added token's string,
    which the library finds in texts too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.plain = path, None
        self.library = Tokenizer.from_file(path)
        # not looked for in every word; texts that hold one go to the library as it comes
        self.library.encode_special_tokens = True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self._whole(["\n"])[0]
        self.blank = np.zeros(self.library.get_vocab_size(), bool)
        self.blank[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.startswith("Ġ")]] = True
        self.first = Words()   # words at the start of a text or line
        self.after = Words()   # words behind a blank

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Many words in one call. A word's first id, and no other, stands for text that begins with the blank before it."""
        out: list[bytes] = []
        for low in range(0, len(words), 4_096):
            some = words[low : low + 4_096]
            ids = np.frombuffer(self._whole([" " + " ".join(some)])[0], "<u4") if before else np.zeros(0, "<u4")
            starts = np.flatnonzero(self.blank[ids]) * 4
            if not before or len(starts) != len(some) or starts[0]:
                out += self._whole([before + w for w in some])
                continue
            data, starts = ids.tobytes(), starts.tolist()
            out += [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
        return out

    def _table(self, words: pa.Array, before: str) -> np.ndarray:
        """Places of the words in the table of ``before``; -1 for what is no word."""
        known = self.after if before else self.first
        if len(known) > KEPT_WORDS:  # the older half goes; words that are used come back at once
            known.drop(len(known) // 2)
        at = known.find(words)
        gaps = np.flatnonzero(at < 0)
        new = words.take(pa.array(gaps)).to_pylist()
        fit = [i for i, w in enumerate(new) if w and not w[0].isspace() and not w[-1].isspace()]
        new = [new[i] for i in fit]
        at[gaps[fit]] = known.add(new, self._words(new, before))
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        coded = lists.flatten().dictionary_encode()
        number, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        feed = pc.index(words, "\n").as_py()
        bare = np.zeros(len(number), bool)
        bare[1:] = number[:-1] == feed
        bare[starts[:-1]] = True
        # one table of ids for words behind a blank, then for the others, then the line feed
        row = np.zeros(2 * len(words), np.int64)
        flat, sizes, odd, n = [], [], [], 0
        for k, (before, mask) in enumerate(((" ", ~bare), ("", bare))):
            used = np.zeros(len(words), bool)
            used[number[mask]] = True
            used = np.flatnonzero(used)
            row[used + k * len(words)] = n + np.arange(len(used))
            n += len(used)
            at, known = self._table(words.take(pa.array(used)), before), self.after if before else self.first
            odd.append(at < 0)
            sizes.append(np.where(at < 0, 0, known.starts[at + 1] - known.starts[at]))
            flat.append(known.ids[_ranges(known.starts[at], sizes[-1])])
        if feed >= 0:
            row[[feed, feed + len(words)]] = n
        odd, sizes = np.append(np.concatenate(odd), False), np.append(np.concatenate(sizes), len(self.feed) // 4)
        flat, place = np.concatenate([*flat, np.frombuffer(self.feed, "<u4")]), np.cumsum(sizes) - sizes
        at = row[number + len(words) * bare]
        size = sizes[at]
        tokens = flat[_ranges(place[at], size)]
        ends = np.cumsum(size)
        bounds = np.concatenate([[0], ends])[starts]
        out = [tokens[a:b] for a, b in zip(bounds, bounds[1:])]
        whole = np.unique(np.searchsorted(starts, np.flatnonzero(odd[at]), "right") - 1).tolist()
        for low in range(0, len(whole), WHOLE_TEXTS):  # the library's own results are many times their ids
            some = whole[low : low + WHOLE_TEXTS]
            for i, data in zip(some, self._whole([texts[i].as_py() for i in some])):
                out[i] = np.frombuffer(data, "<u4")
        for added in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, added).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self._as_it_comes(texts[i].as_py())
        return out

    def _as_it_comes(self, text: str) -> np.ndarray:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def packed(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file."""
    tokens = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    table, out, blocks = rans.Table.counted(tokens), io.BytesIO(), []
    for low in range(0, len(tokens), rans.BLOCK):
        part = tokens[low : low + rans.BLOCK]
        states, words = rans.encode(part, table)
        data = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        blocks.append((out.tell(), len(part), len(states), len(words), zlib.crc32(data)))
        out.write(data)
    arrays = {
        "ids": [i or 0 for i in doc_ids], "known": [i is not None for i in doc_ids], "counts": [len(i) for i in ids],
        "symbols": table.symbols, "freq": table.freq, "blocks": np.array(blocks, "<i8").reshape(-1),
    }
    index = b"".join(len(arrays[k]).to_bytes(8, "little") + np.asarray(arrays[k], kind).tobytes() for k, kind in _PARTS)
    index = zstandard.compress(index, 3)
    at = out.tell()
    out.write(index)
    out.write(b"".join(n.to_bytes(8, "little") for n in (at, len(index), zlib.crc32(index))) + MAGIC)
    return out.getvalue()


class TokenFile:
    """A file opened for reading."""

    def __init__(self, uri: str):
        self.uri, self.reader = uri, shared_files.Reader(uri)
        tail = self.reader.read(self.reader.size - 32, 32)
        at, size, check = (int.from_bytes(tail[k : k + 8], "little") for k in (0, 8, 16))
        index = self.reader.read(at, size)
        if tail[24:] != MAGIC or zlib.crc32(index) != check:
            raise ValueError(f"damaged file {uri}")
        index, place = zstandard.decompress(index), 0
        for name, kind in _PARTS:
            n = int.from_bytes(index[place : place + 8], "little")
            setattr(self, name, np.frombuffer(index, kind, n, place + 8))
            place += 8 + n * np.dtype(kind).itemsize
        self.blocks = self.blocks.reshape(-1, 5)
        self.table = rans.Table(self.symbols, self.freq)
        self.ends = np.cumsum(self.counts)

    def tokens(self, low: int, high: int) -> np.ndarray:
        """Tokens ``low`` to ``high`` of the file, from the blocks that hold them."""
        out = []
        for b in range(low // rans.BLOCK, -(-high // rans.BLOCK)):
            offset, n, states, words, check = self.blocks[b].tolist()
            data = self.reader.read(offset, 8 * states + 4 * words)
            if zlib.crc32(data) != check:
                raise ValueError(f"damaged block {b} of {self.uri}")
            part = rans.decode(n, np.frombuffer(data, "<u8", states), np.frombuffer(data, "<u4", words, 8 * states), self.table)
            out.append(part[max(0, low - b * rans.BLOCK) : high - b * rans.BLOCK])
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def documents(self, first: int, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
        low = int(self.ends[first] - self.counts[first])
        tokens = self.tokens(low, int(self.ends[first + n - 1]))
        for i in range(first, first + n):
            end = int(self.ends[i]) - low
            yield (int(self.ids[i]) if self.known[i] else None), tokens[end - int(self.counts[i]) : end]


def write(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Encodes and writes; returns one row per stretch of documents: ``place, seq, uri, first, docs, tokens``."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    tail = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, seq = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, doc_ids, ids
            uri = f"{folder}/part-{place:06d}-{seq:04d}-{uuid.uuid4().hex}.rans"
            shared_files.write(uri, packed(doc_ids, ids))
            sizes = np.array([len(i) for i in ids])
            turns = (np.cumsum(sizes) - sizes) // STRETCH_TOKENS
            firsts = np.flatnonzero(np.append(True, turns[1:] != turns[:-1]))
            rows = [(place, seq, uri, int(a), int(b - a), int(sizes[a:b].sum())) for a, b in zip(firsts, [*firsts[1:], len(ids)])]
            seq, doc_ids, ids = seq + 1, [], []
            return pa.record_batch([pa.array(c) for c in zip(*rows)], names=["place", "seq", "uri", "first", "docs", "tokens"])

        gathered = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            turns = np.cumsum(sizes, dtype=np.int64) // ENCODED_BYTES
            edges = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                doc_ids += batch.column(0).slice(low, high - low).to_pylist()
                for found in own.encode(batch.column(1).slice(low, high - low)):
                    ids.append(np.append(found, tail))
                    gathered += len(ids[-1])
                if gathered > FILE_TOKENS:
                    yield flush()
                    gathered = 0
        if doc_ids:
            yield flush()

    rows = ordered.mapInArrow(run, "place bigint, seq bigint, uri string, first bigint, docs bigint, tokens bigint")
    return materialize(rows, "token_files")


def read(stretches: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files; start counts the ids of all documents before."""
    # one row per stretch of about a million tokens
    before = Window.orderBy("place", "seq", "first").rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(Window.orderBy("place", "seq", "first"))
    placed = stretches.withColumns({"start": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "number": number})
    parts = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, start, out = TokenFile(row["uri"]), row["start"], []
                for doc_id, tokens in file.documents(row["first"], row["docs"]):
                    out.append((doc_id, start, len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())))
                    start += len(tokens)
                file.reader.close()
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartitionById(parts, F.col("number")).select("uri", "first", "docs", "start")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
