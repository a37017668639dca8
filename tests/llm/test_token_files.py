import gc
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voc.llm import rans, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)   # as the library comes, apart from the operator's own object


@pytest.mark.parametrize("n", [0, 1, 5, rans.LANES, rans.LANES + 1, 70_000, rans.BLOCK])
@pytest.mark.parametrize("symbols", [1, 3, 50_257])
def test_blocks_come_back(n, symbols):
    tokens = (np.random.default_rng(n).zipf(1.3, n) % symbols).astype("<u4")
    table = rans.Table.counted(tokens)
    states, words = rans.encode(tokens, table)
    assert (rans.decode(n, states, words, table) == tokens).all()
    assert not n or int(table.freq.sum()) == 1 << rans.BITS


def test_coded_size_is_near_the_entropy():
    tokens = (np.random.default_rng(1).zipf(1.5, rans.BLOCK) % 1_000).astype("<u4")
    p = np.bincount(tokens) / len(tokens)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(tokens)
    states, words = rans.encode(tokens, rans.Table.counted(tokens))
    assert (len(words) * 32 + len(states) * 32) < 1.06 * bits + 64 * rans.LANES


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cd\n\té中1.!'s\x1c \xa0😀\x00"), max_size=40), max_size=20))
def test_ids_equal_the_library(texts):
    found = token_files.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [f.tolist() for f in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_and_marks_equal_the_library():
    own, rng = token_files.Encoder(PATH), random.Random(4)
    parts = ["the", "ing", "a", " ", " ", " ", "  ", "\n", ".", ",", "'s", "12", "<|endoftext|>", "é", "\xa0", "#"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3_000)]
    found = [f.tolist() for low in range(0, 3_000, 500) for f in own.encode(pa.array(texts[low : low + 500]))]
    assert found == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    quoting = "a page that quotes <|endoftext|> in its text"
    ids = own.encode(pa.array([quoting]))[0].tolist()
    assert ids == LIBRARY.encode(quoting, add_special_tokens=False).ids and LIBRARY.token_to_id("<|endoftext|>") in ids


def held_bytes():
    gc.collect()
    return tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()


def test_the_table_of_words_is_small_and_bounded(monkeypatch):
    own, words = token_files.Encoder(PATH), [f"w{i:06x}q" for i in range(60_000)]
    expected = [e.ids for e in LIBRARY.encode_batch(words, add_special_tokens=False)]
    tracemalloc.start()
    try:
        before = held_bytes()
        for low in range(0, len(words), 6_000):
            own.encode(pa.array([" ".join(["a", *words[low : low + 6_000]])]))
        assert len(own.after) >= 60_000 and held_bytes() - before < 80 * 60_000
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(token_files, "KEPT_WORDS", 1_000)
    for low in (0, 500, 58_000, 0):
        found = own.encode(pa.array(words[low : low + 900]))
        assert [f.tolist() for f in found] == expected[low : low + 900]
    assert len(own.first) < 2_000


def test_texts_that_are_encoded_whole_go_to_the_library_a_few_at_a_time(monkeypatch):
    own, calls, real = token_files.Encoder(PATH), [], token_files.Encoder._whole
    texts = [f"two  blanks {i} and a  row" for i in range(200)]
    monkeypatch.setattr(token_files.Encoder, "_whole", lambda self, some: calls.append([t for t in some if "  " in t]) or real(self, some))
    found = [f.tolist() for f in own.encode(pa.array(texts))]
    assert found == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, calls)) == 200 and max(map(len, calls)) <= 16


def test_files_hold_every_document(spark, odd_docs, odd_rows, monkeypatch):
    stretches = token_files.write(odd_docs, PATH, 0)
    got = sorted(map(tuple, token_files.read(stretches).collect()), key=lambda r: r[1])
    expected, start = [], 0
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for row in ordered:
        ids = np.append(np.array(LIBRARY.encode(row[1] or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        expected.append((row[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_a_stretch_is_read_from_its_blocks_only(tmp_path):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 500, rng.integers(0, 30_000)).astype("<u4") for _ in range(100)]
    path = tmp_path / "x.rans"
    path.write_bytes(token_files.packed(list(range(100)), ids))
    file = token_files.TokenFile(str(path))
    assert len(file.blocks) > 2
    for first, n in ((0, 100), (17, 1), (40, 30), (99, 1)):
        got = list(file.documents(first, n))
        assert [d for d, _ in got] == list(range(first, first + n))
        assert all((a == b).all() for (_, a), b in zip(got, ids[first : first + n]))


def test_damage_is_found(tmp_path):
    path = tmp_path / "x.rans"
    data = bytearray(token_files.packed([1, 2], [np.arange(500, dtype="<u4")] * 2))
    data[200] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.TokenFile(str(path)).documents(0, 2))


def test_empty_table(no_docs):
    assert token_files.read(token_files.write(no_docs, PATH, 0)).collect() == []
