import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from voc.llm import bpe_tree

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as lines:
    LIBRARY = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)},
    )
CODEC = bpe_tree.codec(PATH)


def same(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cd\n\té中文1.!'s\x1c \xa0😀x"), max_size=80))
def test_random_texts_equal_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["a" * 5_000, "ab" * 3_000, "中文字" * 2_000, "the" * 3_000, "=-" * 4_000, "0" * 3_001, " " * 2_000, "éèà" * 900 + "."])
def test_long_pieces_are_joined_up_the_tree(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(1, 119))
def test_joining_two_encodings_encodes_the_whole(data, cut):
    ranks = CODEC.ranks
    left, right = data[:cut], data[cut:]
    assert ranks.join(ranks.window(left), ranks.window(right)) == ranks.window(data) == ranks.leaf(data)


def test_query_columns(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, bpe_tree.digests(odd_docs, PATH).collect()), key=repr)
    expected = []
    for row in odd_rows:
        ids = np.array(LIBRARY.encode_ordinary(row[1] or ""), "<u4")
        expected.append((row[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert bpe_tree.digests(no_docs, PATH).collect() == []
    assert bpe_tree.encoded(odd_docs, PATH, keep=("doc_id", "kept", "size")).count() == len(odd_rows)


def test_the_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_tree, "KEPT_WORDS", 1_000)
    own = bpe_tree.Codec(PATH)
    for n in range(8):   # with blank lines and without
        text = ("\n\n" if n % 2 else " ").join(f"word{n}x{i}" for i in range(900))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert len(own.first) + len(own.after) <= 1_000 + 2 * 900 + 2


def test_halves_are_joined(monkeypatch):
    own, joins = bpe_tree.Codec(PATH), []
    real = own.ranks.join
    monkeypatch.setattr(own.ranks, "join", lambda a, b: joins.append(1) or real(a, b))
    text = "thehandioninger andthereofwithin uncharacteristically"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text) and len(joins) >= 3
