import hashlib
import random

import pytest

from voc.llm import multiset_hash as mh

from .conftest import prose


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (d, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        edited = (text[: len(text) - n] + following[:n]) if n else text
        a, b, c = (mh.fingerprint(t.encode()) for t in (text, edited, following))
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), mh.likeness(a, b), mh.likeness(a, c)))
    return sorted(out, key=repr)


def test_edits_equal_brute_force(odd_docs, odd_rows):
    got = sorted(map(tuple, mh.edits(odd_docs).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in odd_rows])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_documents(spark, n):
    rows = [(i * 10, prose(i, 50)) for i in range(n)]
    got = sorted(map(tuple, mh.edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_equal_ids(spark):
    rows = [(5, prose(i % 3, 40 + i)) for i in range(9)] + [(i, "x") for i in range(12)]
    got = sorted(map(tuple, mh.edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_order_does_not_matter_and_paragraphs_come_and_go():
    parts = [f"This is sentence number {i}." for i in range(50)]
    shuffled = random.Random(1).sample(parts, 50)
    whole = mh.fingerprint(" ".join(parts).encode())
    assert whole == mh.fingerprint("\n".join(shuffled).encode())
    gone = mh.of_paragraphs(p.encode() for p in parts[:7])
    assert whole - gone == mh.fingerprint(" ".join(parts[7:]).encode())
    assert (whole - gone) + gone == whole
    assert whole != mh.fingerprint(" ".join([*parts, parts[0]]).encode())   # a multiset, not a set
    assert mh.Fingerprint.from_hex(whole.hex()) == whole


def test_likeness_estimates_the_shared_share():
    parts = [f"This is sentence number {i}." for i in range(400)]
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        kept = int(400 * share)
        other = parts[:kept] + [f"Another one, number {i}." for i in range(400 - kept)]
        a, b = mh.fingerprint(" ".join(parts).encode()), mh.fingerprint(" ".join(other).encode())
        assert abs(mh.likeness(a, b) - share) < 0.2
    empty = mh.fingerprint(b"")
    assert mh.likeness(empty, empty) == 1.0 and mh.likeness(empty, a) == 0.0


def test_very_many_equal_lines():
    a, b = (mh.fingerprint(b"the very same line\n" * n) for n in (40_000, 30_000))
    assert mh.likeness(a, b) > 0.99
    assert mh.Fingerprint.from_hex(a.hex()) == a and (a - b) + b == a


def test_empty_table(no_docs):
    assert mh.edits(no_docs).collect() == [] and mh.fingerprints(no_docs).collect() == []
