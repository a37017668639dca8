import json
import random

import pytest

from voc.schemas import PLAY_RAW
from voc.sources import files, json_array
from voc.sources.json_array import CLOSE, Summary, places, read_json_array, summary, write_json_array

SCHEMA = "id string, text string, n int, inner struct<a: array<string>, b: struct<c: string>>"
ODD = ['plain', 'say "hi"', "br}ace{s} [and] more", "back\\slash", 'end\\"', "\\", '"', "}", "{", "]", "tab\tline\nend", "Äpfel 中文 😀", "\\u007d", "", "},{", '\\"}', "\\\\}"]


def objects(n=40, seed=0):
    rng = random.Random(seed)
    out = [{"id": t, "text": t * 2, "n": i, "inner": {"a": [t, "x"], "b": {"c": t}}} for i, t in enumerate(ODD)]
    out += [{"id": str(i), "text": "".join(rng.choice(ODD) for _ in range(rng.randint(0, 5))), "n": i} for i in range(n)]
    return [*out, {}, {"id": None, "extra": [[{}], []]}]


def as_rows(path, spark, schema):
    """The read in one task that the parallel one has to equal."""
    return [tuple(r) for r in spark.read.schema(schema).option("multiLine", True).json(path).collect()]


def ranges(data: bytes, cuts: list[int]):
    """What the text reader gives to byte ranges: the fragments that begin in them, a range's first begin aside if it is no fragment's."""
    bounds = [0, *cuts, len(data)]
    out, at = [], 0
    pieces = data.split(b"}")
    begins = []
    for piece in pieces:
        begins.append((at, piece))
        at += len(piece) + 1
    if not pieces[-1]:
        begins.pop()
    for a, b in zip(bounds, bounds[1:]):
        # a fragment that begins at the end of a range still belongs to it
        mine = [p for start, p in begins if (a < start <= b or (a == 0 and start == 0))]
        if mine:
            out.append((a, mine))
    return out


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_cut_gives_the_same_places(indent, ascii_only):
    data = json.dumps(objects(6), indent=indent, ensure_ascii=ascii_only).encode()
    whole = json.loads(data)
    for cut in range(1, len(data)):
        parts = ranges(data, [cut] + ([(cut * 7) % len(data)] if (cut * 7) % len(data) > cut else []))
        found, numbers = places(("f", a, summary(fragments, a == 0)) for a, fragments in parts)
        assert numbers == {"f": (0, len(whole))}
        record = 0
        for a, fragments in parts:
            place = found["f", a]
            assert place.record == record
            record += place.ends


def test_summaries_combine_like_the_whole():
    data = json.dumps(objects(20)).encode()
    whole = summary(data.split(b"}"), True)
    for seed in range(30):
        rng = random.Random(seed)
        parts = [summary(f, a == 0) for a, f in ranges(data, sorted(rng.sample(range(1, len(data)), 9)))]
        # any bracketing of the combination gives the same
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [Summary(*parts[i].then(parts[i + 1]))]
        assert (parts[0].turns, parts[0].depth) == (whole.turns, whole.depth)


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [29, 83, 400, 100_000])
def test_rows_and_order_equal_the_read_in_one_task(spark, tmp_path, small_ranges, size):
    path = str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text(json.dumps(objects(), indent=1 if size == 400 else None, ensure_ascii=size == 83), encoding="utf-8")
    want = as_rows(path, spark, SCHEMA)
    small_ranges(size)
    schema = spark.createDataFrame([], SCHEMA).schema
    got = read_json_array(spark, path, schema)
    assert got.columns == [*schema.fieldNames(), "pos"]
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[-1])
    assert [r[-1] for r in rows] == list(range(len(want))) and [r[:-1] for r in rows] == want


def test_several_files_empty_ones_and_own_positions(spark, tmp_path, small_ranges):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.json").write_text(json.dumps([{"content": "third", "pos": 77}, {"content": "fourth"}]))
    (folder / "a.json").write_text("﻿" + json.dumps([{"content": "first"}, {"content": "second", "score": "no number"}]), encoding="utf-8")
    (folder / "c.json").write_text(" [ \n] ")
    (folder / "d.json").write_text("")
    small_ranges(11)
    rows = files.read_json(spark, str(folder), PLAY_RAW, True).select("pos", "content", "score").collect()
    assert sorted(map(tuple, rows)) == [(0, "first", None), (1, "second", None), (3, "fourth", None), (77, "third", None)]
    assert files.read_json(spark, str(tmp_path / "none.json"), PLAY_RAW, True).count() == 0


@pytest.mark.parametrize("text", [
    '[{"content": "a"}, {"content": "b"}', '[{"content": "a"}, {"content": "b}]', '{"content": "a"}', '[{"content": "a"} {"content": "b"}]',
    '[{"content": "a"},]', '[{"content": "a"}], [{"content": "b"}]', '[{"content": "a"}, 5, {"content": "b"}]', '[{"content": a}]', "[[{}]]", '[{"content": "a"}]]',
    '[{"content": "a"}', "nothing", '[{"content": "a"},, {"content": "b"}]', '[{"content": "a", }, {"content": "b"}]',
])
def test_a_damaged_file_is_an_error(spark, tmp_path, small_ranges, text):
    (tmp_path / "x.json").write_text(text)
    for size in (7, 1000):
        small_ranges(size)
        with pytest.raises(Exception, match="damaged JSON|whole JSON array"):
            files.read_json(spark, str(tmp_path / "x.json"), PLAY_RAW, True).collect()


def test_written_arrays_are_read_back(spark, tmp_path, small_ranges):
    rows = [(t, i, None if i % 3 else [t, "x"]) for i, t in enumerate(ODD * 3)]
    df = spark.createDataFrame(rows, "text string, n int, list array<string>").repartition(3, "n").sortWithinPartitions("n")
    write_json_array(df, str(tmp_path / "out"))
    write_json_array(df.limit(0), str(tmp_path / "none"))
    assert all(isinstance(json.loads(f.read_text()), list) for f in (tmp_path / "out").glob("part-*"))
    want = sorted(map(tuple, df.collect()), key=repr)
    small_ranges(301)
    got = read_json_array(spark, str(tmp_path / "out"), df.schema)
    assert sorted((tuple(r[:3]) for r in got.collect()), key=repr) == want
    assert sorted(r[3] for r in got.collect()) == list(range(len(want)))
    assert read_json_array(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_too_many_ranges(spark, tmp_path, small_ranges, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps(objects()))
    small_ranges(50)
    monkeypatch.setattr(json_array, "MAX_RANGES", 3)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        read_json_array(spark, str(tmp_path / "a.json"), PLAY_RAW)
    assert CLOSE == "}"
