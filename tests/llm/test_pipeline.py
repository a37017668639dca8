import numpy as np

import corpus_pipeline
from voc.llm import bpe_tree, line_templates, quality, simhash

from .conftest import prose


def test_stages_work_on_what_is_left(spark, tmp_path):
    rows = [(i, prose(i, 90 + i % 30), "en", f"src{i % 3}") for i in range(120)]
    rows += [(300 + i, prose(7, 97), "en", "src0") for i in range(4)]                                    # copies
    rows += [(400 + i, " ".join(w + "###" for w in prose(i, 70).split()), "en", "src1") for i in range(15)]   # junk
    rows += [(500, None, None, None), (501, "", "en", None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], str(tmp_path)).cache())
        assert seen[-1].columns == docs.columns
    rated, lines, unique, mixed = ([r.asDict() for r in s.collect()] for s in seen[1:])
    assert {r["doc_id"] for r in rated} == {i for i in range(120)} | {300, 301, 302, 303}
    assert len(lines) == len(rated)
    prints = [simhash.fingerprint((r["text"] or "").encode()) for r in unique]
    assert not any((a ^ b).bit_count() <= 4 for i, a in enumerate(prints) for b in prints[:i])
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in unique}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in unique}
    codec = bpe_tree.codec(corpus_pipeline.MULTI_RANKS)
    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in mixed)
    assert all(codec.decode(bytes(r["ids"])).decode() == texts[r["doc_id"]] and len(np.frombuffer(r["ids"], "<u4")) == r["n_tokens"] for r in final)


def test_every_dealt_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
    assert quality and line_templates
