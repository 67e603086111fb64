"""The pipeline's stages against plain versions of them."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from voxloom.llm.packing import load_encoder
from voxloom.llm.queries import tokenizer_path


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, DATA), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(got) <= set(rows) and len(got) >= 0.98 * len(rows)
        elif name == "exact_dedup":
            best = {}
            for i, t in kept.items():
                best[t.translate(brute._LOWER)] = max(i, best.get(t.translate(brute._LOWER), -1))
            assert set(got) == set(best.values())
        elif name == "ngram_join":
            found = brute.jaccard_components(list(kept.items()))
            assert set(got) == {c for _, c in found.values()}
        else:
            assert got == {i: t for i, (t, _) in brute.span_dedup(list(kept.items())).items()}
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() <= docs.where("n_chars is null").count() + sum(len(t) != n for t, n in ((r.text, r.n_chars) for r in docs.collect()))
        kept = got
    encode = load_encoder(tokenizer_path("byte_bpe_50k.json"))
    total = sum(len(encode(t or "")) + 1 for t in kept.values())
    pieces = corpus_pipeline.packing(spark, docs, DATA)
    assert pieces.agg(F.sum("length")).first()[0] == total
    by_doc, at = {}, 0
    for p in sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset)):  # the pieces tile the sequences and the documents
        assert p.sequence_id * 1024 + p.offset == at and p.offset + p.length <= 1024
        at += p.length
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    assert set(by_doc) == set(kept)
    for i, found in by_doc.items():
        ids, begin = np.append(encode(kept[i] or ""), 0).astype("<u4"), 0
        for start, length, crc in sorted(found):
            assert start == begin and crc == zlib.crc32(ids[start : start + length].tobytes())
            begin += length
        assert begin == len(ids)
    assert corpus_pipeline.run(spark, DATA).agg(F.sum("length")).first()[0] == total


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one text", "en", "a", 8), (3, "one text", "en", "a", 8), (None, "another text", "en", None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, DATA), name)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, "another text"), (3, "one text"), (3, "one text")]
    assert corpus_pipeline.packing(spark, docs.limit(0), DATA).count() == 0
