"""What one document or one query must not see of another."""

import threading

import numpy as np
import pytest

from strandlake.llm import common, pii, token_files


def test_spans_do_not_depend_on_batches(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text RLIKE '[0-9@]'").select("text").limit(150).collect()]
    field = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), max_docs=150)
    found = [(s, pii.tokens_of(t, s)) for t, s in ((t, pii.base_spans(t)) for t in texts)]
    together = pii.added_spans(found, field)
    assert together == [pii.added_spans([x], field)[0] for x in found] == pii.added_spans(found[::-1], field)[::-1]
    graphs = [g[1:] for _, g in found if len(g[2])]
    feats, labels, *kinds = pii._joined(graphs)
    owner = np.repeat(np.arange(len(graphs)), [len(g[1]) for g in graphs])
    alone = np.concatenate([field.beliefs(g[0], g[1], *g[2:]) for g in graphs])
    assert (field.beliefs(feats, labels, *kinds, owner=owner) == alone).all()  # to the last bit


def test_queries_in_two_threads_keep_their_folders(spark):
    inside, left, got = threading.Event(), threading.Event(), []

    def first():
        with common.scratch(spark):
            table = common.materialise(spark.range(100))
            inside.set()
            left.wait(60)
            got.append(table.count())

    thread = threading.Thread(target=first)
    thread.start()
    inside.wait(60)
    with common.scratch(spark):
        assert common.materialise(spark.range(7)).count() == 7
    left.set()
    thread.join(60)
    assert got == [100]


def test_token_files_go_when_reading_fails(spark, tmp_path, monkeypatch):
    import public_tokenizers

    folder = f"file://{tmp_path}/own"
    monkeypatch.setattr(token_files, "shared_dir", lambda spark: folder)
    monkeypatch.setattr(token_files, "read_token_files", lambda manifest, parts: 1 / 0)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    with pytest.raises(ZeroDivisionError):
        token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert not (tmp_path / "own-tokens").exists()
