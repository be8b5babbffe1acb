"""The pipeline against brute force, stage by stage, each on what the one before kept."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallyframe.llm import packing, queries, toxicity
from tests.compare import TESTDATA

from . import brute

FOLDER = str(TESTDATA / "sf0.001")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    documents = queries.table(spark, FOLDER, "documents")
    labels = queries.learned(queries.table(spark, FOLDER, "labels"), 3, 1)
    scores = toxicity.score_documents(documents, toxicity.train(documents, labels))
    toxic = {r.doc_id for r in scores.collect() if r.score >= 0.7}
    now = [(i, t) for i, t in pairs(documents) if i not in toxic]
    assert toxic and len(now) > 100

    near = brute.near(now)
    one = [(i, t) for i, t in now if near[i][1] == i]
    assert len(one) < len(now)

    cut = []
    for (i, text), (n_words, n_removed, kept) in brute.passages(one).items():
        if n_removed == 0:
            cut.append((i, text))
        elif n_removed < n_words:
            cut.append((i, kept.decode()))

    items = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    leaks = brute.held_items(cut, [(i, " ".join(words(t)[1:-1])) for i, t in items], words)
    left = {i: t for i, t in cut if i not in {doc for doc, _ in leaks}}

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in left.items()}
    found = {}
    for r in corpus_pipeline.run(spark, FOLDER).orderBy("doc_id", "start").collect():
        found.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert found == want


def test_the_order_of_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("ended", [True, False])
def test_packing_leaves_no_words_in_workers(monkeypatch, ended):
    """Workers also run the other stages: words kept from packing took an executor over its memory there."""
    given = {}
    monkeypatch.setattr(packing, "pack_powers_of_two", lambda docs, path, **more: given.update(more))
    corpus_pipeline.pack(None, None, FOLDER)
    path = queries.tokenizer_path()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two, three", "four"]})
    kept = [b.to_pylist() for b in packing._packed(iter([batch]), path, 4096, 2)]
    encoder = packing.encoder(path)
    assert encoder.slots and encoder.parts
    pieces = packing._packed(iter([batch]), path, 4096, 2, **given)
    if ended:
        assert [b.to_pylist() for b in pieces] == kept
    else:  # a task that fails or is stopped
        next(pieces)
        pieces.close()
    assert not encoder.slots and not encoder.parts and not len(encoder.flat)
    assert packing.encoder(path) is encoder
