"""Counts added up in a task, hashes whatever the block."""

import pyarrow as pa

from sevfold.llm import divergence, textkernel as K


def test_a_task_adds_up_the_counts_of_its_batches(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["one two two", "two", "one"], "lang": ["en", "en", "en"], "source": ["a", "a", "b"]})
    whole = lambda: [r for b in divergence._counter(64)(iter([batch] * 6)) for r in b.to_pylist()]
    rows = whole()
    assert sorted((r["source"], r["docs"], r["count"]) for r in rows) == [("a", 6, 6), ("a", 12, 18), ("b", 6, 6)]
    monkeypatch.setattr(divergence, "HELD", 3)  # sent at once
    monkeypatch.setattr(divergence, "SENT", 2)
    parts = whole()
    assert len(parts) == 18 and sum(r["count"] for r in parts) == 30 and {r["lang"] for r in parts} == {"en"}


def test_terms_are_spelt_once_for_all_groups():
    batch = pa.RecordBatch.from_pydict({"text": ["one Two", "two", "one"], "lang": ["en", "fr", "en"], "source": ["a", "a", "b"]})
    rows = [r for b in divergence._speller(64, False)(iter([batch])) for r in b.to_pylist()]
    assert sorted(r["term"] for r in rows) == ["one", "two"]
    assert sorted((r["lang"], r["source"], r["term"], r["docs"]) for b in divergence._speller(64, True)(iter([batch])) for r in b.to_pylist()) == [
        ("en", "a", "one", 1), ("en", "a", "two", 1), ("en", "b", "one", 1), ("fr", "a", "two", 1)
    ]


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["ab cd " * 50, None, "xy " * 70]})
    whole = K.words(next(K.pieces(batch.column("text"))), K.NOT_SPACE).hashes
    monkeypatch.setattr(K, "BLOCK", 16)
    assert (K.words(next(K.pieces(batch.column("text"))), K.NOT_SPACE).hashes == whole).all()
