"""Whole documents in few sequences, against the ids themselves and a lower bound."""

import random

import numpy as np
import public_tokenizers
import pytest

from pointweave.llm import encoding, residual_packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids_of(text):
    return [*encoding.encoder(BYTE).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def checked(docs, capacity, id_col="doc_id"):
    """The number of sequences, after all pieces were held against the whole documents."""
    rows = residual_packing.pack_documents(docs, BYTE, 0, capacity, id_col).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[id_col], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for r in docs.collect():
        want.setdefault(r[id_col], []).append(ids_of(r["text"]))
    assert set(by_doc) == set(want)
    for key, texts in want.items():
        pieces = [(r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in by_doc[key]]
        expected = [(k, start, ids[start : start + n]) for ids in texts for k, (start, n) in enumerate(residual_packing.cut(len(ids), capacity))]
        assert sorted(pieces) == sorted(expected)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_cuts():
    assert residual_packing.cut(5, 8) == [(0, 5)] and residual_packing.cut(8, 8) == [(0, 8)]
    assert residual_packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)] and residual_packing.cut(16, 8) == [(0, 8), (8, 8)]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_plain_search(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.randint(1, 60) for _ in range(400)])
    into, offset = residual_packing.best_fit_decreasing(sizes, 64)
    room, at = [], {}
    for n in sorted(sizes.tolist(), reverse=True):
        fits = [b for b in range(len(room)) if room[b] >= n]
        if fits:
            room[min(fits, key=lambda b: room[b])] -= n
        else:
            room.append(64 - n)
    assert into.max() + 1 == len(room)
    for i in np.lexsort((offset, into)):
        assert at.get(into[i], 0) == offset[i]
        at[into[i]] = offset[i] + sizes[i]
    assert max(at.values()) <= 64 and len(residual_packing.best_fit_decreasing(sizes[:0], 64)[0]) == 0


def test_table_is_packed_whole_and_tightly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    total = sum(len(ids_of(r["text"])) for r in docs.collect())
    assert checked(docs, 2048) <= 1.02 * total / 2048 + 1


def test_levels_merge_what_tasks_leave(spark, monkeypatch):
    """Small buffers, few open bins and small groups: many levels, and still nothing lost."""
    monkeypatch.setattr(residual_packing, "GROUP_BINS", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "green", "blue"]) for _ in range(rng.randrange(40))) for _ in range(900)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(24)
    total = sum(len(ids_of(t)) for t in texts)
    assert checked(docs, 64) <= 1.15 * total / 64


def test_underfull_bins_of_all_tasks_meet(spark):
    bins = spark.createDataFrame([((part << 32) + k, 30 if k else 34) for part in range(40) for k in range(3)], "bin long, size long")
    placed = residual_packing.merge_underfull(bins, 64).collect()
    assert len(placed) == 120 and len({r["into"] for r in placed}) == 60
    assert len({(r["into"], r["base"]) for r in placed}) == 120


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None), (1, "", None, "s", 3), (2, "twice", "en", "s", 1), (2, "twice", "en", "s", 1), (None, "no id", "en", "s", 1), (3, "日本語 " * 400, "ja", "s", 1), (4, "long " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert checked(docs, 128) >= 70
    clash = docs.withColumnsRenamed({"lang": "bin", "source": "size", "n_chars": "row"})
    assert checked(clash, 2048) >= 5
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert checked(named, 2048) >= 5
    assert residual_packing.pack_documents(spark.createDataFrame([], SCHEMA), BYTE, 0).count() == 0
