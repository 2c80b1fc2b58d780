"""Phrases against plain counting of all runs of words."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from pointweave.llm import phrases, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, top=2000, cover=100):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    covered = {(k[0], *k[1 + i : 1 + i + m]) for k in candidates for m in range(2, len(k) - 1) for i in range(len(k) - m) if 100 * candidates[k] >= cover * f[(k[0], *k[1 + i : 1 + i + m])]}
    found = collections.defaultdict(list)
    for k, a in candidates.items():
        if k not in covered:
            lang, w = k[0], k[1:]
            score, _, l, r = min((1000 * a * n[lang] // (f[(lang, *w[:c])] * f[(lang, *w[c:])]), c, f[(lang, *w[:c])], f[(lang, *w[c:])]) for c in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, own in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def mined(docs, *args, **kwargs):
    return sorted(tuple(r) for r in phrases.collocations(docs, *args, **kwargs).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, "s", 1) for i, (lang, text) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "The", "of", "new", "york", "city", "a", "é", "日本", " ", "zebra", "x" * 50]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!", "\x0b"]
    texts = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(120)))) for _ in range(60)]
    return [*texts, *texts[:7], ("en", None), (None, ""), ("en", " .\n, "), ("", "empty name of a language " * 9), ("en", "new york city of the " * 700)]


def test_equals_plain_counts(spark, rows):
    for least, top, cover in ((2, 2000, 100), (6, 5, 60), (30, 3, 100)):
        assert mined(table(spark, rows), least, top, cover=cover) == brute(rows, least, top, cover)


def test_shards_stretches_and_full_maps_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_BYTES", 40)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    monkeypatch.setattr(phrases, "BITS", 32)
    short = rows[:30] + rows[-5:-1]
    raw = "\n".join(t for _, t in short if t).encode()
    assert len(list(phrases.stretches(raw))) > 20
    shard = phrases.Shard(1, 5, None, None)
    got = collections.Counter()
    for lang, text in short:
        for _ in shard.add(lang or "und", (text or "").encode()):
            for b in shard.rows():
                got.update({(r["lang"], r["phrase"]): r["f"] for r in b.to_pylist()})
    for b in shard.rows():
        for r in b.to_pylist():
            got[r["lang"], r["phrase"]] += r["f"]
    want = collections.Counter()
    for lang, text in short:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert got == want


def test_levels_are_sorted_tries():
    shard = phrases.Shard(1, 3, None, None)
    list(shard.add("en", b"b a b a. a b c"))
    by_depth = [(d, [" ".join(shard.sorted_names[w] for w in p) for p in rows], counts.tolist()) for d, _, rows, counts in shard.levels()]
    assert by_depth == [(1, ["a", "b", "c"], [3, 3, 1]), (2, ["a b", "b a", "b c"], [2, 2, 1]), (3, ["a b a", "a b c", "b a b"], [1, 1, 1])]


def test_map_has_no_false_misses():
    held = np.zeros(phrases.BITS // 32, "<u4")
    names = [("en", f"w{i} x{i % 7}") for i in range(300)]
    for lang, phrase in names:
        place = phrases.phrase_hash(lang, phrase.split(" ")) % phrases.BITS
        held[place >> 5] |= np.uint32(1 << (place & 31))
    hashes = np.array([phrases.phrase_hash(lang, p.split(" ")) for lang, p in names], np.uint64)
    assert phrases._in_map(held.view(np.uint8), hashes).all()
    others = np.array([phrases.phrase_hash("de", p.split(" ")) for _, p in names], np.uint64)
    assert phrases._in_map(held.view(np.uint8), others).sum() < 3


def test_no_rows_and_clashing_names(spark, rows):
    assert mined(table(spark, []).select("doc_id", "text", "lang")) == [] and mined(table(spark, rows[:3])) == []
    clash = table(spark, rows).withColumnsRenamed({"doc_id": "f", "source": "phrase", "n_chars": "depth"}).withColumn("lefts", phrases.F.lit(1))
    assert mined(clash, 20) == brute(rows, 20)


def test_sql_twin(spark, sf):
    docs = f"{sf.removesuffix('0.001')}0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{docs}/documents.parquet'")
    twin = con.sql(registry.PHRASES_SQL)
    found = registry.op13_phrases(spark, docs)
    assert twin.columns == found.columns and sorted(twin.fetchall()) == sorted(tuple(r) for r in found.collect())
