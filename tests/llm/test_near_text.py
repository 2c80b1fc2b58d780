"""Near copies by five-word Jaccard similarity, against all pairs."""

import random

import numpy as np

import corpus_pipeline
from pointweave.llm import near_text, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def brute_groups(texts):
    """The least index of each text's group, by comparing all pairs of sets of five words."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    names = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((names[i], names[j]))
                names = [low if n == high else n for n in names]
    return names


def edited(words, rng, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def test_pipeline_stage_finds_all_near_copies(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "two words", "Two  words", "other words"]
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 400))]
        texts += [edited(base, rng, n) for n in (0, 0, len(base) // 60, len(base) // 50, len(base) // 45, len(base) // 40, len(base) // 20)]
    names = brute_groups(texts)
    assert len(set(names)) < len(texts) - 30
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, enumerate(texts)), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(names))


def test_stage_equals_all_pairs_on_a_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in given.collect())
    names = brute_groups([t for _, t in rows])
    kept = near_text.keep_representatives(given)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(rows[n][0] for n in set(names))
    assert kept.columns == given.columns


def test_a_band_of_unlike_sets_is_compared_whole(spark):
    """Chains: the least set of a band need not be like the others that share it."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = [edited(base, rng, n) for n in (6, 7, 8, 9, 10, 11, 12, 13) for _ in range(6)]
    kept = near_text.keep_representatives(docs(spark, enumerate(texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(texts)))


def test_a_crowded_band_in_cells_loses_no_link(spark, monkeypatch):
    """Copies with edits of a tenth of the words: pairs lie on both sides of the threshold, in bands of hundreds."""
    monkeypatch.setattr(near_text, "CELL", 9)
    rng = random.Random(19)
    base = [f"w{i}" for i in range(200)]
    texts = [edited(base, rng, rng.randrange(1, 9)) for _ in range(150)]
    texts += [" ".join(base[:120]) + " " + " ".join(f"own{k}x{i}" for i in range(40)) for k in range(60)]
    kept = near_text.keep_representatives(docs(spark, enumerate(texts)).repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(texts)))


def test_names_of_columns_are_the_tables_own(spark):
    frame = docs(spark, [(1, "one two"), (2, "One  two"), (3, "three")]).withColumn("__row", near_text.F.lit(5)).withColumn("row", near_text.F.lit(6)).withColumn("root", near_text.F.lit(7))
    kept = near_text.keep_representatives(frame)
    assert kept.columns == frame.columns and sorted((r["doc_id"], r["__row"], r["row"], r["root"]) for r in kept.collect()) == [(1, 5, 6, 7), (3, 5, 6, 7)]


def test_words_are_hashed_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(near_text, "PIECE_BYTES", 16)
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "É", "é", "日本", "x" * 40, "one", "One"]
    texts = [None, "", " \n\x0b", *(rng.choice([" ", "\t", " \r\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)), "end\u00a0joined"]
    found, at = near_text.word_hashes(texts)
    seen = {}
    for text, a, b in zip(texts, at, at[1:]):
        own = near_text.re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(near_text.LOWER))
        assert len(own) == b - a
        for word, value in zip(own, found[a:b].tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen) and at[-1] == len(found)


def test_distinct_words_have_distinct_hashes():
    words = [f"{i:x}" for i in range(200_000)]
    found, _ = near_text.word_hashes([" ".join(words)])
    assert len(np.unique(found)) == len(words)


def test_unlike_rows_of_one_id_stay(spark):
    rows = [(5, "first text of some words here"), (5, "quite another text with other words"), (None, "no id and this text"), (None, "no id but something else"), (None, "no id and this text")]
    kept = near_text.keep_representatives(docs(spark, rows).withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "set"))
    assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in rows}) and kept.columns == ["doc_id", "text", "set", "source", "size"]
    assert near_text.keep_representatives(docs(spark, [])).count() == 0


def test_pipeline_stage_links_by_fingerprints_too(spark):
    """Texts of one repeated line and other ends: fingerprints link them, sets of five words do not; groups hold across both kinds of links."""
    rng = random.Random(23)
    line = " ".join(f"w{i}" for i in range(11))
    ends = [" ".join(f"e{k}x{i}" for i in range(10)) for k in range(4)]
    texts = [f"{line} " * 300 + e for e in ends]
    texts.append(f"{line} " * 2 + ends[0])  # the first text's set, whatever its fingerprint
    texts += [" ".join(f"u{rng.getrandbits(30)}" for _ in range(60)) for _ in range(5)] + [None, ""]
    names, prints = brute_groups(texts), [simhash.fingerprint(t) for t in texts]
    apart = len(set(names))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE:
                low, high = sorted((names[i], names[j]))
                names = [low if n == high else n for n in names]
    assert len(set(names[:4])) == 1 and len(set(names)) < apart
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, enumerate(texts)), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(names))
