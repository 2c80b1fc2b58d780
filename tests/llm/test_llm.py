"""The ten operators against brute force, exact round trips and edge cases."""

import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pointweave.llm import components, encoding, html_text, impact_search, mixing, packing, quality, registry, sharding, simhash, storage, token_counts, token_files, transport_stream

from .test_near_text import brute_groups

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "a  b", " lead", "trail ", "x<|endoftext|> y<|startoftext|>", "don't 'S we'll", "日本語 テキスト", "é ́a ﬁ Straße İ ΑΣ", "tab\tb\r\nc", "🙂 ok", "½ x² 1,234.5", "नमस्ते दुनिया", "​ x ​", "a" * 300]


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta,", "gamma.\n", "Delta"]) for _ in range(60_000))
    rows = [(i, t, "en", "b", 1) for i, t in enumerate(ODD)] + [(100, long, None, None, None), (101, None, None, "a", None), (None, "no id here", "en", "b", 3), (102, "same row twice", "en", "a", 1), (102, "same row twice", "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, text):
    return np.array([*encoding.encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_segments_encode_like_whole_texts(path, small):
    coder, rng = encoding.encoder(path), random.Random(0)
    alphabet = " \n\t'aAé.,!ßİ1²́中<|>s"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [r["text"] for r in small.limit(60).collect()]
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    offsets, ids = coder.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert [coder.encode(t).tolist() for t in texts[:40]] == want[:40] and coder.encode(None).tolist() == []
    assert coder.count_batch(texts).tolist() == list(map(len, want))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_texts_are_cut_without_a_trace(path, small, monkeypatch):
    monkeypatch.setattr(encoding.cut_long, "__defaults__", (64,))
    monkeypatch.setattr(encoding, "SLICE_BYTES", 64)
    monkeypatch.setattr(encoding.slices, "__defaults__", (64,))
    coder = encoding.SegmentEncoder(path)
    texts = ODD + [" ".join(ODD), "x" * 500, "日本" * 100] + [r["text"] for r in small.limit(10).collect()]
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    offsets, ids = coder.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert coder.count_batch(texts).tolist() == list(map(len, want))


def test_batches_are_balanced_by_bytes():
    batches = list(encoding.balanced(["日本" * 20] * 9 + ["a" * 120] * 9, 300))
    assert all(len(b) == 1 or sum(len(x.encode()) for x in b) <= 300 for b in batches) and sum(map(len, batches)) == 18 and max(map(len, batches)) == 2


def test_piece_counts_of_whole_texts(small, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(token_counts, "PART_CHARS", 50)
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path)
    texts = [*ODD, None, *(r["text"] for r in small.limit(40).collect())]
    assert counter.splits and counter.count_batch(texts).tolist() == [len(model.encode(t or "")) for t in texts]


def test_memory_of_the_encoder_is_bounded():
    coder = encoding.SegmentEncoder(BYTE, max_segments=50)
    for k in range(40):
        text = " ".join(f"w{k}x{i}" for i in range(20)) + " common words stay"
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text).ids
        coder.count_batch([text])
    assert all(len(memo.codes) <= 150 and memo.n <= 150 for memo in (coder.known, coder.counted)) and "common" in coder.known.codes


def test_token_counts(odd, empty):
    got = token_counts.count_tokens(odd, BYTE, limit=5).collect()
    want = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert len(got) == odd.count() and len(want) == odd.count() - 1
    expected = sorted((len((t or "").encode()), len(ids_of(BYTE, t)) - 1) for t in [r["text"] for r in odd.collect()])
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == expected and all(r["over_limit"] == (r["n_tokens"] > 5) for r in got)
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(odd.limit(3), pieces).count() == 3


def test_token_files_round_trip(spark, odd, empty):
    manifest = token_files.write_token_files(odd, storage.new_path(spark, "t"), BYTE, 2, sequence=64)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()]
    want = [ids_of(BYTE, t) for _, _, t in sorted(keys)]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [w.tolist() for w in want]
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    row = next(r for r in manifest.collect() if r["n_tokens"] > 1000)
    file = token_files.TokenFile(row["tokens_file"])
    stream = file.ids(0, row["n_tokens"])
    assert (file.sequence(5) == stream[5 * 64 : 6 * 64]).all() and file.length == 64
    last = file.reader.get_batch(file.reader.num_record_batches - 1).column("mask").values.to_numpy(zero_copy_only=False)
    assert (~last).sum() == -row["n_tokens"] % 64
    assert token_files.read_token_files(token_files.write_token_files(empty, storage.new_path(spark, "t"), BYTE, 2)).count() == 0


def check_packing(pieces, texts, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert 0 < p["length"] and len(p["ids"]) == 4 * p["length"]
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for held in by_sequence.values():
        held.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in held] == np.cumsum([0, *(p["length"] for p in held)])[:-1].tolist()
        size = sum(p["length"] for p in held)
        assert size <= capacity
        padding += capacity - size if size & (size - 1) else 0
    for key, wanted in texts.items():
        found = b"".join(p["ids"] for p in sorted(by_doc[key], key=lambda p: p["start"]))
        assert sorted([found[i : i + 4] for i in range(0, len(found), 4)]) == sorted(x.tobytes() for w in wanted for x in w)
        if len(wanted) == 1:
            assert found == wanted[0].tobytes() and all(p["doc_tokens"] == len(wanted[0]) for p in by_doc[key])
    return padding


@pytest.mark.parametrize("capacity,windows", [(4096, 64), (64, 3)])
def test_packing(odd, empty, capacity, windows):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(ids_of(WORD, r["text"]))
    pieces = packing.pack_documents(odd.repartition(3), WORD, 2, capacity, windows).collect()
    padding = check_packing(pieces, texts, capacity)
    assert padding < 0.05 * sum(len(w) for x in texts.values() for w in x)
    assert packing.pack_documents(empty, WORD, 2).count() == 0


def test_packer_is_best_fit_and_emits_the_fullest():
    left = []
    packer = packing.WindowPacker(10, 2, left.append)
    for item, size in (("a", 6), ("b", 7), ("c", 3), ("d", 8), ("e", 5)):
        packer.place(item, size)
    # c fills b's window; d and e find no room, so the fullest window leaves each time.
    assert left == [["b", "c"], ["d"]] and packer.leftovers() == [["a"], ["e"]]
    assert packing.powers(2575) == [2048, 512, 8, 4, 2, 1]


def test_transport_stream_round_trip(odd, empty):
    rng = random.Random(5)
    for n in (0, 1, 575, 576, 577, 20_000):
        payload = transport_stream.padded(rng.randbytes(n))
        media = transport_stream.mux(payload)
        (stream,) = transport_stream.demux(media)
        assert stream.payload == payload and stream.continuity_errors == 0 and len(media) % 188 == 0
        assert stream.pts.tolist() == [3600 * (k + 1) for k in range(len(payload) // 576)] and stream.random_access.all()
    lost = media[: 188 * 20] + media[188 * 21 :]
    (stream,) = transport_stream.demux(lost)
    # Packet 20 belongs to access unit 4, as two packets of tables come first.
    assert stream.continuity_errors == 1 and np.flatnonzero(stream.broken).tolist() == [4]
    assert len(payload) - len(stream.payload) == 184 and stream.payload.endswith(payload[5 * 576 :])
    for broken in (b"", media[:-1], b"\0" + media[1:], media[:20] + b"\0" + media[21:]):
        with pytest.raises(ValueError):
            transport_stream.demux(broken)
    got = transport_stream.load(transport_stream.store(odd)).collect()
    want = sorted(transport_stream.padded((r["text"] or "").encode()) for r in odd.collect())
    assert sorted(bytes(r["payload"]) for r in got) == want and transport_stream.store(empty).count() == 0


def packet(pid, counter, payload, start=False, field=b"", flags=0):
    """A packet made by hand: its payload, with an adaptation field of stuffing where it does not fill the packet."""
    head = bytes([0x47, flags | (0x40 if start else 0) | pid >> 8, pid & 0xFF])
    room = 184 - len(payload)
    if not room and not field:
        return head + bytes([0x10 | counter]) + payload
    inner = (field or (b"\0" if room > 1 else b"")).ljust(room - 1, b"\xff")
    return head + bytes([0x30 | counter, len(inner)]) + inner + payload


def section(table, number, body, at=0, last=0):
    head = bytes([table, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + bytes([0xC1, at, last])
    return head + body + transport_stream.crc_mpeg(head + body).to_bytes(4, "big")


def hand_made():
    """Two programs; the second one's map runs over two packets.  Streams 0x101 and 0x201."""
    pat = section(0, 1, (1).to_bytes(2, "big") + b"\xe0\x30" + (2).to_bytes(2, "big") + b"\xe0\x40")
    one = section(2, 1, b"\xe1\x01\xf0\x00" + b"\x06\xe1\x01\xf0\x00")
    extra = b"\x05" + bytes([190]) + b"x" * 190
    two = section(2, 2, b"\xe2\x01\xf0" + bytes([len(extra)]) + extra + b"\x06\xe2\x01\xf0\x00")
    return packet(0, 0, b"\0" + pat, True) + packet(0x30, 3, b"\0" + one, True) + packet(0x40, 7, b"\0" + two[:183], True) + packet(0x40, 8, two[183:])


def pes(data, pts=None):
    stamp = b"" if pts is None else bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])
    return b"\0\0\1\xbd" + (3 + len(stamp) + len(data)).to_bytes(2, "big") + bytes([0x80, 0x80 if stamp else 0, len(stamp)]) + stamp + data


def test_hand_made_streams():
    a, b = pes(b"A" * 300, 12345), pes(b"B" * 100)
    first = [packet(0x101, 14, a[:184], True), packet(0x101, 15, a[184:])]
    tail = packet(0x101, 0, b, True, field=b"\x40")
    other = packet(0x201, 5, pes(b"other", 1 << 32), True)
    one, two = transport_stream.demux(hand_made() + first[0] + other + first[1] + tail)
    assert (one.payload, one.pts.tolist(), one.random_access.tolist(), one.broken.tolist(), one.continuity_errors) == (b"A" * 300 + b"B" * 100, [12345, -1], [False, True], [False, False], 0)
    assert (two.payload, two.pts.tolist(), two.packet.tolist()) == (b"other", [1 << 32], [5])
    assert one.packet.tolist() == [4, 7]

    # A packet may come twice, not thrice; a discontinuity may be announced; a packet may be marked as wrong.
    def read(*packets):
        found = transport_stream.demux(hand_made() + b"".join(packets))[0]
        return found.payload, found.broken.tolist(), found.continuity_errors

    whole = b"A" * 300 + b"B" * 100
    assert read(first[0], first[0], first[1], tail) == (whole, [False, False], 0)
    assert read(first[0], first[0], first[0], first[1], tail)[1:] == ([True, False], 1)
    jump = packet(0x101, 9, b, True, field=b"\x80")
    assert read(*first, jump) == (whole, [False, False], 0)
    assert read(*first, packet(0x101, 9, b, True)) == (whole, [True, False], 1)
    wrong = packet(0x101, 15, a[184:], flags=0x80)
    assert read(first[0], wrong, tail) == (b"A" * (184 - 14) + b"B" * 100, [True, False], 1)
    assert read(first[0], tail) == (b"A" * (184 - 14) + b"B" * 100, [True, False], 1)
    assert read(packet(0x101, 0, b"no start code" * 10, True), packet(0x101, 1, b, True)) == (b"B" * 100, [True, False], 0)


def test_media_that_cannot_be_read(spark):
    no_stream = packet(0, 0, b"\0" + section(0, 1, b""), True)
    rows = [(1, None), (2, b""), (3, b"x" * 188), (4, no_stream), (None, transport_stream.mux(b"z" * 576))]
    frame = spark.createDataFrame([(i, 0, m, "extra") for i, m in rows], "id long, n_bytes long, media binary, problem string")
    got = {r["id"]: r for r in transport_stream.load(frame).collect()}
    assert [got[i]["problem"] for i in (1, 2, 3, 4)] == ["no media", "not a whole number of packets", "sync byte missing", "no elementary stream"]
    assert got[1]["payload"] is None and bytes(got[None]["payload"]) == b"z" * 576 and got[None]["sample_sum"] == 576 * 122 and got[None]["sample_energy"] == 576 * 122**2
    assert transport_stream.load(frame.where("false")).count() == 0
    assert list(transport_stream.byte_slices([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]


def test_known_checksum_of_the_tables():
    # The check value of CRC-32/MPEG-2.
    assert transport_stream.crc_mpeg(b"123456789") == 0x0376E6E7


PAGES = [
    ("<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>Head &amp; tail</h1><p>One <b>two</b>\n  three<br>four<p>five &lt;six&gt;</article><footer>&copy; all</footer>", "Head & tail One two three four five <six>"),
    ("<body><div id=sidebar><p>side text that is quite long indeed, longer than anything</p></div><div><p>" + "body " * 50 + "</p><p>end.</p></div><div class=comments><p>first!</p></div></body>", "body " * 50 + "end."),
    ("<p>caf&eacute;&nbsp;au<!-- x --> lait", "café au lait"),
    ("<article>a<div class='advert'>no</div>b<form>c</form></article>d", "a b"),
    ("", ""),
    (None, ""),
    ("<nav>only menus</nav>", ""),
    ("plain text", "plain text"),
    ("<p>unclosed <a href='x>y'>quote</a", "unclosed quote"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_html_text(page, text):
    assert html_text.main_text(page) == text


def test_html_text_of_a_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract_main_text(pages).collect():
        body = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?(p|h1|br)>", " ", body).replace("<b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>" + "long " * 100_000, "y"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html_text.extract_main_text(odd).collect()) == [0, 0, 499_999]


def brute_simhash(texts):
    prints = [simhash.fingerprint(t) for t in texts]
    names = list(range(len(texts)))

    def find(x):
        while names[x] != x:
            x = names[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                names[b] = a
    return prints, [find(i) for i in range(len(texts))]


def test_fingerprint_by_hand():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d", "c d É")]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) > 1.5)
    assert simhash.fingerprint(" A b\tC  d\nÉ") == want
    assert simhash.fingerprint("Two WORDS") == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates(spark, small, empty):
    base = [r["text"] for r in small.orderBy("doc_id").collect()]
    texts = base + [None, "", " "] + [base[5] + " x", base[6].upper(), base[6]]
    prints, names = brute_simhash(texts)
    got = sorted(map(tuple, simhash.near_duplicates(docs(spark, texts)).collect()))
    assert [g[1] & (1 << 64) - 1 for g in got] == prints and [g[2] for g in got] == names
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_representatives(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(names)) and kept.columns == empty.columns


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for n in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << k for k in rng.sample(range(64), n)))
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {tuple(sorted(map(int, r))) for r in simhash.links(frame).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 1049)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[2000] == 1000 and got[1030] == 1000 and len(got) == 61 + 51
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def water_fill(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, free, total = {}, set(order), sum(sizes.values())
    while True:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > most * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / w for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
            free.remove(s)


def check_mix(frame, tolerance=0.02):
    rows = frame.collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        assert r["size"] == len(simhash.WORD.findall((r["row"]["text"] or "").encode()))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["source"] == r["row"]["source"]
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
        assert abs(taken[s] - want[s]) <= max(2, tolerance * want[s])
    return rows


def test_mixing(spark, small, odd, empty):
    check_mix(mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), 0.005)
    rows = check_mix(mixing.mix(small), 0.1)
    again = mixing.mix(small.repartition(5)).collect()
    assert sorted((r["row"]["doc_id"], r["copies"]) for r in rows) == sorted((r["row"]["doc_id"], r["copies"]) for r in again)
    # Rates are an exponential tilt of the size within a source, up to the cap.
    for s in {r["source"] for r in rows}:
        free = [(r["size"], math.log(r["rate"])) for r in rows if r["source"] == s and r["size"] and 1e-300 < r["rate"] < 2.999]
        slopes = [y / x for x, y in free]
        assert not slopes or max(slopes) - min(slopes) < 1e-9 + 1e-6 * abs(max(slopes))
    assert len(mixing.mix(odd).collect()) == odd.count()
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_rows(small)
    assert mixed.columns == small.columns and mixed.count() == sum(r["copies"] for r in rows)


def brute_tilt(sizes, target, most=3):
    """The tilt at which the sum of size * min(most, exp(tilt * size / mean)) is the target, by halving."""
    mean = sum(sizes) / len(sizes)
    taken = lambda t: sum(x * min(most, math.exp(max(-700.0, min(700.0, t * x / mean)))) for x in sizes)
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if taken(middle) < target else (low, middle)
    return low, mean


def test_mixing_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["w " * rng.choice([1, 2, 3, 5, 8, 40, 300]) for _ in range(400)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    rows = mixing.mix(docs(spark, texts, sources)).collect()
    for s in {"a", "b", "c", None}:
        own = [r for r in rows if r["source"] == s]
        if own[0]["target"] < 3 * own[0]["source_size"] * (1 - 1e-9):
            tilt, mean = brute_tilt([r["size"] for r in own], own[0]["target"])
            assert all(r["rate"] == pytest.approx(min(3, math.exp(tilt * r["size"] / mean)), rel=1e-6) for r in own)
            assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"])
        # Rounding moves a source by half its largest document at most, before corrections lessen that.
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
    clashing = docs(spark, texts, sources).withColumns({"size": F.lit("x"), "h": F.lit(0), "key": F.lit(1), "copies": F.lit(2), "n": F.lit(3)})
    again = mixing.mix(clashing).collect()
    assert sorted((r["row"]["doc_id"], r["copies"]) for r in again) == sorted((r["row"]["doc_id"], r["copies"]) for r in rows)


def test_mixing_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_SALT", 50)
    texts = ["one two three"] * 700 + ["a b"] * 30 + ["a b c d e f"] * 300
    frame = docs(spark, texts, ["x"] * 500 + ["y"] * 530)
    rows = check_mix(mixing.mix(frame), 0.01)
    assert all(max(c) - min(c) <= 1 for s in ("x", "y") for n in (2, 3, 6) if (c := [r["copies"] for r in rows if (r["source"], r["size"]) == (s, n)]))


def test_mixing_of_one_size(spark):
    texts = ["one two three"] * 2000 + ["a b c d"] * 1000 + [None, ""]
    frame = mixing.mix(docs(spark, texts, ["x"] * 2000 + ["y"] * 500 + [None] * 500 + ["x", None]))
    check_mix(frame, 0.01)
    assert all(r["size"] == 0 and r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(docs(spark, [None, ""])).collect())


def test_quality(spark, sf, small, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["row"]["doc_id"]: r for r in quality.importance_sample(small, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [got[i]["selected"] == (q == 1) for i, q in truth.items()]
    assert sum(right) / len(right) > 0.97
    k = sum(r["selected"] for r in got.values())
    assert {i for i, r in got.items() if r["selected"]} == set(sorted(got, key=lambda i: -got[i]["gumbel_key"])[:k])
    assert quality.importance_sample(empty, labels).count() == 0
    nobody = labels.where("false")
    assert quality.importance_sample(small, nobody).where("selected").count() == small.count()


def test_quality_on_held_out_labels(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r["row"]["doc_id"]: r["selected"] for r in quality.importance_sample(docs_, seen).collect()}
    right = [got[i] == (q == 1) for i, q in held.items()]
    assert sum(right) / len(right) > 0.97


def test_quality_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(0, 0, 0), (3, 1, 0), (None, 1, 0), (4, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.importance_sample(odd, labels, k=4).where("selected").collect()) == 4
    assert quality.shape("Hello,WORLD!!") == "Aa,A!!" and quality.shape("a----b99") == "a-a0"
    clashing = odd.withColumns({"label_id": F.lit("x"), "good": F.lit(1), "log_weight": F.lit("y"), "row": F.lit(0)})
    assert len(quality.importance_sample(clashing, labels, k=4).where("selected").select("row.*").collect()) == 4


def test_quality_draws_all_that_tie_at_the_last_place(spark):
    rows = docs(spark, ["same text"] * 3 + ["another one"]).withColumn("doc_id", F.when(F.col("doc_id") < 3, 7).otherwise(F.col("doc_id")))
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    drawn = [r["row"]["doc_id"] for r in quality.importance_sample(rows, labels, k=2).where("selected").collect()]
    assert drawn.count(7) in (0, 3) and len(drawn) >= 2


def brute_ngrams(text):
    """All buckets of a text, one at a time."""
    import xxhash

    full = (1 << 64) - 1
    m = [int(x) for x in quality._MIX]

    def bucket(a, b, kind):
        h = (a * m[0] + b * m[1] + kind * m[2]) & full
        h ^= h >> 29
        return (h * m[1] & full) >> 48

    words = (text or "").split()
    lexical = [xxhash.xxh32_intdigest(w.lower()) for w in words]
    form = [xxhash.xxh32_intdigest(quality.shape(w)) for w in words]
    form = [f + ((1 << 32) if i and lexical[i] == lexical[i - 1] else 0) for i, f in enumerate(form)]
    out = []
    for kind, x in ((0, lexical), (2, form)):
        out += [bucket(a, 0, kind) for a in x]
        ends = [1 << 33, *x, 1 << 34]
        out += [bucket(a, b, kind + 1) for a, b in zip(ends, ends[1:])]
    return out


def test_quality_against_brute_force(spark, sf, small):
    rows, labels = small.orderBy("doc_id").collect(), spark.read.parquet(f"{sf}/labels.parquet")
    sample = {r["label_id"]: r for r in quality.label_sample(labels).collect()}
    texts = [r["text"] for r in rows]
    found, owner = quality.ngrams([*texts, None, "", "  one  "])
    split = [sorted(found[owner == i].tolist()) for i in range(len(texts) + 3)]
    assert split == [sorted(brute_ngrams(t)) for t in [*texts, None, "", "  one  "]]
    raw, target = {}, {}
    for r in rows:
        for b in brute_ngrams(r["text"]):
            raw[b] = raw.get(b, 0) + 1
            if (s := sample.get(r["doc_id"])) and s["good"] and not s["held"]:
                target[b] = target.get(b, 0) + 1
    chance = lambda counts, b: (counts.get(b, 0) + 0.5) / (sum(counts.values()) + 0.5 * quality.BUCKETS)
    ratio = {b: math.log(chance(target, b) / chance(raw, b)) for b in raw}
    got = {r["row"]["doc_id"]: r for r in quality.importance_sample(small, labels).collect()}
    noise = {r["doc_id"]: r["g"] for r in small.select("doc_id", quality.gumbel(F.col("doc_id"), F.col("text")).alias("g")).collect()}
    for r in rows:
        grams = brute_ngrams(r["text"])
        weight = 40 * sum(ratio[b] for b in grams) / (len(grams) + 6)
        assert got[r["doc_id"]]["log_weight"] == pytest.approx(weight) and got[r["doc_id"]]["gumbel_key"] == pytest.approx(weight + noise[r["doc_id"]])
    weights = np.exp([r["log_weight"] for r in got.values()])
    frame = spark.createDataFrame([(float(r["log_weight"]),) for r in got.values()], "log_weight double")
    assert quality.effective_sample_size(frame) == pytest.approx(weights.sum() ** 2 / (weights**2).sum())
    assert any(s["held"] for s in sample.values()) and not all(s["held"] for s in sample.values())


@pytest.mark.parametrize("n,k", [(1, 1), (1000, 1), (1000, 777), (1000, 1000), (50_000, 31_234)])
def test_kth_largest(spark, n, k):
    keys = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(n // 2 + 1)) / 7.0).alias("key"))
    assert quality.kth_largest(keys, k) == sorted((r["key"] for r in keys.collect()), reverse=True)[k - 1]


def brute_search(rows, k=20):
    """(query, rank, id, score) of rows (id, quantised vector), by every pair."""
    out = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        asked = {v for i, v in rows if i == q}
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for v in asked for i, w in rows if i != q and len(v) == len(w))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def test_impact_search_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.2, (300, 64)).astype(np.float32)
    vectors[100:160] = vectors[7]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1001, vectors[7].tolist())] * 30 + [(20, rows[20][1]), (40, rows[5][1])]  # a hot id, a query twice, a query with two vectors
    rows += [(2000 + 10 * i, [0.5 * i, 1.0, -1.0]) for i in range(5)] + [(3000, [])]
    left_out = [(1000, None), (1020, [None] * 64), (1040, [math.nan] * 64), (1060, [math.inf] * 64), (None, [0.1] * 64)]
    frame = spark.createDataFrame(rows + left_out, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(1), "asks": F.lit(0), "n": F.lit("y")})
    got = sorted(map(tuple, impact_search.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    whole = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v]
    assert got == brute_search(whole)


def test_impact_search_of_few_and_large(spark):
    frame = spark.createDataFrame([(0, [3e7, 1.0]), (1, [2e7, -5.0]), (2, [-1.0, 1e3])], "vec_id long, embedding array<double>")
    got = impact_search.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 64 * 64 * (3 * 2 * 10**14 - 5)), (2, 64 * 64 * (1000 - 3 * 10**7))]
    assert impact_search.top_k(frame.where("false"), F.col("vec_id") == 0).count() == 0


def test_segments_hold_every_posting_by_impact():
    block = np.array([[0, 5, -9], [1, -1, 4]])
    segments = impact_search.build_segments(block)
    assert [sorted(zip(s.vector.tolist(), s.dimension.tolist(), s.value.tolist())) for s in segments] == [[(0, 2, -9)], [(0, 1, 5), (1, 2, 4)], [(1, 0, 1), (1, 1, -1)]]
    assert segments[0].next_norm.tolist() == [5, pytest.approx(18**0.5)] and segments[-1].next_norm.tolist() == [0, 0]


def test_stopping_early_keeps_the_answer():
    rng = np.random.default_rng(9)
    block = np.floor(64 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    block[:300] = block[300:600] + rng.integers(-2, 3, (300, 64))
    ids, work = np.arange(3000), impact_search.Work()
    for (found, scores), i in zip(impact_search.search_block(block[:50], ids[:50], block, ids, 5, work), range(50)):
        s = block @ block[i]
        want = sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:5]
        assert found.tolist() == want and scores.tolist() == s[want].tolist()
    assert 0 < work.scored < 0.9 * work.postings


def skewed_vectors(n):
    """Vectors of a few strong components, with norms over two orders of magnitude."""
    rng = np.random.default_rng(12)
    return (rng.normal(0, 1, (n, 32)) * 0.5 ** np.arange(32) * np.exp(rng.normal(0, 1.5, (n, 1)))).astype(np.float32)


def test_shapes_are_of_whole_words():
    assert quality.shape("Spark4Data") == "Aa0Aa"
    assert quality.shape("a-1." * 10 + "Z") != quality.shape("a-1." * 10 + "9")


def test_skewed_vectors_leave_most_postings_unscored():
    block = np.floor(64 * skewed_vectors(3000).astype(np.float64)).astype(np.int64)
    ids, work = np.arange(3000), impact_search.Work()
    for (found, scores), i in zip(impact_search.search_block(block[:200], ids[:200], block, ids, 20, work), range(200)):
        s = block @ block[i]
        want = sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:20]
        assert found.tolist() == want and scores.tolist() == s[want].tolist()
    assert 0 < work.scored < 0.5 * work.postings


def test_floors_rule_rows_out_before_scoring():
    block = np.array([[3, 4], [6, 8], [1, 0]])
    work = impact_search.Work()
    searched = lambda floor: [f.tolist() for f, _ in impact_search.search_block(np.array([[2, 0]]), np.array([9]), block, np.arange(3), 2, work, floors=np.array([floor]))]
    assert searched(-np.inf) == [[1, 0]]
    before = work.scored
    assert searched(1e6) == [[]] and work.scored == before
    assert searched(12.0)[0][0] == 1


def test_impact_search_over_bands_and_stored_blocks(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(impact_search, "QUERY_ROWS", 8)
    built = []
    rows = [(i, v.tolist()) for i, v in enumerate(skewed_vectors(600))] + [(700 + i, [0.0] * 32) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = impact_search.storage.materialise
    monkeypatch.setattr(impact_search.storage, "materialise", lambda df, name, **o: built.append((name, kept(df, name, **o))) or built[-1][1])
    got = sorted(map(tuple, impact_search.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute_search([(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows])
    index = dict(built)["impact-index"]
    assert index.groupBy("dim", "band", "part", "place").count().where("count > 1").count() == 0
    assert index.agg(F.sum(F.size("ids"))).first()[0] == len(rows)


def test_sharding(spark, odd, empty):
    table = sharding.lookup_table(sharding.SHARDS)
    counts = np.bincount(table)
    assert len(table) == sharding.SLOTS and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer))
    assert moved < 3 * sharding.SLOTS / len(sharding.SHARDS)
    got = sharding.place(odd, "doc_id").collect()
    assert len(got) == odd.count() and len({r["shard"] for r in got if r["doc_id"] == 102}) == 1
    assert sharding.place(empty, "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], slots=8)


def test_native_operators_run_no_python(spark, sf):
    for name in ("op1_mixing", "op9_sharding"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = registry.queries()[name](spark, sf)
    relation = con.sql(registry.oracle_sql()[name])
    order = [relation.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[i] for i in order) for r in relation.fetchall())


def test_digests(spark, sf, small):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in registry.op3_transport_stream(spark, sf).collect():
        payload = transport_stream.padded(texts[r["doc_id"]].encode())
        media = transport_stream.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(texts[r["doc_id"]].encode()), len(payload), len(media))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest(), zlib.crc32(payload[-32:]))
    at = 0
    for r in registry.op2_token_files(spark, sf).orderBy("doc_id").collect():
        ids = ids_of(BYTE, texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for r in registry.op4_packing(spark, sf).collect():
        ids = ids_of(WORD, texts[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)


def test_pipeline(spark, sf):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    state = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        state = storage.materialise(stage(spark, state, sf), f"test-{name}")
        kept[name] = state
    assert all(kept[n].columns == documents.columns for n in ("quality", "near_duplicates", "mixing"))
    good = {r["doc_id"] for r in kept["quality"].collect()}
    rows = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] in good}
    order = sorted(rows)
    names = brute_groups([rows[i] for i in order])
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {order[n] for n in names}
    mixed = kept["mixing"].collect()
    packed = kept["packing"].collect()
    assert sum(r["length"] for r in packed) == sum(len(ids_of(WORD, r["text"])) for r in mixed)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_stages_take_odd_and_empty_tables(spark, sf, odd, empty):
    import corpus_pipeline

    for given in (odd, empty):
        state = given
        for name, stage in corpus_pipeline.STAGES:
            state = storage.materialise(stage(spark, state, sf), f"odd-{name}")
            assert name == "packing" or state.columns == given.columns
        assert given is odd or state.count() == 0
    # All texts of this table are of one kind or blank: near copies go, and blank ones have no words to mix.
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, sf).collect()
    assert len(kept) == len({i for i in brute_groups([r["text"] for r in odd.collect()])})
