"""Phrases whose words go together, mined by count tries of limited depth.

A shard of texts becomes a trie of its word sequences, level by level: a node is
a (parent, word) pair, numbered in the order of the words' bytes, so a level is
sorted as its phrases are.  Tries are written sorted, dealt out by ranges of the
phrase, and equal phrases of all shards merge there.  The count of a left part
stands on the walk to a node; that of a right part hangs on its suffix link, the
node without its first word.

A phrase cannot be frequent unless all its parts are.  Words are counted first,
then pairs of frequent words, then longer runs of frequent pairs.  What is
frequent reaches the shards as a bit map of hashes of fixed size: a hash that two
share lets too much through, which is counted like the rest, and never too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .encoding import text_slices
from .simhash import LOWER, SEED

DEPTH, LEAST, TOP, COVER = 5, 100, 2000, 100
NO_LANG = "und"
#: Bits of a map of hashes; 2 MB, whatever the corpus.
BITS = 1 << 24
#: Words of a shard's trie at most, distinct words that a shard remembers, and bytes that are taken apart at once.
SHARD_WORDS, SHARD_NAMES, PIECE_BYTES = 1 << 21, 1 << 20, 1 << 22

#: The bytes that end a piece, and those that end a word.
ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
GAPS = ENDS | np.isin(np.arange(256), list(b"\x20\x09"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and of that word."""
    return _mixed(before * _MIX + word)


def phrase_hash(lang: str, words: list[str]) -> int:
    h = np.array([xxhash.xxh64_intdigest(lang, SEED)], np.uint64)
    for word in words:
        h = _chain(h, np.array([xxhash.xxh64_intdigest(word, SEED)], np.uint64))
    return int(h[0])


def words_of(raw: bytes) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(words in lower case, whether each begins a piece, where each begins) of UTF-8 bytes."""
    data = np.frombuffer(raw.translate(LOWER), np.uint8)
    gap = GAPS[data]
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    begin, end = edges[::2], edges[1::2]
    ended = np.concatenate([[0], np.cumsum(ENDS[data])])
    opens = np.ones(len(begin), bool)
    opens[1:] = ended[begin[1:]] > ended[end[:-1]]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[~gap].tobytes())), opens, begin


def stretches(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, words at their beginning that were in the stretch before); every run of DEPTH words is whole in one of them."""
    at, carry, carried = 0, b"", 0
    while at < len(raw):
        stop = min(at + PIECE_BYTES, len(raw))
        if stop < len(raw):
            more = np.flatnonzero(GAPS[np.frombuffer(raw, np.uint8, min(1 << 16, len(raw) - stop), stop)])
            while not len(more) and stop < len(raw):
                stop = min(stop + (1 << 16), len(raw))
                more = np.flatnonzero(GAPS[np.frombuffer(raw, np.uint8, min(1 << 16, len(raw) - stop), stop)])
            stop += int(more[0]) + 1 if len(more) else 0
        part = carry + raw[at:stop]
        yield part, carried
        at = stop
        if at < len(raw):
            _, _, begin = words_of(part)
            carried = min(DEPTH - 1, len(begin))
            carry = part[begin[-carried] :] if carried else b""


class Shard:
    """Word sequences of some texts, and the trie of their counts."""

    def __init__(self, first: int, last: int, singles: np.ndarray | None, pairs: np.ndarray | None):
        self.first, self.last, self.singles, self.pairs = first, last, singles, pairs
        self.clear()

    def clear(self) -> None:
        self.names: dict[str, int] = {}
        self.langs: dict[str, int] = {}
        self.hashes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    @property
    def full(self) -> bool:
        return self.n >= SHARD_WORDS or len(self.names) >= SHARD_NAMES

    def add(self, lang: str, raw: bytes) -> Iterator[None]:
        """Take in texts of one language, which line ends part; yields whenever the shard is full and has to be emptied."""
        for part, carried in stretches(raw):
            words, opens, _ = words_of(part)
            if len(words) > carried:
                coded = words.dictionary_encode()
                table = np.fromiter(map(self._name, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
                code = self.langs.setdefault(lang, len(self.langs))
                new = np.arange(len(words)) >= carried
                opens[0] = True
                self.parts.append((np.full(len(words), code, np.int32), table[coded.indices.to_numpy()], opens, new))
                self.n += len(words)
            if self.full:
                yield

    def _name(self, word: str) -> int:
        code = self.names.get(word)
        if code is None:
            code = self.names[word] = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word, SEED))
        return code

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, languages, words of the phrases by row, counts) of the levels asked for, each sorted by language and words."""
        if not self.parts:
            return
        lang, word, opens, new = (np.concatenate(x) for x in zip(*self.parts))
        names = np.array(list(self.names), object)
        order = pa.array(list(self.names), pa.string())
        rank = np.empty(len(names), np.int64)
        by_bytes = pa.compute.array_sort_indices(order).to_numpy()
        rank[by_bytes] = np.arange(len(names))
        word, hashes = rank[word], np.array(self.hashes, np.uint64)[by_bytes]
        self.sorted_names = names[by_bytes]
        lang_hash = np.array([xxhash.xxh64_intdigest(x, SEED) for x in self.langs], np.uint64)
        ends = np.arange(len(word))  # of the runs that are counted, the place of their last word
        here, node, above = lang * np.int64(len(names)) + word, None, None
        apart = np.cumsum(opens)
        starts = np.arange(len(word))
        for depth in range(1, self.last + 1):
            if depth > 1:
                keep = (ends + 1 < len(word)) & (apart[np.minimum(ends + 1, len(word) - 1)] == apart[starts])
                starts, ends, node = starts[keep], ends[keep] + 1, node[keep]
                here = node * np.int64(len(names)) + word[ends]
            if depth == 1 and self.singles is not None:
                single = _chain(lang_hash[lang], hashes[word])
                frequent = _in_map(self.singles, single)
                kept = frequent
            elif depth == 2 and self.singles is not None:
                kept = frequent[ends]
                if self.pairs is not None:
                    pair = np.zeros(len(word), bool)
                    pair[ends] = kept & _in_map(self.pairs, _chain(single[starts], hashes[word[ends]]))
                    kept = pair[ends]
            elif depth > 2 and self.pairs is not None:
                kept = pair[ends]
            else:
                kept = np.ones(len(here), bool)
            starts, ends, here = starts[kept], ends[kept], here[kept]
            keys, node = np.unique(here, return_inverse=True)
            parent, last = keys // len(names), keys % len(names)
            phrases = last[:, None] if above is None else np.concatenate([above[1][parent], last[:, None]], axis=1)
            langs = parent if above is None else above[0][parent]
            above = langs, phrases
            if depth >= self.first:
                counts = np.bincount(node[new[ends]], minlength=len(keys))
                yield depth, langs, phrases, counts

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The trie's phrases in the order of their bytes' words, and the shard is empty again."""
        langs = np.array(list(self.langs), object)
        for depth, lang, phrases, counts in self.levels():
            for at in range(0, len(counts), 1 << 16):
                some = slice(at, at + (1 << 16))
                seen = counts[some] > 0
                columns = [pa.array(self.sorted_names[phrases[some][seen, k]], pa.string()) for k in range(depth)]
                text = pa.compute.binary_join_element_wise(*columns, " ") if depth > 1 else columns[0]
                yield pa.RecordBatch.from_arrays([pa.array(langs[lang[some][seen]], pa.string()), text, pa.array(counts[some][seen], pa.int64())], ["lang", "phrase", "f"])
        self.clear()


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes % np.uint64(BITS)).astype(np.int64)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def _count(first: int, last: int, singles, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(first, last, singles and singles.value, pairs and pairs.value)
        for b in batches:
            langs = b.column(0).to_pylist()
            for begin, end, texts in text_slices(b.column(1)):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(langs[begin:end], texts):
                    if text:
                        by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    for _ in shard.add(lang, "\n".join(own).encode()):
                        yield from shard.rows()
        yield from shard.rows()

    return run


def count_phrases(docs: DataFrame, first: int, last: int, least: int = 1, singles=None, pairs=None) -> DataFrame:
    """(lang, depth, phrase, f) of the runs of first to last words that the maps admit, with f >= least; docs has columns lang and text."""
    spark = docs.sparkSession
    path = storage.new_path(spark, "tries")
    docs.mapInArrow(_count(first, last, singles, pairs), "lang string, phrase string, f bigint").write.parquet(path, compression="zstd")
    tries = spark.read.schema("lang string, phrase string, f bigint").parquet(path)
    merged = tries.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    depth = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).alias("depth")
    return storage.materialise(merged.select("lang", depth, "phrase", "f"), "phrases", spent=[path])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        place = np.array([phrase_hash(lang, phrase.split(" ")) % BITS for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place >> 5), pa.array(np.int64(1) << (place & 31))], ["cell", "bit"])


def bit_map(phrases: DataFrame):
    """A broadcast of the hashes of ``phrases``; BITS / 32 cells reach the driver at most."""
    cells = phrases.select("lang", "phrase").mapInArrow(_places, "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(BITS // 32, "<u4")
    held[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(held.view(np.uint8))


def frequent_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, languages): (lang, depth, phrase, f) of all phrases of at most ``depth`` words with f >= least; (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    words = count_phrases(texts, 1, 1)
    languages = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [words.where(F.col("f") >= least)]
    if depth > 1:
        singles = bit_map(found[0])
        found.append(count_phrases(texts, 2, 2, least, singles))
        if depth > 2:
            found.append(count_phrases(texts, 3, depth, least, singles, bit_map(found[1])))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, languages


def _with_parts(phrases: DataFrame, depth: int) -> DataFrame:
    """Candidates with the counts of their left and right parts, by cut; a level takes those of its parent and its suffix."""
    empty = F.array().cast("array<bigint>")
    level = phrases.where("depth = 1").select("lang", "depth", "phrase", "f", empty.alias("lefts"), empty.alias("rights"))
    out = None
    for d in range(2, depth + 1):
        parent = level.select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("f")).alias("lefts"))
        suffix = level.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rights").alias("rights"))
        own = phrases.where(F.col("depth") == d).withColumn("parent", _parent()).withColumn("suffix", _suffix())
        level = storage.materialise(own.join(parent, ["lang", "parent"]).join(suffix, ["lang", "suffix"]).select("lang", "depth", "phrase", "f", "parent", "suffix", "lefts", "rights"), "phrase-parts")
        out = level if out is None else out.unionByName(level)
    return out


def _parent() -> Column:
    return F.expr("substring_index(phrase, ' ', depth - 1)")


def _suffix() -> Column:
    return F.expr("substring_index(phrase, ' ', 1 - depth)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH, cover: int = COVER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to ``depth`` words.

    a, l and r count the phrase and the parts of its lowest-scoring cut, n all
    words of the language; the score is floor(1000 a n / (l r)).  A phrase that
    lies in a longer one with 100 f >= ``cover`` a of the same language is left
    out.  Products are exact decimals of 38 digits, enough for 10^17 words.

    Cases: a null language is ``und``; null and empty texts, and those of breaks
    alone, have no words; a text of any length is taken in stretches that overlap
    by a phrase; repeated rows and ids count each; other columns are not read,
    whatever their names; an empty table, or one of no frequent phrase, gives an
    empty result.  Ties of the score go to the greater a, then to the lesser phrase.
    """
    phrases, languages = frequent_phrases(docs, least, depth, lang_col, text_col)
    nodes = _with_parts(phrases, depth)
    longer = nodes.select("lang", F.explode(F.array("parent", "suffix")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    wide = nodes.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < cover * F.col("f"))).join(languages, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda x, i: F.struct(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)"), x["lefts"].cast("decimal(19,0)") * x["rights"].cast("decimal(19,0)")).alias("score"), i.alias("k"), x["lefts"].alias("l"), x["rights"].alias("r")))
    scored = wide.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
