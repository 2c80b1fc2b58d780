"""Near copies of texts: word sets of Jaccard similarity 0.8 or more, found by bands of minima.

A text is the set of the hashes of its runs of five words.  Each of 24 bands
holds the least values of four hash functions over the set; two sets at the
threshold share no band with probability (1 - 0.8 ** 4) ** 24, some 3 in a
million, and more similar ones with less.  Pairs that share a band are verified
on the whole sets, so nothing else links.

A band's sets are first compared with one leader alone, the set that meets most
others, so a large group of copies of one text costs a row a copy and band, not
a row a pair.  Sets that this leaves in different components are then compared
with each other, as arrays and in bounded cells, and only if the shingles that
either has in common with other components are enough for a link.

Words are hashed where they stand in the bytes, all of a slice at once: the
difference of two prefix sums of a polynomial, moved to the power zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .components import connected_components
from .encoding import gather, text_slices
from .simhash import LOWER, SEED

SHINGLE = 5
#: Similar at NEAR[0] / NEAR[1] and above.
NEAR = (4, 5)
BANDS, ROWS = 24, 4
AT_ONCE = 512
SLICE_BYTES = 1 << 19
#: Sets of a crowded band that are compared with as many others at once.
CELL = 256
#: Bytes that are hashed at once; a longer word makes a longer piece.
PIECE_BYTES = 1 << 19
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SPACES = re.compile(rb"[\x09-\x0D\x20]")

_RANDOM = np.random.Generator(np.random.PCG64(SEED))
_XOR = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_FACTOR = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PLACES = _RANDOM.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2 ** 64, up to ``n`` of them; those of a usual piece are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        made = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        if n > 2 * PIECE_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's begin, and the end); words are runs of bytes but white space, A-Z in lower case."""
    raw = [(x or "").encode() for x in texts]
    joined = b" ".join(raw).translate(LOWER) + b" "
    out, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        found = SPACES.search(joined, min(at + PIECE_BYTES, len(joined) - 1))
        stop = found.end() if found else len(joined)
        piece = np.frombuffer(joined, np.uint8, stop - at, at)
        power, inverse = _powers(len(piece))
        space = SPACE[piece]
        edges = np.flatnonzero(np.diff(space, prepend=True))  # a piece ends in white space, so edges pair up
        begin, end = edges[::2], edges[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], dtype=np.uint64)])
        out.append(_mixed((sums[end] - sums[begin]) * inverse[begin]))
        starts.append(begin + at)
        at = stop
    ends = np.cumsum([len(x) + 1 for x in raw])
    return np.concatenate(out), np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)])


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of SHINGLE words; of all words if there are fewer, none of none."""
    words, at = word_hashes(texts)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = words[a:b]
        size = min(SHINGLE, len(own))
        if not size:
            yield own
            continue
        runs = sum(own[k : len(own) - size + 1 + k] * _PLACES[k] for k in range(size))
        yield np.unique(_mixed(runs))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band; empty for an empty set, which is a near copy of empty sets alone."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), AT_ONCE):
        np.minimum(least, ((short[at : at + AT_ONCE] ^ _XOR) * _FACTOR).min(1), out=least)
    return ((least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) + _SALT).view(np.int64)


def _key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _describe(batches):
    for b in batches:
        for first, last, texts in text_slices(b.column(1), SLICE_BYTES):
            rows = [(_key(s), len(s), bands(s)) for s in shingle_sets(texts)]
            keys, sizes, lists = zip(*rows)
            columns = [b.column(0).slice(first, last - first), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "set", "size", "bands"])


def _hashes(batches):
    for b in batches:
        for first, last, texts in text_slices(b.column(1), SLICE_BYTES):
            sets = pa.array([s.view(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), sets], ["set", "hashes"])


def _fit(a: str, b: str) -> Column:
    """Whether two sets' sizes allow them to be similar."""
    return NEAR[1] * F.least(a, b) >= NEAR[0] * F.greatest(a, b)


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar, by their whole sets."""
    sizes = sets.select("set", "size", F.col("best.row").alias("row"))
    one, other = sizes.select(F.col("set").alias("a"), F.col("size").alias("na")), sizes.select(F.col("set").alias("b"), F.col("size").alias("nb"))
    able = pairs.join(one, "a").join(other, "b")
    able = storage.materialise(able, "candidate-pairs")
    needed = able.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sizes, "set").select("set", "row")
    held = storage.materialise(texts.join(needed, "row").select("set", "text").mapInArrow(_hashes, "set bigint, hashes array<bigint>"), "candidate-sets")
    both = able.join(held.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b").join(held.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return storage.materialise(both.where((NEAR[0] + NEAR[1]) * common >= NEAR[0] * (F.col("na") + F.col("nb"))).select("a", "b"), "similar-pairs")


def _linked(group: pa.Table) -> pa.Table:
    """Links (a, b) of one cell's sets that make all its similar pairs connected; sets of one root are so already."""
    order = np.argsort(group.column("set").to_numpy(), kind="stable")
    names, root, size, shared, block = (group.column(c).to_numpy()[order] for c in ("set", "root", "size", "shared", "block"))
    hashes = group.column("hashes").combine_chunks().take(pa.array(order))
    flat, ends = hashes.flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(hashes.offsets.to_numpy()))
    starts = np.concatenate([[0], ends[:-1]])
    across = group.column("low")[0] != group.column("high")[0]
    group_of, found = root.copy(), []
    for i in range(len(names) - 1):
        rest = slice(i + 1, len(names))
        most, least = np.maximum(size[rest], size[i]), np.minimum(size[rest], size[i])
        able = (group_of[rest] != group_of[i]) & (NEAR[1] * least >= NEAR[0] * most) & ((NEAR[0] + NEAR[1]) * np.minimum(shared[rest], shared[i]) >= NEAR[0] * (size[rest] + size[i]))
        if across:
            able &= block[rest] != block[i]
        others = i + 1 + np.flatnonzero(able)
        if not len(others):
            continue
        own = flat[starts[i] : ends[i]]
        lengths = ends[others] - starts[others]
        theirs = gather(flat, starts[others], lengths)
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
        for j in others[(NEAR[0] + NEAR[1]) * common >= NEAR[0] * (size[i] + size[others])].tolist():
            if group_of[i] != group_of[j]:
                found.append((names[i], names[j]))
                group_of[group_of == group_of[j]] = group_of[i]
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(left: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the roots that meet in a band of ``left`` (band, set, size, root).

    A set shares with sets of other roots at most the shingles that some such set
    has; where these are too few for any partner, or for this one, the pair is not
    compared.  A crowded band is dealt out as a triangle of cells, one for each
    pair of its blocks of CELL sets, and a cell compares whole sets in arrays.
    """
    own = left.select("set", "root").distinct().join(sets.select("set", F.col("best.row").alias("row")), "set")
    held = storage.materialise(texts.join(own, "row").select("set", "text").mapInArrow(_hashes, "set bigint, hashes array<bigint>"), "unsettled-sets")
    shingles = held.join(own.select("set", "root"), "set").select("set", "root", F.explode("hashes").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    shared = shingles.join(common, "shingle").groupBy("set").agg(F.count("*").alias("shared"))
    able = storage.materialise(left.join(shared, "set").where(NEAR[1] * F.col("shared") >= NEAR[0] * F.col("size")), "able-sets")
    crowds = able.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / CELL).alias("blocks")).where("low < high").select("band", "blocks")
    dealt = able.join(crowds, "band").withColumn("block", F.pmod(F.xxhash64("set", "band"), F.col("blocks")))
    celled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    celled = celled.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set", "root", "size", "shared")
    return celled.join(held, "set").groupBy("band", "low", "high").applyInArrow(_linked, "a bigint, b bigint")


def _shared_sets(described: DataFrame, named: DataFrame) -> DataFrame:
    """Links (a, b) from the least set of each component of ``named`` (id, component_id) to its others; ids are rows of ``described``."""
    own = described.join(named.select(F.col("id").alias("row"), "component_id"), "row").select("set", "component_id").distinct()
    first = own.groupBy("component_id").agg(F.min("set").alias("a"), F.max("set").alias("high")).where("a < high").select("component_id", "a")
    return storage.materialise(own.join(first, "component_id").where("set <> a").select("a", F.col("set").alias("b")), "given-links")


def _components(sets: DataFrame, texts: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(node, root) of every set that has a similar one, or one it is linked with by ``given`` (a, b)."""
    postings = sets.select("set", "size", F.explode("bands").alias("band"))
    counted = postings.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = storage.materialise(postings.join(counted, "band"), "shared-bands")
    # The set that meets most others leads its bands: copies of a text are most like the text itself.
    met = shared.groupBy("set").agg(F.sum("n").alias("met"))
    leaders = shared.join(met, "set").groupBy("band").agg(F.max(F.struct("met", "set", "size")).alias("first")).select("band", F.col("first.set").alias("leader"), F.col("first.size").alias("leader_size"))
    led = storage.materialise(shared.join(leaders, "band").where("set <> leader").select("band", "set", "size", "leader", "leader_size"), "led-bands")
    pairs = led.where(_fit("size", "leader_size")).select(F.least("leader", "set").alias("a"), F.greatest("leader", "set").alias("b")).distinct()
    found = _similar(pairs, sets, texts)
    if given is not None:
        found = found.unionByName(given)
    roots = connected_components(found)
    named = storage.materialise(led.join(roots, led["set"] == roots["node"], "left").select("band", "set", "size", F.coalesce("root", "set").alias("root")), "named-bands")
    mixed = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = storage.materialise(named.join(mixed, "band"), "mixed-bands")
    more = storage.materialise(_across(left, sets, texts), "similar-across")
    return connected_components(found.unionByName(more))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each group of near copies: that of the least id, a null one last, then of the least hash of its text.

    ``linked`` takes a table (row, text) and gives (id, component_id) of each row;
    groups then hold together what either that or similarity links, directly or on the way.

    Cases: null, empty and blank texts are one group; a text of fewer words than a
    run is the set of its one whole run; rows are told apart by their place, so
    null and repeated ids keep unlike texts apart; all columns stay, whatever
    their names, since a row travels as one value; an empty table stays empty.
    """
    rows = storage.materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")), "numbered-rows")
    texts = rows.select("row", F.col(f"given.{text_col}").alias("text"))
    described = storage.materialise(texts.mapInArrow(_describe, "row bigint, set bigint, size bigint, bands array<bigint>"), "described-rows")
    order = rows.select("row", F.struct(F.col(f"given.{id_col}").isNull().alias("unnamed"), F.col(f"given.{id_col}").alias("id"), F.xxhash64(f"given.{text_col}").alias("hash"), "row").alias("best"))
    sets = described.join(order, "row").groupBy("set").agg(F.min("best").alias("best"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    sets = storage.materialise(sets, "distinct-sets")
    roots = _components(sets, texts, linked and _shared_sets(described, linked(texts)))
    best = sets.join(roots, sets["set"] == roots["node"], "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select("given.*")
