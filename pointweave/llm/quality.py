"""Quality selection by importance resampling.

Two hashed n-gram models are counted: of target text (documents labelled good)
and of raw text (all documents).  A document's log importance weight is the log
ratio of the two models' probabilities of its n-grams.  Their plain sum takes
neighbouring n-grams for independent and ranks by length; it is tempered to the
sum over ``temper`` n-grams, that is ``temper`` times the mean.  Gumbel top-k
draws k documents without replacement in proportion to these weights;
``effective_sample_size`` tells how many equal weights they are worth.

k comes from labelled rows that took no part in the target model: it is the
number of documents above the level that best parts held-out good from bad.

n-grams are single words and pairs of neighbours, in two readings each: the
lower-cased word, and the word's shape (runs of letters, digits and marks, and
whether it repeats the word before).  Words are split and made distinct by
Arrow, a slice of texts at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .encoding import text_slices

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Labelled rows that the target model and the acceptance level are fitted on, at most.
MOST_LABELS = 20_000
#: One labelled row in so many is held out of the target model, for the acceptance level.
HELD_OUT = 3
TEMPER = 40.0
#: A text's mean takes this many n-grams of ratio one beside its own, so a few words decide nothing.
PRIOR_NGRAMS = 6
MEMO_WORDS = 100_000
#: Bytes of text whose n-grams are held at once.
SLICE_BYTES = 1 << 20
#: Counts that a round of the exact k-th search may bring to the driver.
RADIX = 4096

RUNS = re.compile(r"(a)a+|(A)A+|(0)0+|(.)\4{3,}", re.S)
#: Ends of a text, beyond all 32-bit hashes of words.
BEGIN, END = np.uint64(1 << 33), np.uint64(1 << 34)


class _Kinds(dict):
    """Code points of letters, digits and marks as one sign a kind, for str.translate."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = kind = ord("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c)
        return kind


_KINDS = _Kinds()


def shape(word: str) -> str:
    """Letters, digits and marks of a word, with runs of one kind as one sign."""
    return RUNS.sub(lambda m: m[1] or m[2] or m[3] or m[4], word.translate(_KINDS))


class _Words(dict):
    """A word's two readings, hashed to 32 bits each, in one integer."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        kinds = word.translate(_KINDS)
        form = self.shapes.get(kinds)
        if form is None:
            form = self.shapes[kinds] = xxhash.xxh32_intdigest(shape(word))
        self[word] = value = xxhash.xxh32_intdigest(word.lower()) << 32 | form
        return value

    def bound(self) -> None:
        """Called between slices, whose distinct words come on top."""
        for held in (self, self.shapes):
            if len(held) > MEMO_WORDS:
                held.clear()


_WORDS = _Words()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _bucket(a: np.ndarray, b: np.ndarray | np.uint64, kind: int) -> np.ndarray:
    h = a * _MIX[0] + (b * _MIX[1] + np.uint64(kind) * _MIX[2])
    h ^= h >> np.uint64(29)
    return (h * _MIX[1] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def ngrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, the text that each belongs to); a text without words has those of its two ends."""
    _WORDS.bound()
    split = pc.utf8_split_whitespace(pa.array([x or "" for x in texts], pa.string()))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    table = np.fromiter(map(_WORDS.__getitem__, names), np.uint64, len(names))
    full = np.array([n != "" for n in names], bool)[coded.indices.to_numpy()]
    both = table[coded.indices.to_numpy()][full]
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[full]
    lexical, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    form[1:] += ((lexical[1:] == lexical[:-1]) & (owner[1:] == owner[:-1])) * np.uint64(1 << 32)
    # Each text's words between its two ends; a pair that an end begins belongs to no text.
    place = np.arange(len(owner)) + 2 * owner + 1
    wide_owner = np.repeat(np.arange(len(texts)), np.bincount(owner, minlength=len(texts)) + 2)
    out, of = [], []
    for kind, x in ((0, lexical), (2, form)):
        ends = np.full(len(owner) + 2 * len(texts), BEGIN)
        ends[np.flatnonzero(np.diff(wide_owner, append=-1))] = END
        ends[place] = x
        pairs = ends[:-1] != END
        out += [_bucket(x, np.uint64(0), kind), _bucket(ends[:-1], ends[1:], kind + 1)[pairs]]
        of += [owner, wide_owner[:-1][pairs]]
    return np.concatenate(out), np.concatenate(of)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for first, last, texts in text_slices(b.column(0), SLICE_BYTES):
            found, owner = ngrams(texts)
            counts[0] += np.bincount(found, minlength=BUCKETS)
            counts[1] += np.bincount(found[good[first:last][owner]], minlength=BUCKETS)
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, counts[0, at], counts[1, at])], ["bucket", "raw", "target"])


def label_sample(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(label_id, good, held) of at most ``most`` labelled documents, chosen by a hash of the id; an id with unlike labels is not good.

    ``held`` rows are kept from the target model, one in HELD_OUT by another hash.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") > 0).alias("good"))
    held = F.pmod(F.xxhash64(F.lit("held"), "label_id"), F.lit(HELD_OUT)) == 0
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(most).withColumn("held", held)


def log_ratios(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The log of target over raw probability of every bucket, counted over all documents.

    ``sample`` has a row bound of its own, so it is broadcast.  A task sends a
    row a bucket at most, and the driver gets as many.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id", "left")
    parts = rows.select("text", F.coalesce(F.col("good") & ~F.col("held"), F.lit(False)).alias("good")).mapInArrow(_count, "bucket bigint, raw bigint, target bigint")
    sums = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[:, sums["bucket"].to_numpy(np.int64)] = sums[["raw", "target"]].to_numpy(float).T
    if not counts[1].any():
        return np.zeros(BUCKETS)
    chance = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    return chance[1] - chance[0]


def weight_of(text: Column, ratios: np.ndarray) -> Column:
    """The mean log ratio of a text's n-grams, for a model of fixed size."""
    held = ratios

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for first, last, part in text_slices(texts, SLICE_BYTES):
            found, owner = ngrams(part)
            n = last - first
            parts.append(np.bincount(owner, held[found], minlength=n) / (np.bincount(owner, minlength=n) + PRIOR_NGRAMS))
        return pa.array(np.concatenate(parts))

    return weigh(text)


def gumbel(*parts: Column) -> Column:
    """Standard Gumbel noise from a hash of the row."""
    u = (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def effective_sample_size(log_weights: DataFrame) -> float:
    """The square of the sum of the weights over the sum of their squares, of the column ``log_weight``."""
    top = log_weights.agg(F.max("log_weight")).first()[0]
    if top is None:
        return 0.0
    w = F.exp(F.col("log_weight") - top)
    return log_weights.agg(F.sum(w) * F.sum(w) / F.sum(w * w)).first()[0]


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column ``key``, exactly: counts by equal steps, narrowed to the step that holds it.

    Each round brings at most RADIX + 1 counts to the driver; once a step is below
    the spacing of doubles, so few values are left that each is counted.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        step = (high - low) / RADIX
        fine = low + step == low or high - step == high
        digit = F.col("key") if fine else F.least(F.floor((F.col("key") - low) / step), F.lit(RADIX - 1))
        rows = keys.where(F.col("key").between(low, high)).groupBy(digit.alias("d")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for d, n, a, b in sorted(rows.collect(), reverse=True):
            if k <= n:
                low, high = a, b
                break
            k -= n
    return high


def acceptance_level(labelled: pd.DataFrame) -> float:
    """The log weight that parts good from bad labelled rows with least loss of either; midway of the gap if there is one."""
    good, bad = (np.sort(labelled.loc[labelled["good"] == g, "weight"].to_numpy()) for g in (True, False))
    if not len(good) or not len(bad):
        return -math.inf
    marks = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(good, marks, "left") / len(good)
    kept = 1 - np.searchsorted(bad, marks, "left") / len(bad)
    best = int(np.argmin(lost + kept))
    return float((marks[best] + marks[max(best - 1, 0)]) / 2)


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, temper: float = TEMPER, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` as struct ``row`` with log_weight, gumbel_key and selected.

    ``k`` is how many to draw; if not given, as many as have a log weight above
    the held-out labels' acceptance level (that of all labels, where none of the
    held-out ones is good or none bad).  Rows that tie at the last place are all
    drawn, repeated rows among them.  Null and empty texts have the weight of a
    text without words.  Without good and bad labels all rows are drawn; an empty
    table stays empty.  The columns ``keep`` of ``docs``, all if not given, stay
    inside ``row``, so no name clashes.

    Two passes read the texts: one counts, one weighs and writes ``row`` with its
    weight, and the draw reads what was written.
    """
    sample = storage.materialise(label_sample(labels), "labels")
    ratios = log_ratios(docs, sample, id_col, text_col)
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    weighed = rows.withColumn("log_weight", temper * weight_of(F.col("__text"), ratios))
    weighed = weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("__id"), F.col("__text")))
    weighed = storage.materialise(weighed.select("row", F.col("__id").cast("long").alias("label_id"), "log_weight", "gumbel_key"), "weighed", compression="zstd")
    if k is None:
        fitted = weighed.join(F.broadcast(sample), "label_id").select("good", "held", F.col("log_weight").alias("weight"))
        labelled = fitted.groupBy("good", "held", "weight").count().toPandas()
        held = labelled[labelled["held"]]
        level = acceptance_level(held if held["good"].nunique() == 2 else labelled)
        k = weighed.where(F.col("log_weight") > level).count()
    last = kth_largest(weighed.select(F.col("gumbel_key").alias("key")), k) if k and not weighed.isEmpty() else math.inf
    return weighed.select("row", "log_weight", "gumbel_key", (F.col("gumbel_key") >= last).alias("selected"))
