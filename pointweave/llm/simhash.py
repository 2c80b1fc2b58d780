"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits link at three or fewer differing bits.  Split into two
segments of 32 bits, two linked fingerprints have a segment in which at most one
bit differs.  Each distinct fingerprint therefore enters a table once a segment,
and looks up the ball of radius one around it; as of two neighbours one has the
differing bit set, the ball's half with a set bit cleared is enough.  Matches
are verified over all 64 bits inside the join.

Exact copies meet as one fingerprint before anything is paired.  A fingerprint
has at most 43,744 others within three bits, whatever the size of its group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Words are runs of other bytes than these; only A-Z has its case changed.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; zero if it has no words."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        spans = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends[size - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(spans), HASHES_AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in spans[at : at + HASHES_AT_ONCE]], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(spans), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "id bigint, fp bigint")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` at most ``distance`` (3 at most) bits apart; a pair may come twice."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments of radius one find distances up to 3")
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    halves = prints.select("fp", F.explode(F.array(low, high + F.lit(1 << 32))).alias("key"))
    bits = F.array(*[F.lit(1 << j) for j in range(32)])
    cleared = F.transform(F.filter(bits, lambda b: F.col("key").bitwiseAND(b) != 0), lambda b: F.col("key").bitwiseXOR(b))
    ball = halves.select(F.col("fp").alias("a"), F.col("key").alias("own"), F.explode(F.concat(F.array("key"), cleared)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance
    once = (F.col("p.key") != F.col("own")) | (F.col("a") < F.col("fp"))
    return ball.alias("p").join(halves.alias("t"), (F.col("p.key") == F.col("t.key")) & near & once & (F.col("a") != F.col("fp"))).select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the least id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.  A null
    id counts in no minimum: a component of null ids alone has a null id.  Rows
    that repeat give a row each; texts are read whole; other columns are not
    read; an empty table gives an empty result.
    """
    rows = storage.materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = storage.materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp")))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    tops = member.groupBy("root").agg(F.min("least").alias("top"))
    linked = member.join(tops, "root").select("fp", "top")
    # Written, so that both sides of the last join are plain exchanges: a fingerprint of very many copies is then split.
    named = storage.materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id")), "component-names")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the least id, a null one last, then of the least hash of its text.

    Rows are told apart by their place, so null and repeated ids keep unlike texts
    apart; all columns stay, whatever their names, since a row travels as one value.
    """
    rows = storage.materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")), "numbered-rows")
    keys = rows.select("row", F.col(f"given.{id_col}").alias("id"), F.col(f"given.{text_col}").alias("text"))
    named = near_duplicates(keys, "row", "text").select(F.col("id").alias("row"), "component_id")
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", F.xxhash64("text").alias("hash"), "row"))
    kept = keys.join(named, "row").groupBy("component_id").agg(best.alias("best")).select(F.col("best.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("given.*")
