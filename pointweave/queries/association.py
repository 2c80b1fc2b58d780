"""Matching of regions over views, fusion of votes and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import association as a
from ..operators import consensus, retrieval
from .common import SIGHTINGS, collector, r6, sightings, table

QUERIES, query = collector()

RULES = a.MatchRules(min_shared=8, min_overlap=0.2, min_iou=0.1)
PAIRS = f"""
WITH s AS (SELECT * FROM {SIGHTINGS}),
n AS (SELECT region, key, count(*) AS size FROM s GROUP BY ALL),
pairs AS (SELECT x.region, x.key AS a, y.key AS b, x.frame AS frame_a, y.frame AS frame_b, count(*) AS shared FROM s x JOIN s y ON x.region = y.region AND x.point = y.point AND x.key < y.key AND x.frame <> y.frame GROUP BY ALL),
sized AS (SELECT p.*, u.size AS size_a, v.size AS size_b FROM pairs p JOIN n u ON u.key = a JOIN n v ON v.key = b),
scored AS (SELECT *, shared / least(size_a, size_b) AS overlap, shared / (size_a + size_b - shared) AS iou FROM sized),
cand AS (SELECT *, 0.5 * (overlap + iou) AS score FROM scored WHERE shared >= 8 AND overlap >= 0.2 AND iou >= 0.1)
"""
BEST = PAIRS + """,
alt AS (SELECT a AS key, frame_b AS other_frame, b AS choice, score FROM cand UNION ALL SELECT b, frame_a, a, score FROM cand),
ranked AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS lead FROM alt WINDOW w AS (PARTITION BY key, other_frame ORDER BY score DESC, choice)),
best AS (SELECT key, other_frame, choice, score, lead FROM ranked WHERE r = 1 AND (lead IS NULL OR lead > 0.08))
"""


def _candidates(spark, sf):
    return a.score_pairs(a.support_overlap(sightings(spark, sf), "region"), RULES)


@query(PAIRS + "SELECT region, a, b, shared, size_a, size_b FROM sized")
def support_overlap(spark, sf):
    return a.support_overlap(sightings(spark, sf), "region").select("region", "a", "b", "shared", "size_a", "size_b")


@query(PAIRS + "SELECT region, a, b, shared, round(overlap, 6) AS overlap, round(iou, 6) AS iou, round(score, 6) AS score FROM cand")
def match_candidates(spark, sf):
    return _candidates(spark, sf).select("region", "a", "b", "shared", r6("overlap").alias("overlap"), r6("iou").alias("iou"), r6("score").alias("score"))


@query(BEST + "SELECT key, other_frame, choice, round(score, 6) AS score FROM best")
def best_alternatives(spark, sf):
    return a.best_alternatives(_candidates(spark, sf)).select("key", "other_frame", "choice", r6("score").alias("score"))


@query(BEST + "SELECT c.a, c.b, c.shared FROM cand c WHERE EXISTS (FROM best t WHERE t.key = c.a AND t.choice = c.b) AND EXISTS (FROM best t WHERE t.key = c.b AND t.choice = c.a)")
def mutual_best(spark, sf):
    return a.mutual_best(_candidates(spark, sf)).select("a", "b", "shared")


MEMBERS = f"(SELECT DISTINCT region AS track, key, frame, 0.5 + (ascii(region) % 5) / 10.0 AS confidence FROM {SIGHTINGS})"


def _members(spark, sf):
    return sightings(spark, sf).select(F.col("region").alias("track"), "key", "frame", (0.5 + (F.ascii("region") % 5) / 10.0).alias("confidence")).distinct()


@query(f"""
WITH m AS (SELECT * FROM {MEMBERS}), s AS (SELECT DISTINCT key, point FROM {SIGHTINGS}), v AS (SELECT DISTINCT frame, point FROM {SIGHTINGS}),
votes AS (SELECT x.track, x.key, y.key AS other, y.confidence AS w, count(*) AS seen, count(h.key) AS hits FROM m x JOIN m y ON x.track = y.track AND x.frame <> y.frame JOIN s ON s.key = x.key JOIN v ON v.frame = y.frame AND v.point = s.point LEFT JOIN s h ON h.key = y.key AND h.point = s.point GROUP BY ALL),
g AS (SELECT track, key, sum(hits * w) AS hits, sum(seen * w) AS seen, count(*) AS views FROM votes GROUP BY ALL)
SELECT m.track, m.key, round(hits / seen, 6) AS agreement, coalesce(views, 0) AS views, round(CASE WHEN hits / seen IS NULL THEN 0.35 ELSE 0.35 + 0.65 * (hits / seen) END, 6) AS reliability FROM m LEFT JOIN g USING (track, key)""")
def loo_agreement(spark, sf):
    seen = sightings(spark, sf)
    rated = a.leave_one_out(_members(spark, sf), seen.select("key", "point").distinct(), seen.select("frame", "point").distinct())
    return rated.select("track", "key", r6("agreement").alias("agreement"), "views", r6("reliability").alias("reliability"))


@query("WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM v) SELECT user_id, event_type, votes FROM r WHERE r = 1")
def label_vote(spark, sf):
    e = table(spark, sf, "events").withColumn("one", F.lit(1).cast("long"))
    return a.label_vote(e, "user_id", "event_type", "one").select("user_id", "event_type", "votes")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def representative_row(spark, sf):
    return a.representative(table(spark, sf, "events"), "user_id", "value", "event_id").select("user_id", "event_id", "value")


OBSERVED = "(SELECT event_type AS object, strftime(ts, '%Y-%m-%d') AS frame, user_id AS point, floor(value % 100) / 100.0::DOUBLE AS weight FROM events)"
LEVELS = "(SELECT DISTINCT event_type AS object, CASE WHEN event_type < 'e' THEN 'part' ELSE 'object' END AS level FROM events)"
FUSED = f"""
WITH o AS (SELECT * FROM {OBSERVED}), l AS (SELECT * FROM {LEVELS}),
f AS (SELECT object, frame, point, max(weight) AS w FROM o GROUP BY ALL),
votes AS (SELECT object, point, sum(w) AS votes, count_if(w > 0)::BIGINT AS views FROM f GROUP BY ALL),
possible AS (SELECT level, point, count(DISTINCT frame) AS possible FROM o JOIN l USING (object) GROUP BY ALL),
fused AS (SELECT object, point, votes, views, possible, votes / greatest(possible, 1) * least(1.0, views / 2) AS score FROM votes JOIN l USING (object) JOIN possible USING (level, point))
"""


def _fused(spark, sf):
    e = table(spark, sf, "events")
    observed = e.select(F.col("event_type").alias("object"), F.date_format("ts", "yyyy-MM-dd").alias("frame"), F.col("user_id").alias("point"), (F.floor(F.col("value") % 100) / 100.0).alias("weight"))
    levels = e.select(F.col("event_type").alias("object"), F.when(F.col("event_type") < "e", "part").otherwise("object").alias("level")).distinct()
    visible = observed.join(levels, "object").select("frame", "level", "point").distinct()
    return a.vote_fusion(observed, visible, levels), levels


@query(FUSED + "SELECT object, point, round(votes, 6) AS votes, views, possible, round(score, 6) AS score FROM fused")
def vote_fusion(spark, sf):
    return _fused(spark, sf)[0].select("object", "point", r6("votes").alias("votes"), "views", "possible", r6("score").alias("score"))


@query(FUSED + ", r AS (SELECT point, object, row_number() OVER (PARTITION BY point ORDER BY round(score, 9) DESC, (level = 'part')::INT, object)::INT AS rank FROM fused JOIN l USING (object) WHERE score > 0) SELECT point, object, rank FROM r WHERE rank <= 4")
def top_candidates(spark, sf):
    fused, levels = _fused(spark, sf)
    flagged = fused.join(levels, "object").withColumn("is_part", (F.col("level") == "part").cast("int")).withColumn("score", F.round("score", 9))
    return a.top_candidates(flagged).select("point", "object", "rank")


OWNER = FUSED + """,
meta AS (SELECT object, level, CASE WHEN level = 'object' THEN 'scene' ELSE (SELECT min(object) FROM l WHERE level = 'object') END AS parent, object LIKE '%r%' AS priority FROM l),
fit AS (SELECT point, object, round(score, 9) AS score, level, parent FROM fused JOIN meta USING (object) WHERE round(score, 9) >= 0.02),
ow AS (SELECT point, object, score, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM fit WHERE level = 'object' WINDOW w AS (PARTITION BY point ORDER BY score DESC, object)),
own AS (SELECT p.point, CASE WHEN coalesce(score - nxt < 0.005, false) THEN NULL ELSE object END AS owner, coalesce(score - nxt < 0.005, false) AS unsure FROM (SELECT DISTINCT point FROM fit) p LEFT JOIN ow ON ow.point = p.point AND r = 1),
pr AS (SELECT f.point, f.object, score, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM fit f JOIN own o ON f.point = o.point AND NOT o.unsure WHERE f.level = 'part' AND (f.parent = o.owner OR (o.owner IS NULL AND f.parent = 'scene')) WINDOW w AS (PARTITION BY f.point ORDER BY score DESC, f.object)),
ch AS (SELECT own.point, owner, CASE WHEN coalesce(score - nxt < 0.005, false) THEN NULL ELSE object END AS part, unsure OR coalesce(score - nxt < 0.005, false) AS ambiguous FROM own LEFT JOIN pr ON pr.point = own.point AND r = 1),
res AS (SELECT point, owner, coalesce(part, owner) AS object, ambiguous FROM ch)
SELECT point, owner, res.object, ambiguous, CASE WHEN res.object IS NULL THEN NULL WHEN m.priority OR coalesce(u.priority, false) THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM res LEFT JOIN meta m ON m.object = res.object LEFT JOIN meta u ON u.object = m.parent"""


@query(OWNER)
def owner_choice(spark, sf):
    fused, levels = _fused(spark, sf)
    first = levels.where("level = 'object'").agg(F.min("object").alias("first"))
    objects = levels.crossJoin(first).select("object", "level", F.when(F.col("level") == "object", "scene").otherwise(F.col("first")).alias("parent"), F.contains("object", F.lit("r")).alias("priority"))
    return a.owner_choice(fused.withColumn("score", F.round("score", 9)), objects, 0.02, 0.005)


@query("""
WITH t AS (SELECT user_id AS query, event_type AS label, 'i' || (ascii(event_type) % 3) AS identity, round((value % 10) / 10, 3) AS p FROM events),
ph AS (SELECT query, identity, label, round(avg(p), 9) AS score FROM t GROUP BY ALL),
id AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, identity ORDER BY score DESC, label) AS r FROM ph) WHERE r = 1),
rk AS (SELECT query, label, score, score - lead(score) OVER w AS lead, row_number() OVER w AS r FROM id WINDOW w AS (PARTITION BY query ORDER BY score DESC, label))
SELECT query, label, round(score, 6) AS score, CASE WHEN score < 0.2 THEN 'rejected' WHEN coalesce(lead < 0.025 OR lead = 0, false) THEN 'ambiguous' ELSE 'accepted' END AS status FROM rk WHERE r = 1""")
def query_label_alignment(spark, sf):
    e = table(spark, sf, "events")
    tokens = e.select(F.col("user_id").alias("query"), F.col("event_type").alias("label"), F.concat(F.lit("i"), (F.ascii("event_type") % 3).cast("string")).alias("identity"), F.lit(0).alias("token"), F.round(F.col("value") % 10 / 10, 3).alias("p"))
    means = tokens.groupBy("query", "label", "identity").agg(F.round(F.avg("p"), 9).alias("p"))
    return a.align_queries(means).select("query", "label", r6("score").alias("score"), "status")


@query("""
WITH base AS (SELECT DISTINCT l_suppkey AS m, (l_shipdate::DATE - DATE '1992-01-01')::BIGINT AS point FROM lineitem),
s AS (SELECT 'm' || lpad(m::VARCHAR, 6, '0') AS mask, point FROM base),
meta AS (SELECT DISTINCT 'm' || lpad(m::VARCHAR, 6, '0') AS mask, m % 8 AS frame, CASE WHEN m % 2 = 0 THEN 'object' ELSE 'part' END AS level, 'l' || m % 3 AS label, CASE WHEN m % 5 = 0 THEN 'o' || m % 4 END AS object_id FROM base),
n AS (SELECT mask, count(*) AS size FROM s GROUP BY mask),
sh AS (SELECT p.mask AS a, q.mask AS b, count(*) AS shared FROM s p JOIN s q ON p.point = q.point AND p.mask < q.mask GROUP BY ALL),
pair AS (SELECT x.mask AS a, y.mask AS b, x.object_id AS ia, y.object_id AS ib, x.frame <> y.frame AS apart, x.label = y.label AS alike, u.size AS na, v.size AS nb FROM meta x JOIN meta y ON x.mask < y.mask AND x.level = y.level JOIN n u ON u.mask = x.mask JOIN n v ON v.mask = y.mask)
SELECT a, b, coalesce(shared, 0) AS shared, CASE WHEN ia = ib THEN 2.0 ELSE round(shared / least(na, nb), 6) END::DOUBLE AS score FROM pair LEFT JOIN sh USING (a, b)
WHERE coalesce(ia = ib, false) OR ((ia IS NULL OR ib IS NULL) AND apart AND alike AND shared >= 3 AND shared / least(na, nb) >= 0.25)""")
def mask_links(spark, sf):
    base = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("m"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("point")).distinct()
    m = F.col("m")
    name = F.concat(F.lit("m"), F.lpad(m.cast("string"), 6, "0"))
    text = lambda p, k: F.concat(F.lit(p), (m % k).cast("string"))
    masks = base.select(name.alias("mask"), (m % 8).alias("frame"), F.when(m % 2 == 0, "object").otherwise("part").alias("level"), text("l", 3).alias("label"), F.when(m % 5 == 0, text("o", 4)).alias("object_id")).distinct()
    return a.mask_links(base.select(name.alias("mask"), "point"), masks, 0.25).select("a", "b", "shared", r6("score").alias("score"))


@query()
def greedy_association(spark, sf):
    seen = sightings(spark, sf)
    groups, _ = a.constrained_groups(seen.select("key", "frame").distinct(), a.mutual_best(_candidates(spark, sf)).select("a", "b", "score"))
    return groups


@query()
def aligned_scenes(spark, sf):
    """Labels as scenes: two frames of each vector's leading components, and a turned, doubled and moved target that every tenth misses."""
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf, "embeddings").withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    source = [(x(i) + F.col("frame") * x(i + 3) / 500).alias(f"s{c}") for i, c in enumerate("xyz")]
    off = F.when(F.col("vec_id") % 10 == 0, 1.0).otherwise(0.0)
    target = [(2 * t + off * x(i + 6) + i).alias(f"t{c}") for i, (t, c) in enumerate(zip((-x(1), x(0), x(2)), "xyz"))]
    found = consensus.align(e.select(F.col("label").alias("scene"), F.col("vec_id").alias("track"), "frame", *source, *target), "scene")
    return found.select("scene", "status", "reason", "tracks", "inliers", "held_out", r6("threshold").alias("threshold"), F.round("scale", 2).alias("scale"))


@query()
def descriptor_bank(spark, sf):
    e = table(spark, sf, "embeddings")
    return a.descriptor_bank(e, "label", "vec_id", "embedding").select("label", "cluster", "views", "compactness", "alignment", "weight")


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) + 0.0 AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 20""")
def descriptor_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    pairs = e.alias("a").join(e.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("b.vec_id") - F.col("a.vec_id")).between(1, 20))
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), (F.round(numeric.cosine(F.col("a.embedding"), F.col("b.embedding")), 5) + 0.0).alias("cosine"))


KNN = """
WITH d AS (SELECT a.vec_id AS q, b.vec_id AS t, a.vec_id % 2 AS side, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 <> b.vec_id % 2),
r AS (SELECT q, t, side, d, lead(d) OVER w AS nxt, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY q ORDER BY d, t)),
good AS (SELECT * FROM r WHERE r = 1 AND nxt IS NOT NULL AND d < 0.95 * nxt)
SELECT f.q AS a, f.t AS b FROM good f JOIN good g ON f.q = g.t AND f.t = g.q WHERE f.side = 0"""


@query(KNN)
def ratio_test_matches(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 2).alias("side"), F.col("vec_id").alias("name"), F.col("embedding").alias("vector"))
    return retrieval.ratio_matches(retrieval.nearest_across(e, "label"), 0.95)


@query("""
WITH i AS (SELECT doc_id AS i, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents),
anchors AS (SELECT i, o FROM i WHERE o IN (SELECT floor(k * (n - 1)::DOUBLE / 11)::BIGINT FROM range(12) t(k), (SELECT any_value(n) AS n FROM i)))
SELECT DISTINCT least(a.i, b.i) AS i, greatest(a.i, b.i) AS j FROM i a JOIN i b ON b.o - a.o IN (1, 2) UNION SELECT a.i, b.i FROM anchors a JOIN anchors b ON a.o < b.o""")
def candidate_view_pairs(spark, sf):
    return retrieval.capture_pairs(table(spark, sf, "documents"), "doc_id")
