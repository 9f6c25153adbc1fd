"""Queries on signals, audits, regression checks and validators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions import text as T
from cutloom.operators import checks as C
from cutloom.operators import edl as E
from cutloom.operators import intervals as I
from cutloom.operators import signal as G
from cutloom.plans.edits import _TIMELINE, edl
from cutloom.plans.sql import SEGMENTS, WORDS, select
from cutloom.plans.words import segments
from cutloom.sources import tables as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def signals(spark, sf_dir) -> DataFrame:
    return D.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int")).alias("samples"))


_SIGNALS = """
signals AS (SELECT vec_id AS asset_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS INTEGER)) AS samples FROM embeddings),
sx AS (SELECT asset_id, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 AS i FROM signals),
fr AS (SELECT asset_id, CAST(i // 8 AS INTEGER) AS frame_idx, CAST(count(*) AS INTEGER) AS n, sqrt(sum(x::DOUBLE * x) / count(*)) / 32768.0 AS rms FROM sx GROUP BY 1, 2)"""


@query(f"WITH {_SIGNALS} SELECT asset_id, frame_idx, n, round(rms, 9) AS rms FROM fr")
def a18_frame_rms(spark, sf_dir):
    """Loudness of frames."""
    return G.frame_rms(signals(spark, sf_dir), 8).withColumn("rms", F.round("rms", 9))


@query(f"""WITH {_SIGNALS} SELECT asset_id, round(8.0 - coalesce(max(CASE WHEN rms > 0.0045 THEN frame_idx * 1.0 END), 0.0), 6)::DOUBLE AS tail_s FROM fr WHERE n = 8 GROUP BY 1""")
def a19_silent_tail(spark, sf_dir):
    """How long the end of a signal is quiet."""
    return G.silent_tail(G.frame_rms(signals(spark, sf_dir), 8), F.lit(8.0), 1.0, 0.0045, 8).withColumn("tail_s", F.round("tail_s", 6))


@query(f"""WITH {_SIGNALS}, p AS (SELECT asset_id, CAST(asset_id % 8 AS INTEGER) AS frame_at FROM signals)
SELECT p.asset_id, frame_at, first(frame_idx ORDER BY rms, frame_idx) AS frame_idx, round(20 * log10(first(rms ORDER BY frame_idx = frame_at DESC) + 1e-9) - 20 * log10(min(rms) + 1e-9), 6) AS gain_db,
  max(rms) >= 0.005 AS speech FROM p JOIN fr ON fr.asset_id = p.asset_id AND abs(frame_idx - frame_at) <= 2 GROUP BY 1, 2""")
def t5_valleys(spark, sf_dir):
    """The quietest frame near a cut, what is gained, and whether anything speaks there."""
    fr = G.frame_rms(signals(spark, sf_dir), 8)
    p = signals(spark, sf_dir).select("asset_id", F.lit(1).alias("point_id"), (F.col("asset_id") % 8).cast("int").alias("frame_at"))
    v = G.valley(p, fr, 2)
    at = fr.select("asset_id", F.col("frame_idx").alias("frame_at"), F.col("rms").alias("rms_at"))
    near = p.withColumn("frame_idx", F.explode(F.sequence(F.col("frame_at") - 2, F.col("frame_at") + 2))).join(fr, ["asset_id", "frame_idx"])
    peak = near.groupBy("asset_id").agg((F.max("rms") >= 0.005).alias("speech"))
    out = v.join(at, ["asset_id", "frame_at"]).join(peak, "asset_id")
    return out.select("asset_id", "frame_at", "frame_idx", F.round(G.decibel(F.col("rms_at")) - G.decibel(F.col("rms")), 6).alias("gain_db"), "speech")


_LAG_SQL = f"""WITH {_SIGNALS},
pr AS (SELECT a.asset_id, a.samples AS a, b.samples AS b FROM signals a JOIN signals b ON b.asset_id = a.asset_id + 1),
c AS (SELECT asset_id, lag, sum(a[i] * b[i + lag]) AS s FROM (SELECT asset_id, a, b, lag, unnest(range(greatest(1, 1 - lag), least(64, 64 - lag) + 1)) AS i FROM (SELECT *, unnest(range(-6, 7)) AS lag FROM pr)) GROUP BY 1, 2),
n AS (SELECT asset_id, list_sum(list_transform(a, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b, lambda x: x::DOUBLE * x)) AS q FROM pr)
SELECT c.asset_id, CAST(first(lag ORDER BY s DESC, lag) AS INTEGER) AS lag, round(max(s) / any_value(CASE WHEN q = 0 THEN 1 ELSE sqrt(q) END), 6) AS peak FROM c JOIN n ON n.asset_id = c.asset_id GROUP BY 1"""


@query(_LAG_SQL)
def m1_lags(spark, sf_dir):
    """M1: lag and peak of the cross-correlation of neighbouring signals."""
    s = signals(spark, sf_dir)
    pairs = s.withColumnRenamed("samples", "a").join(s.select((F.col("asset_id") - 1).alias("asset_id"), F.col("samples").alias("b")), "asset_id")
    return G.lags(pairs, 6).withColumn("peak", F.round("peak", 6))


def signal_blocks(spark, sf_dir, size: int) -> DataFrame:
    """The signals in blocks of size samples: asset_id, block, samples."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / size).cast("int")), lambda k: F.struct(k.alias("block"), F.slice("samples", k * size + 1, size).alias("samples")))
    return signals(spark, sf_dir).select("asset_id", F.explode(cut).alias("b")).select("asset_id", "b.block", "b.samples")


@query(f"WITH {_SIGNALS} SELECT asset_id, frame_idx, n, round(rms, 9) AS rms FROM fr")
def a18_block_rms(spark, sf_dir):
    """Loudness of frames of signals that come in blocks, which frames run over."""
    b = signal_blocks(spark, sf_dir, 20)
    return G.block_rms(b.select("asset_id", (F.col("block") * 20).alias("at"), "samples"), 8).withColumn("rms", F.round("rms", 9))


@query(_LAG_SQL)
def m1_block_lags(spark, sf_dir):
    """M1: lag and peak of the cross-correlation of neighbouring signals that come in blocks."""
    b = signal_blocks(spark, sf_dir, 20)
    return G.block_lags(b, b.withColumn("asset_id", F.col("asset_id") - 1), 20, 6).withColumn("peak", F.round("peak", 6))


@query("""WITH px AS (SELECT vec_id AS asset_id, list_transform(range(0, 1024), lambda k: CAST(floor(least(greatest((embedding[((k // 32) * 37 + k % 32) % 64 + 1]::DOUBLE + 0.5) * 255, 0), 255)) AS INTEGER)) AS p FROM embeddings),
bl AS (SELECT asset_id, list_transform(range(0, 256), lambda k: (p[(k // 16) * 64 + (k % 16) * 2 + 1] + p[(k // 16) * 64 + (k % 16) * 2 + 2] + p[(k // 16) * 64 + 32 + (k % 16) * 2 + 1] + p[(k // 16) * 64 + 32 + (k % 16) * 2 + 2]) // 4) AS b FROM px),
h AS (SELECT asset_id, list_transform(range(0, 240), lambda k: CASE WHEN b[(k // 15) * 16 + k % 15 + 1] > b[(k // 15) * 16 + k % 15 + 2] THEN 1 ELSE 0 END) AS h FROM bl)
SELECT a.asset_id, CAST(list_sum(list_transform(range(1, 241), lambda k: CASE WHEN a.h[k] <> b.h[k] THEN 1 ELSE 0 END)) AS INTEGER) AS distance, CAST(list_sum(a.h) AS INTEGER) AS ones FROM h a JOIN h b ON b.asset_id = a.asset_id + 1""")
def m2_image_hashes(spark, sf_dir):
    """M2, M3: hashes of small grey images and how they differ."""
    e = D.read(spark, sf_dir, "embeddings")
    value = lambda k: F.floor(F.least(F.greatest((F.element_at("embedding", (F.floor(k / 32) * 37 + k % 32).cast("int") % 64 + 1).cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    h = e.select(F.col("vec_id").alias("asset_id"), F.transform(F.sequence(F.lit(0), F.lit(1023)), value).alias("p")).select("asset_id", G.dhash(F.col("p")).alias("h"))
    j = h.join(h.select((F.col("asset_id") - 1).alias("asset_id"), F.col("h").alias("h2")), "asset_id")
    ones = F.aggregate("h", F.lit(0), lambda s, x: s + F.bit_count(x))
    return j.select("asset_id", G.hamming(F.col("h"), F.col("h2")).alias("distance"), ones.alias("ones"))


_PARTS = """,
parts AS (SELECT asset_id, seg_id, end_us - start_us AS edl_us, end_us - start_us + (seg_id * 13 % 300 - 150) * 1000 AS v_us, end_us - start_us + (seg_id * 29 % 300 - 150) * 1000 AS a_us, (seg_id * 71 % 900) * 1000 AS tail_us FROM segments WHERE seg_id % 17 <> 0),
audit AS (SELECT s.asset_id, s.seg_id, p.seg_id IS NULL AS missing, list_filter([CASE WHEN p.seg_id IS NULL THEN 'FILE_MISSING' END,
  CASE WHEN v_us > 0 AND abs(v_us - edl_us) > 100000 THEN 'V_DUR_DIFF' END, CASE WHEN a_us > 0 AND abs(a_us - edl_us) > 100000 THEN 'A_DUR_DIFF' END,
  CASE WHEN v_us > 0 AND a_us > 0 AND abs(v_us - a_us) > 100000 THEN 'VA_SYNC' END, CASE WHEN tail_us > 500000 THEN 'SILENT_TAIL' END], lambda x: x IS NOT NULL) AS v
  FROM segments s LEFT JOIN parts p ON p.asset_id = s.asset_id AND p.seg_id = s.seg_id)"""


def audit(spark, sf_dir, limit_us: int = 100_000, tail_us: int = 500_000) -> DataFrame:
    """Planned segments against measured parts; the limits of V4 are 50000 and 500000."""
    s = segments(spark, sf_dir).select("asset_id", "seg_id", (F.col("end_us") - F.col("start_us")).alias("edl_us"))
    i, dur = F.col("seg_id"), F.col("edl_us")
    p = s.filter("seg_id % 17 <> 0").select("asset_id", "seg_id", (dur + (i * 13 % 300 - 150) * 1000).alias("v_us"), (dur + (i * 29 % 300 - 150) * 1000).alias("a_us"), ((i * 71 % 900) * 1000).alias("tail_us"))
    return C.part_audit(s, p, limit_us, tail_us)


@query(select(SEGMENTS + _PARTS, "SELECT asset_id, seg_id, missing, array_to_string(v, ',') AS violations FROM audit"))
def v3_part_audit(spark, sf_dir):
    """What is wrong with each part."""
    return audit(spark, sf_dir).withColumn("violations", F.array_join("violations", ","))


@query(select(SEGMENTS + _PARTS.replace("> 100000", "> 50000"), "SELECT asset_id, seg_id, missing, array_to_string(v, ',') AS violations FROM audit"))
def v4_strict_part_audit(spark, sf_dir):
    """V4: what is wrong with each rendered part, by stricter limits."""
    return audit(spark, sf_dir, 50_000).withColumn("violations", F.array_join("violations", ","))


@query(select(SEGMENTS + _PARTS, "SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE len(v) > 0) AS bad, count(*) FILTER (WHERE len(v) = 0) AS passed, bool_and(len(v) = 0) AS all_pass FROM audit GROUP BY 1"))
def a14_audit_summary(spark, sf_dir):
    """Audits of each asset."""
    bad = F.size("violations") > 0
    return audit(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("total"), F.count_if(bad).alias("bad"), F.count_if(~bad).alias("passed"), F.bool_and(~bad).alias("all_pass"))


@query(select(SEGMENTS + """,
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us) AS INTEGER) AS drop_id FROM drops)""", """
SELECT d.asset_id, d.drop_id, count(s.seg_id) AS n_over, CASE WHEN count(s.seg_id) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM dr d LEFT JOIN segments s ON s.asset_id = d.asset_id AND s.start_us < d.end_us AND d.start_us < s.end_us GROUP BY 1, 2"""))
def j19_drops_still_kept(spark, sf_dir):
    """J19, first half: windows that a kept segment still overlaps; the other half is j19_keep_ends."""
    d = D.drops(D.words(spark, sf_dir)).withColumn("drop_id", F.row_number().over(Window.partitionBy("asset_id").orderBy("start_us", "end_us")))
    b = I.bucketed(d, None, None, "drop_id")
    s = I.bucketed(segments(spark, sf_dir), None, None, "seg_id").select(F.col("_asset").alias("a"), F.col("_bucket").alias("b"), F.col("_start").alias("s"), F.col("_end").alias("e"), "seg_id")
    hit = b.join(s, (F.col("_asset") == F.col("a")) & (F.col("_bucket") == F.col("b")) & (F.col("s") < F.col("_end")) & (F.col("_start") < F.col("e")), "left")
    n = hit.groupBy(F.col("_asset").alias("asset_id"), "drop_id").agg(F.count_distinct("seg_id").alias("n_over"))
    return n.withColumn("status", F.when(F.col("n_over") == 0, "PASS").otherwise("FAIL"))


@query(select(SEGMENTS, """
SELECT s.asset_id, s.seg_id, s.is_last AS last, s.end_us - w.end_us AS margin_us, CASE WHEN coalesce(s.end_us - w.end_us, -1) >= CASE WHEN s.is_last THEN 500000 ELSE 0 END THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT *, lead(seg_id) OVER (PARTITION BY asset_id ORDER BY end_us, seg_id) IS NULL AS is_last FROM segments) s LEFT JOIN words w ON w.asset_id = s.asset_id AND w.word_idx = s.last_idx"""))
def j19_keep_ends(spark, sf_dir):
    """J19, second half: kept ends that don't reach their last word's end, at the tail 0.5 s more."""
    return C.keep_ends(segments(spark, sf_dir), D.words(spark, sf_dir))


_ITEMS = """,
items AS (SELECT asset_id, seg_id AS item_id, CASE seg_id % 4 WHEN 0 THEN 'keyword_absent' WHEN 1 THEN 'keyword_present' WHEN 2 THEN 'duration_check' ELSE 'last_word_complete' END AS method,
  CASE WHEN seg_id % 11 <> 0 THEN start_us END AS ws, CASE WHEN seg_id % 11 <> 0 THEN end_us END AS we, CASE WHEN seg_id % 8 = 0 THEN [] ELSE ['the', 'que', 'die'] END AS kws FROM segments),
wt AS (SELECT i.asset_id, i.item_id, string_agg(lower(w.word), ' ' ORDER BY w.word_idx) AS t, max(w.end_us) AS last_us FROM items i JOIN words w ON w.asset_id = i.asset_id
  AND w.start_us + w.end_us >= 2 * ws AND w.start_us + w.end_us < 2 * we GROUP BY 1, 2),
res AS (SELECT i.asset_id, i.item_id, i.method, CASE WHEN ws IS NULL THEN 'SKIP' WHEN t IS NULL THEN 'FAIL'
  WHEN method IN ('keyword_absent', 'keyword_present') AND len(kws) = 0 THEN 'UNVERIFIED'
  WHEN method = 'keyword_absent' THEN CASE WHEN len(list_filter(kws, lambda k: contains(t, k))) = 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN method = 'keyword_present' THEN CASE WHEN len(list_filter(kws, lambda k: contains(t, k))) > 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN method = 'duration_check' THEN CASE WHEN we - ws >= 1000000 THEN 'PASS' ELSE 'FAIL' END
  ELSE CASE WHEN last_us <= we THEN 'PASS' ELSE 'FAIL' END END AS status
  FROM items i LEFT JOIN wt ON wt.asset_id = i.asset_id AND wt.item_id = i.item_id)"""


def regression(spark, sf_dir) -> DataFrame:
    """The part of V5 that its SQL holds: four methods on the source's words; empty keyword lists verify nothing.  All of V5 is
    in v6_output_checks."""
    s, i = segments(spark, sf_dir), F.col("seg_id")
    method = F.when(i % 4 == 0, "keyword_absent").when(i % 4 == 1, "keyword_present").when(i % 4 == 2, "duration_check").otherwise("last_word_complete")
    there = i % 11 != 0
    kws = F.when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("the"), F.lit("que"), F.lit("die")))
    items = s.select("asset_id", i.alias("item_id"), method.alias("method"), F.when(there, F.col("start_us")).alias("ws"), F.when(there, F.col("end_us")).alias("we"), kws.alias("kws"))
    windows = items.filter("ws is not null").withColumnsRenamed({"ws": "start_us", "we": "end_us"})
    w = I.point_join(D.words(spark, sf_dir), I.twice_mid() / 2, I.bucketed(windows, None, None, "item_id"), I.mid_inside(), "inner")
    said = w.groupBy("asset_id", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", F.lower("word").alias("w")))), lambda x: x["w"]), " ").alias("t"), F.max("end_us").alias("last_us"))
    j = items.join(said, ["asset_id", "item_id"], "left")
    found = F.size(F.filter("kws", lambda k: F.contains(F.col("t"), k)))
    ok = lambda c: F.when(c, "PASS").otherwise("FAIL")
    keyword = F.col("method").isin("keyword_absent", "keyword_present")
    status = (
        F.when(F.col("ws").isNull(), "SKIP").when(F.col("t").isNull(), "FAIL").when(keyword & (F.size("kws") == 0), "UNVERIFIED")
        .when(F.col("method") == "keyword_absent", ok(found == 0)).when(F.col("method") == "keyword_present", ok(found > 0))
        .when(F.col("method") == "duration_check", ok(F.col("we") - F.col("ws") >= 1000000)).otherwise(ok(F.col("last_us") <= F.col("we")))
    )
    return j.select("asset_id", "item_id", "method", status.alias("status"))


@query(select(SEGMENTS + _ITEMS, "SELECT * FROM res"))
def v5_regression_items(spark, sf_dir):
    """V5 in part: the status of every item on the source's words."""
    return regression(spark, sf_dir)


@query(select(SEGMENTS + _ITEMS, "SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIP') AS skipped, CASE WHEN bool_and(status <> 'FAIL') THEN 'PASS' ELSE 'FAIL' END AS overall FROM res GROUP BY 1"))
def a13_regression_summary(spark, sf_dir):
    """A13 in part: counts by status and the verdict, without errors and the check of the length."""
    s = F.col("status")
    return regression(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("total"), F.count_if(s == "PASS").alias("passed"), F.count_if(s == "FAIL").alias("failed"), F.count_if(s == "SKIP").alias("skipped"), F.when(F.bool_and(s != "FAIL"), "PASS").otherwise("FAIL").alias("overall"))


def output_items(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, words, frames and lengths on the output's time: an item for each segment, by all methods in turn and an unknown
    one; the frames of A18 are spread evenly over the output."""
    i, us = F.col("seg_id"), lambda n: F.floor(n * F.lit(1000000) / 30)
    # Small against the words that it takes to make, and met five times.
    tl = E.output_timeline(segments(spark, sf_dir)).select("asset_id", "seg_id", "start_us", "end_us", "n_frames", "out_frame").persist()
    assets = tl.groupBy("asset_id").agg(us(F.sum("n_frames")).alias("total_us"), F.sum(F.col("end_us") - F.col("start_us")).alias("edl_us"))
    methods = ("keyword_absent", "keyword_present", "last_word_complete", "duration_check", "edl_duration_check", "audio_content_check", "other")
    there, few = i % 11 != 0, F.array(F.lit("the"), F.lit("que"), F.lit("die"))
    items = tl.select(
        "asset_id", i.alias("item_id"), F.get(F.array(*map(F.lit, methods)), (i % 7).cast("int")).alias("method"),
        F.when(there, us(F.col("out_frame"))).alias("start_us"), F.when(there, us(F.col("out_frame") + F.col("n_frames"))).alias("end_us"),
        F.when(i % 2 == 0, few).alias("keywords_absent"), F.when(i % 3 != 0, F.array(F.lit("e"))).alias("keywords_present"),
        F.when(i % 5 != 0, (i % 5 * 1000000).cast("long")).alias("min_us"), F.when(i % 4 == 0, F.lit(60000000)).alias("max_us"),
    )
    placed = I.point_join(D.words(spark, sf_dir), I.twice_mid() / 2, I.bucketed(tl, None, None, "out_frame"), I.mid_inside(), "inner")
    moved = F.col("out_frame") * F.lit(1000000.0) / 30 - F.col("_start")
    words = placed.select("asset_id", "word_idx", "word", (F.col("start_us") + moved).alias("start_us"), (F.col("end_us") + moved).alias("end_us"))
    at = lambda k: F.floor(k * F.col("total_us") / 8)
    frames = a18_frame_rms(spark, sf_dir).join(assets, "asset_id").select("asset_id", at(F.col("frame_idx")).alias("start_us"), at(F.col("frame_idx") + 1).alias("end_us"), "rms")
    return items, words, frames, assets


_CHECKED = _TIMELINE + "," + _SIGNALS + """,
lens AS (SELECT asset_id, CAST(floor(sum(n_frames) * 1000000 / 30) AS BIGINT) AS total_us, CAST(sum(end_us - start_us) AS BIGINT) AS edl_us FROM tl2 GROUP BY 1),
it AS (SELECT t.asset_id, seg_id AS item_id, ['keyword_absent', 'keyword_present', 'last_word_complete', 'duration_check', 'edl_duration_check', 'audio_content_check', 'other'][CAST(seg_id % 7 AS INTEGER) + 1] AS method,
  CASE WHEN seg_id % 11 <> 0 THEN CAST(floor(out_frame * 1000000 / 30) AS BIGINT) END AS ws, CASE WHEN seg_id % 11 <> 0 THEN CAST(floor((out_frame + n_frames) * 1000000 / 30) AS BIGINT) END AS we,
  CASE WHEN seg_id % 2 = 0 THEN ['the', 'que', 'die'] ELSE [] END AS ka, CASE WHEN seg_id % 3 <> 0 THEN ['e'] ELSE [] END AS kp, CASE WHEN seg_id % 5 <> 0 THEN seg_id % 5 * 1000000 END AS mn, CASE WHEN seg_id % 4 = 0 THEN 60000000 END AS mx, total_us, edl_us
  FROM tl2 t JOIN lens l ON l.asset_id = t.asset_id),
iw AS (SELECT *, CASE WHEN method = 'last_word_complete' THEN greatest(total_us - coalesce(mn, 4000000), 0) ELSE ws END AS lo, CASE WHEN method = 'last_word_complete' THEN total_us ELSE we END AS hi FROM it),
sp AS (SELECT * FROM iw WHERE lo IS NOT NULL AND method IN ('keyword_absent', 'keyword_present', 'last_word_complete', 'audio_content_check')),
ow AS (SELECT w.asset_id, w.word_idx, w.word, w.start_us + (t.out_frame * 1000000.0 / 30 - t.start_us) AS s, w.end_us + (t.out_frame * 1000000.0 / 30 - t.start_us) AS e FROM words w JOIN tl2 t ON t.asset_id = w.asset_id
  AND w.start_us + w.end_us >= 2 * t.start_us AND w.start_us + w.end_us < 2 * t.end_us),
tx AS (SELECT sp.asset_id, item_id, string_agg(lower(word), ' ' ORDER BY word_idx) AS t FROM sp JOIN ow ON ow.asset_id = sp.asset_id AND ow.s + ow.e >= 2 * lo AND ow.s + ow.e < 2 * hi GROUP BY 1, 2),
fm AS (SELECT fr.asset_id, floor(frame_idx * total_us / 8) AS s, floor((frame_idx + 1) * total_us / 8) AS e, round(rms, 9) AS rms FROM fr JOIN lens ON lens.asset_id = fr.asset_id),
ld AS (SELECT sp.asset_id, item_id, max(rms) AS rms FROM sp JOIN fm ON fm.asset_id = sp.asset_id AND fm.s < hi AND lo < fm.e GROUP BY 1, 2),
jo AS (SELECT iw.*, ld.rms, lo IS NOT NULL AS win, coalesce(ld.rms, 0) < 0.005 AS silent, list_filter(kp, lambda k: NOT contains(coalesce(t, ''), k)) AS lost, list_filter(ka, lambda k: contains(coalesce(t, ''), k)) AS heard
  FROM iw LEFT JOIN tx ON tx.asset_id = iw.asset_id AND tx.item_id = iw.item_id LEFT JOIN ld ON ld.asset_id = iw.asset_id AND ld.item_id = iw.item_id),
chk AS (SELECT asset_id, item_id, method, rms, CASE
  WHEN method = 'keyword_absent' THEN CASE WHEN NOT win THEN 'SKIP' WHEN len(ka) = 0 AND len(kp) > 0 THEN CASE WHEN len(lost) = 0 THEN 'PASS' ELSE 'FAIL' END WHEN len(ka) = 0 THEN CASE WHEN silent THEN 'FAIL' ELSE 'PASS' END WHEN silent OR len(heard) > 0 THEN 'FAIL' ELSE 'PASS' END
  WHEN method = 'keyword_present' THEN CASE WHEN NOT win THEN 'SKIP' WHEN silent OR len(lost) > 0 THEN 'FAIL' ELSE 'PASS' END
  WHEN method = 'last_word_complete' THEN CASE WHEN silent OR len(lost) > 0 THEN 'FAIL' ELSE 'PASS' END
  WHEN method = 'duration_check' THEN CASE WHEN total_us BETWEEN coalesce(mn, 0) AND coalesce(mx, 9999000000) THEN 'PASS' ELSE 'FAIL' END
  WHEN method = 'edl_duration_check' THEN CASE WHEN abs(total_us - edl_us) > 300000 THEN 'FAIL' ELSE 'PASS' END
  WHEN method = 'audio_content_check' THEN CASE WHEN NOT win THEN 'SKIP' WHEN silent THEN 'FAIL' ELSE 'PASS' END ELSE 'SKIP' END AS status,
  CASE WHEN win AND (method IN ('keyword_present', 'last_word_complete') AND NOT silent OR method = 'keyword_absent' AND len(ka) = 0 AND len(kp) > 0) THEN array_to_string(lost, ',') END AS missing,
  CASE WHEN win AND method = 'keyword_absent' AND len(ka) > 0 AND NOT silent THEN array_to_string(heard, ',') END AS found FROM jo)"""


@query(select(SEGMENTS + _CHECKED, "SELECT * FROM chk"))
def v6_output_checks(spark, sf_dir):
    """V5, V6: the status of every item on the output's words and loudness, with the keywords missing and found."""
    return C.check_items(*output_items(spark, sf_dir)).withColumns({k: F.array_join(k, ",") for k in ("missing", "found")})


@query(select(SEGMENTS + _CHECKED + """,
cn AS (SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS f, count(*) FILTER (WHERE status = 'SKIP') AS skipped, count(*) FILTER (WHERE status = 'ERROR') AS errored FROM chk GROUP BY 1)""", """
SELECT l.asset_id, total, passed, f + CASE WHEN abs(total_us - edl_us) > 300000 THEN 1 ELSE 0 END AS failed, skipped, errored, abs(total_us - edl_us) > 300000 AS edl_differs,
  CASE WHEN f = 0 AND errored = 0 AND NOT abs(total_us - edl_us) > 300000 THEN 'PASS' ELSE 'FAIL' END AS overall FROM lens l JOIN cn ON cn.asset_id = l.asset_id"""))
def a13_output_summary(spark, sf_dir):
    """Counts by status, the check of the length, and the verdict."""
    items, words, frames, assets = output_items(spark, sf_dir)
    return C.summary(C.check_items(items, words, frames, assets), assets)


_INSERTS = """,
ins AS (SELECT asset_id, seg_id, 'i' || (seg_id // 5 % 7) AS id, ['title', 'quote', 'chart', 'list', 'nothing'][CAST(seg_id // 5 % 5 AS INTEGER) + 1] AS template, CASE WHEN seg_id % 3 = 0 THEN 'full' ELSE 'lower' END AS placement,
  start_us, CASE WHEN seg_id % 35 = 0 THEN start_us ELSE end_us + 2000000 END AS end_us, CASE WHEN seg_id % 2 = 0 THEN '{"text":"x","bars":[]}' ELSE '{"text":"y","bars":[1,2]}' END AS vars FROM segments),
i2 AS (SELECT *, count(*) OVER (PARTITION BY asset_id, id) AS same, sum(CASE WHEN placement = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id) AS fulls, lead(start_us) OVER (PARTITION BY asset_id ORDER BY start_us, seg_id) AS nx,
  start_us - lag(start_us) OVER (PARTITION BY asset_id ORDER BY start_us, seg_id) AS since FROM ins)"""


def inserts(spark, sf_dir) -> DataFrame:
    s, i = segments(spark, sf_dir), F.col("seg_id")
    fifth = F.floor(i / 5)
    return s.select(
        "asset_id", "seg_id", F.concat(F.lit("i"), (fifth % 7).cast("string")).alias("id"),
        F.get(F.array(*map(F.lit, ("title", "quote", "chart", "list", "nothing"))), (fifth % 5).cast("int")).alias("template"), F.when(i % 3 == 0, "full").otherwise("lower").alias("placement"),
        "start_us", F.when(i % 35 == 0, F.col("start_us")).otherwise(F.col("end_us") + 2000000).alias("end_us"), F.when(i % 2 == 0, '{"text":"x","bars":[]}').otherwise('{"text":"y","bars":[1,2]}').alias("vars"),
    )


@query(select(SEGMENTS + _INSERTS, """
SELECT asset_id, seg_id, array_to_string(list_filter([CASE WHEN template = 'nothing' THEN 'template' END, CASE WHEN end_us <= start_us THEN 'times' END,
  CASE WHEN template = 'chart' AND json_array_length(vars, '$.bars') = 0 THEN 'bars' END, CASE WHEN same > 1 THEN 'duplicate id' END, CASE WHEN fulls > 2 AND placement = 'full' THEN 'too many full' END,
  CASE WHEN nx < end_us THEN 'overlap' END, CASE WHEN since < 30000000 THEN 'dense' END], lambda x: x IS NOT NULL), ',') AS errors FROM i2"""))
def v1_insert_errors(spark, sf_dir):
    """What is wrong with inserts: template, times, missing bars, ids, counts, overlap, density."""
    w = Window.partitionBy("asset_id").orderBy("start_us", "seg_id")
    i = inserts(spark, sf_dir).withColumns({
        "same": F.count("*").over(Window.partitionBy("asset_id", "id")), "fulls": F.sum(F.when(F.col("placement") == "full", 1).otherwise(0)).over(Window.partitionBy("asset_id")),
        "nx": F.lead("start_us").over(w), "since": F.col("start_us") - F.lag("start_us").over(w),
    })
    bars = F.json_array_length(F.get_json_object("vars", "$.bars"))
    errors = F.array_compact(F.array(
        F.when(~F.col("template").isin("title", "quote", "chart", "list"), "template"), F.when(F.col("end_us") <= F.col("start_us"), "times"), F.when((F.col("template") == "chart") & (F.coalesce(bars, F.lit(0)) == 0), "bars"),
        F.when(F.col("same") > 1, "duplicate id"), F.when((F.col("fulls") > 2) & (F.col("placement") == "full"), "too many full"), F.when(F.col("nx") < F.col("end_us"), "overlap"), F.when(F.col("since") < 30000000, "dense"),
    ))
    return i.select("asset_id", "seg_id", F.array_join(errors, ",").alias("errors"))


_OVERLAYS = """,
ov AS (SELECT asset_id, seg_id // 7 * 7 + CASE WHEN seg_id % 7 > 4 THEN 4 ELSE seg_id % 7 END AS id, ['topbar', 'stat', 'chart', 'fullscreen', 'badge'][seg_id % 5 + 1] AS template, CASE WHEN seg_id % 4 = 3 THEN 'full' WHEN seg_id % 19 = 0 THEN 'left' ELSE 'upper' END AS placement,
  CASE seg_id % 6 WHEN 0 THEN 'swiss' WHEN 1 THEN 'neon' WHEN 2 THEN 'kinetic' END AS theme, start_us, CASE WHEN seg_id % 13 = 0 THEN start_us ELSE end_us + 300000 END AS end_us,
  CASE seg_id % 3 WHEN 0 THEN '{"title":"a","number":1,"eyebrow":"e","bars":[]}' WHEN 1 THEN '{"number":1,"label":"l","bars":[1],"eyebrow":"e"}' ELSE '{"lines":["a"],"bars":"b"}' END AS vars FROM segments),
o2 AS (SELECT *, row_number() OVER (PARTITION BY asset_id, id ORDER BY start_us, end_us) AS place, lead(start_us) OVER (PARTITION BY asset_id ORDER BY start_us, end_us, id) AS nx, json_keys(vars) AS ks FROM ov),
oe AS (SELECT asset_id, id, unnest(list_filter([CASE WHEN place > 1 THEN 'duplicate id' END, CASE WHEN template = 'badge' THEN 'template' END, CASE WHEN placement = 'left' THEN 'placement' END, CASE WHEN theme = 'neon' THEN 'theme' END,
  CASE WHEN end_us <= start_us THEN 'times' END, CASE WHEN template = 'chart' AND coalesce(json_array_length(vars, '$.bars'), 0) = 0 THEN 'bars' END, CASE WHEN nx < end_us THEN 'overlap' END,
  CASE WHEN template IN ('topbar', 'stat', 'chart') AND placement <> 'upper' OR template = 'fullscreen' AND placement <> 'full' THEN 'placement of ' || template END,
  CASE WHEN template = 'topbar' AND NOT list_contains(ks, 'title') THEN 'no title' END, CASE WHEN template = 'stat' AND NOT list_contains(ks, 'number') THEN 'no number' END,
  CASE WHEN template = 'stat' AND NOT list_contains(ks, 'label') THEN 'no label' END, CASE WHEN template = 'chart' AND NOT list_contains(ks, 'eyebrow') THEN 'no eyebrow' END,
  CASE WHEN template = 'chart' AND NOT list_contains(ks, 'bars') THEN 'no bars' END, CASE WHEN template = 'fullscreen' AND NOT list_contains(ks, 'lines') THEN 'no lines' END], lambda x: x IS NOT NULL)) AS error FROM o2
  UNION ALL SELECT asset_id, NULL, 'too many fullscreen' FROM ov GROUP BY asset_id HAVING count(*) FILTER (WHERE template = 'fullscreen') > 2)"""


def overlays(spark, sf_dir) -> DataFrame:
    i, pick = F.col("seg_id"), lambda *v: F.array(*map(F.lit, v))
    return segments(spark, sf_dir).select(
        "asset_id", (F.floor(i / 7) * 7 + F.least(i % 7, F.lit(4))).cast("int").alias("id"), F.get(pick("topbar", "stat", "chart", "fullscreen", "badge"), i % 5).alias("template"),
        F.when(i % 4 == 3, "full").when(i % 19 == 0, "left").otherwise("upper").alias("placement"), F.get(pick("swiss", "neon", "kinetic"), i % 6).alias("theme"),
        "start_us", F.when(i % 13 == 0, F.col("start_us")).otherwise(F.col("end_us") + 300000).alias("end_us"),
        F.get(pick('{"title":"a","number":1,"eyebrow":"e","bars":[]}', '{"number":1,"label":"l","bars":[1],"eyebrow":"e"}', '{"lines":["a"],"bars":"b"}'), i % 3).alias("vars"),
    )


@query(select(SEGMENTS + _OVERLAYS, "SELECT asset_id, CAST(id AS INTEGER) AS id, error FROM oe"))
def v1_overlay_errors(spark, sf_dir):
    """V1: every rule of an overlay table, an insert for each segment."""
    return C.overlay_errors(overlays(spark, sf_dir))


@query(select(SEGMENTS + """,
made AS (SELECT asset_id, seg_id, 'made ' || n_words AS text, start_us, end_us FROM segments),
byhand AS (SELECT asset_id, seg_id + CASE WHEN seg_id % 8 = 0 THEN 5000 ELSE 0 END AS seg_id, 'by hand' AS text, start_us + 100000 AS start_us, end_us FROM segments WHERE seg_id % 4 = 0)""", """
SELECT coalesce(k.asset_id, m.asset_id) AS asset_id, coalesce(k.seg_id, m.seg_id) AS seg_id, coalesce(k.text, m.text) AS text, coalesce(k.start_us, m.start_us) AS start_us, coalesce(k.end_us, m.end_us) AS end_us, k.asset_id IS NOT NULL AS edited
FROM made m FULL JOIN byhand k ON k.asset_id = m.asset_id AND k.seg_id = m.seg_id"""))
def v2_edited_inserts(spark, sf_dir):
    """V2: a rerun's inserts don't take the place of those edited by hand."""
    s, i = segments(spark, sf_dir), F.col("seg_id")
    made = s.select("asset_id", "seg_id", F.concat(F.lit("made "), F.col("n_words").cast("string")).alias("text"), "start_us", "end_us")
    hand = s.filter("seg_id % 4 = 0").select("asset_id", (i + F.when(i % 8 == 0, 5000).otherwise(0)).alias("seg_id"), F.lit("by hand").alias("text"), (F.col("start_us") + 100000).alias("start_us"), "end_us")
    return E.keep_edited(made, hand, ["asset_id", "seg_id"])


_SCENES = """,
scenes AS (SELECT asset_id, seg_id, start_us, end_us, seg_id % 9 AS component, seg_id % 23 = 0 AS flash, lag(end_us) OVER (PARTITION BY asset_id ORDER BY seg_id) AS before FROM segments)"""


@query(select(SEGMENTS + _SCENES, """
SELECT s.asset_id, count(*) AS n_scenes, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, count(*) FILTER (WHERE flash) AS flashes, count(*) FILTER (WHERE before IS NOT NULL AND before <> start_us) AS breaks,
  any_value(c.most) AS most_used, any_value(c.most) >= 4 AS overused, count(*) * 60000000.0 / max(end_us) AS shots_per_minute,
  CASE WHEN count(*) * 60000000.0 / max(end_us) >= 30 THEN 'hook' WHEN count(*) * 60000000.0 / max(end_us) >= 12 THEN 'tutorial' ELSE 'documentary' END AS pace
FROM scenes s JOIN (SELECT asset_id, max(n) AS most FROM (SELECT asset_id, component, count(*) AS n FROM scenes GROUP BY 1, 2) GROUP BY 1) c ON c.asset_id = s.asset_id GROUP BY 1"""))
def v7_storyboard_checks(spark, sf_dir):
    """V7, V8 in part: totals, flashes, breaks, overused components and pace of storyboards; all rules are in
    v7_storyboard_verdicts."""
    s = segments(spark, sf_dir).select("asset_id", "seg_id", "start_us", "end_us", (F.col("seg_id") % 9).alias("component"), (F.col("seg_id") % 23 == 0).alias("flash"), F.lag("end_us").over(Window.partitionBy("asset_id").orderBy("seg_id")).alias("before"))
    most = s.groupBy("asset_id", "component").count().groupBy("asset_id").agg(F.max("count").alias("most_used"))
    rate = F.count("*") * F.lit(60000000.0) / F.max("end_us")
    g = s.groupBy("asset_id").agg(
        F.count("*").alias("n_scenes"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"), F.count_if("flash").alias("flashes"), F.count_if(F.col("before") != F.col("start_us")).alias("breaks"),
        rate.alias("shots_per_minute"), F.when(rate >= 30, "hook").when(rate >= 12, "tutorial").otherwise("documentary").alias("pace"),
    )
    return g.join(most, "asset_id").withColumn("overused", F.col("most_used") >= 4)


@query(select(SEGMENTS + _TIMELINE + """,
sc AS (SELECT asset_id, seg_id AS scene_id, CAST(floor(out_frame * 1000000 / 30) AS BIGINT) AS start_us, CAST(floor((out_frame + n_frames) * 1000000 / 30) AS BIGINT) AS end_us, seg_id % 9 AS component,
  CASE WHEN seg_id % 13 = 1 THEN 'hook' WHEN seg_id % 7 = 0 THEN 'bridge' ELSE 'scene' END AS kind, CASE WHEN seg_id % 20 = 0 THEN 'big' WHEN seg_id % 7 = 3 THEN 'soft' ELSE 'hard' END AS cut, seg_id % 23 = 0 AS flash, length(text) AS nc FROM tl2),
sx AS (SELECT *, end_us - start_us AS dur, lag(end_us) OVER (PARTITION BY asset_id ORDER BY scene_id) AS before,
  CASE WHEN flash THEN start_us - max(CASE WHEN flash THEN start_us END) OVER (PARTITION BY asset_id ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS since FROM sc),
mo AS (SELECT asset_id, max(n) AS most_used FROM (SELECT asset_id, component, count(*) AS n FROM sc GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT asset_id, count(*) AS n_scenes, CAST(sum(dur) AS BIGINT) AS total_us, avg(dur) AS mean_us, arg_min(dur, scene_id) AS first_us, count(*) FILTER (WHERE flash) AS n_flashes, min(since) AS flash_gap_us, count(*) FILTER (WHERE kind = 'bridge') AS n_bridges,
  count(*) FILTER (WHERE kind = 'hook' AND start_us <= 3000000) AS hooks, count(*) FILTER (WHERE cut = 'hard') AS n_hard, count(*) FILTER (WHERE cut = 'soft') AS n_soft, count(*) FILTER (WHERE cut = 'big') AS n_big,
  CAST(sum(nc) AS BIGINT) AS n_chars, count(*) FILTER (WHERE before <> start_us) AS n_breaks FROM sx GROUP BY 1),
bd(pace, k, b0, b1, b2, b3, b4) AS (VALUES ('hook', 0, 2000000, 30, 60, 800000, 2000000), ('tutorial', 1, 5000000, 15, 30, 2000000, 5000000), ('documentary', 2, 8000000, 8, 15, 3000000, 8000000))""", """
SELECT g.* EXCLUDE (hooks), most_used, total_us + g.asset_id % 5 * 200000 AS target_us, pace, abs(g.asset_id % 5 * 200000) <= 500000 AS length_ok, first_us <= b0 AS first_ok, n_flashes <= 2 AND coalesce(flash_gap_us, 8000000) >= 8000000 AS flashes_ok,
  most_used < 4 AS components_ok, n_bridges * 100 <= n_scenes * 15 AS bridges_ok, hooks > 0 AS hook_ok, n_soft * 100 <= (n_hard + n_soft + n_big) * 15 AND n_big * 100 <= (n_hard + n_soft + n_big) * 5 AS cuts_ok,
  n_chars * 1000000 BETWEEN 3 * total_us AND 4 * total_us AS narration_ok, n_breaks = 0 AS contiguous_ok, n_scenes * 60000000 BETWEEN b1 * total_us AND b2 * total_us AS shots_ok, mean_us BETWEEN b3 AND b4 AS mean_ok, n_scenes * 60000000.0 / total_us AS shots_per_minute
FROM g JOIN mo ON mo.asset_id = g.asset_id JOIN bd ON k = g.asset_id % 3"""))
def v7_storyboard_verdicts(spark, sf_dir):
    """All rules of a storyboard, whose scenes are the segments on the output's time."""
    i, us = F.col("seg_id"), lambda n: F.floor(n * F.lit(1000000) / 30)
    scenes = E.output_timeline(segments(spark, sf_dir)).select(
        "asset_id", i.alias("scene_id"), us(F.col("out_frame")).alias("start_us"), us(F.col("out_frame") + F.col("n_frames")).alias("end_us"), (i % 9).alias("component"),
        F.when(i % 13 == 1, "hook").when(i % 7 == 0, "bridge").otherwise("scene").alias("kind"), F.when(i % 20 == 0, "big").when(i % 7 == 3, "soft").otherwise("hard").alias("cut"),
        (i % 23 == 0).alias("flash"), F.length("text").alias("n_chars"),
    )
    a = F.col("asset_id")
    specs = scenes.groupBy("asset_id").agg((F.sum(F.col("end_us") - F.col("start_us")) + a % 5 * 200000).alias("target_us")).withColumn("pace", F.get(F.array(*map(F.lit, C.PACES)), (a % 3).cast("int")))
    return C.storyboard(scenes, specs)


@query(select(SEGMENTS, """SELECT asset_id, seg_id % 9 AS component, count(*) AS n FROM segments WHERE seg_id % 9 NOT IN (0, 1, 2, 3, 4, 5) GROUP BY 1, 2"""))
def j21_unknown_components(spark, sf_dir):
    """Components that stand in no catalog."""
    catalog = spark.range(6).select(F.col("id").cast("int").alias("component"))
    s = segments(spark, sf_dir).select("asset_id", (F.col("seg_id") % 9).alias("component"))
    return s.join(F.broadcast(catalog), "component", "left_anti").groupBy("asset_id", "component").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, text FROM documents), t(term, wrong) AS (VALUES ('the', 'teh'), ('que', 'qeu'), ('ein', 'eni'))
SELECT doc_id, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n_term, (length(text) - length(replace(text, wrong, ''))) // length(wrong) AS n_wrong, contains(text, term) AS found FROM d, t""")
def a17_terms(spark, sf_dir):
    """Expected terms and their known wrong forms in every text."""
    d = D.read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("wrong")) for a, b in (("the", "teh"), ("que", "qeu"), ("ein", "eni"))])).alias("t"))
    n = lambda c: F.floor((F.length("text") - F.length(F.replace("text", c, F.lit("")))) / F.length(c))
    return d.select("doc_id", "t.term", n(F.col("t.term")).alias("n_term"), n(F.col("t.wrong")).alias("n_wrong"), F.contains("text", F.col("t.term")).alias("found"))


@query(select(WORDS, """
SELECT asset_id, count(*) AS n, avg(d) AS mean_us, median(d) AS median_us, 100.0 * count(*) FILTER (WHERE d < 100000) / count(*) AS pass_share FROM (
  SELECT a.asset_id, a.word_idx, min(abs(a.start_us - b.start_us)) AS d FROM words a JOIN words b ON b.asset_id = a.asset_id AND b.word = a.word AND b.conf_milli > 850 AND b.word_idx <> a.word_idx
  WHERE a.conf_milli > 850 GROUP BY 1, 2) GROUP BY 1"""))
def j18_timestamp_differences(spark, sf_dir):
    """The nearest other confident saying of each confident word, and how far it is.

    Nearest by neighbours in time order of the same word, so a frequent word costs no pairs."""
    w = D.words(spark, sf_dir).filter("conf_milli > 850")
    o = Window.partitionBy("asset_id", "word").orderBy("start_us")
    d = F.least(F.col("start_us") - F.lag("start_us").over(o), F.lead("start_us").over(o) - F.col("start_us"))
    w = w.withColumn("d", d).filter("d is not null")
    return w.groupBy("asset_id").agg(F.count("*").alias("n"), F.avg("d").alias("mean_us"), F.median("d").alias("median_us"), (F.lit(100.0) * F.count_if(F.col("d") < 100000) / F.count("*")).alias("pass_share"))


@query(select(WORDS, """
SELECT asset_id, CAST(sum(end_us - start_us) AS BIGINT) AS busy_us, count(*) AS n_words, sum(end_us - start_us) * 1.0 / greatest(max(end_us), 10000) AS real_time_factor FROM words GROUP BY 1"""))
def a16_throughput(spark, sf_dir):
    """Summed time, words and real-time factor."""
    return D.words(spark, sf_dir).groupBy("asset_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("busy_us"), F.count("*").alias("n_words"), (F.sum(F.col("end_us") - F.col("start_us")) * F.lit(1.0) / F.greatest(F.max("end_us"), F.lit(10000))).alias("real_time_factor"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), d AS (SELECT doc_id, max(length(text)) > 1000 AS p FROM documents GROUP BY 1),
m AS (SELECT coalesce(p, false) AS p, coalesce(q = 1, false) AS q FROM l FULL JOIN d ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (WHERE p AND q) AS tp, count(*) FILTER (WHERE p AND NOT q) AS fp, count(*) FILTER (WHERE NOT p AND q) AS fn, count(*) FILTER (WHERE NOT p AND NOT q) AS tn,
 count(*) FILTER (WHERE p AND q) * 1.0 / nullif(count(*) FILTER (WHERE p), 0) AS prec, count(*) FILTER (WHERE p AND q) * 1.0 / nullif(count(*) FILTER (WHERE q), 0) AS recall FROM m""")
def a11_detector_quality(spark, sf_dir):
    """Confusion counts, precision and recall of a detector against labels."""
    l = D.read(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("q"))  # noqa: E741
    d = D.read(spark, sf_dir, "documents").groupBy("doc_id").agg((F.max(F.length("text")) > 1000).alias("p"))
    m = l.join(d, "doc_id", "full").select(F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("q", F.lit(False)).alias("q"))
    p, q = F.col("p"), F.col("q")
    n = lambda c: F.count_if(c)
    safe = lambda a, b: F.try_divide(n(a) * F.lit(1.0), n(b))
    return m.agg(n(p & q).alias("tp"), n(p & ~q).alias("fp"), n(~p & q).alias("fn"), n(~p & ~q).alias("tn"), safe(p & q, p).alias("prec"), safe(p & q, q).alias("recall"))


@query(select(SEGMENTS, """
SELECT asset_id, seg_id, lag_us, dist, abs(lag_us) < 40000 AS lag_pass, dist < 10 AS hash_pass, abs(lag_us) < 40000 AND dist < 10 AS seg_pass FROM (SELECT asset_id, seg_id, (seg_id * 17 % 100 - 50) * 1000 AS lag_us, seg_id * 7 % 13 AS dist FROM segments)"""))
def v9_sync_verdicts(spark, sf_dir):
    """V9: lag under 40 ms and hash distance under 10."""
    s = segments(spark, sf_dir).select("asset_id", "seg_id", ((F.col("seg_id") * 17 % 100 - 50) * 1000).alias("lag_us"), (F.col("seg_id") * 7 % 13).alias("dist"))
    a, b = F.abs("lag_us") < 40000, F.col("dist") < 10
    return s.select("*", a.alias("lag_pass"), b.alias("hash_pass"), (a & b).alias("seg_pass"))


@query(r"""WITH e AS (SELECT item_id, unnest(string_split(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), chr(1))) AS s FROM benchmark), s AS (SELECT item_id, trim(s) AS s FROM e WHERE length(trim(s)) >= 4),
d AS (SELECT DISTINCT item_id, s FROM s) SELECT item_id, s AS sentence FROM d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE contains(x.text, d.s))""")
def j17_absent_sentences(spark, sf_dir):
    """Script sentences that no text holds.

    Sentences meet texts on their words at sentence ends: candidates by the sentence itself, cut out of each text."""
    s = D.sentences(spark, sf_dir).select("item_id", F.col("text").alias("sentence")).distinct()
    texts = D.read(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    # A sentence ends in one mark and holds no other, so it lies at the end of a piece of the text cut after marks.
    cut = texts.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"([.!?])", "$1\u0001"), "\u0001")).alias("pos", "p")).filter(F.length("p") >= 4)
    closed = F.col("sentence").rlike(r"[.!?]$")

    def ended(least: int, most: int, n: int) -> DataFrame:
        """Sentences of least to most characters by their last n, which few pieces share."""
        own = s.filter(closed & F.length("sentence").between(least, most)).withColumn("key", F.expr(f"right(sentence, {n})"))
        near = cut.select("p", F.expr(f"right(p, {n})").alias("key")).join(own.select("key").distinct(), "key", "left_semi")
        return own.join(near, "key").filter(F.expr("endswith(p, sentence)")).select("item_id", "sentence")

    whole = ended(16, 1 << 30, 16).union(ended(8, 15, 8)).union(ended(4, 7, 4))
    # Sentences without a mark at their end may stand anywhere in a piece; there are few, one an item at most.  Only places
    # move to be found; the pieces themselves come in for those that share a gram.
    open_ended = s.filter(~closed).withColumn("key", F.substring("sentence", 1, 4))
    grams = cut.select("doc_id", "pos", F.explode(F.array_distinct(T.char_ngrams(F.col("p"), 4))).alias("key")).join(open_ended.select("key").distinct(), "key", "left_semi")
    places = open_ended.join(grams, "key").select("item_id", "sentence", "doc_id", "pos")
    inside = places.join(cut, ["doc_id", "pos"]).filter(F.contains("p", F.col("sentence"))).select("item_id", "sentence")
    return s.join(whole.union(inside).distinct(), ["item_id", "sentence"], "left_anti")
