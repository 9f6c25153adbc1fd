"""Queries on edit decisions, cuts and cues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions import text as T
from cutloom.operators import edl as E
from cutloom.operators import intervals as I
from cutloom.operators import segment as S
from cutloom.plans.sql import KEPT, SEGMENTS, select
from cutloom.plans.words import _hms, points, segments
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


EDL = SEGMENTS + """,
edl AS (SELECT asset_id, seg_id, start_us, end_us, true AS keep, 'rule' AS decided_by FROM segments
  UNION ALL SELECT asset_id, CAST(100000 + row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us) AS INTEGER), start_us, end_us, false, CASE reason WHEN 'reviewer' THEN 'llm' ELSE 'rule' END FROM drops)"""


def edl(spark, sf_dir) -> DataFrame:
    s = segments(spark, sf_dir).select("asset_id", "seg_id", "start_us", "end_us", F.lit(True).alias("keep"), F.lit("rule").alias("decided_by"))
    number = (F.lit(100000) + F.row_number().over(Window.partitionBy("asset_id").orderBy("start_us", "end_us"))).cast("int")
    d = D.drops(D.words(spark, sf_dir))
    return s.union(d.select("asset_id", number, "start_us", "end_us", F.lit(False), F.when(F.col("reason") == "reviewer", "llm").otherwise("rule")))


@query(select(EDL, """
SELECT asset_id, decided_by, keep, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS dur_us, grouping(asset_id, decided_by, keep) AS level
FROM edl GROUP BY ROLLUP (asset_id, decided_by, keep)"""))
def a3_edl_totals(spark, sf_dir):
    """A3: counts and durations by asset, decider and decision, and their totals, in one pass."""
    r = edl(spark, sf_dir).rollup("asset_id", "decided_by", "keep")
    return r.agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("dur_us"), F.grouping_id().alias("level"))


@query(select(SEGMENTS, """
SELECT a.asset_id, a.dur AS source_us, coalesce(k.keep_us, 0) AS keep_us, coalesce(k.keep_us, 0) * 1.0 / a.dur AS ratio, 100.0 * (a.dur - coalesce(k.keep_us, 0)) / a.dur AS reduction,
  abs(coalesce(k.keep_us, 0) - fr * 1000000 / 30.0) > 500000 AS differs
FROM (SELECT asset_id, max(end_us) AS dur FROM words GROUP BY 1) a LEFT JOIN
 (SELECT asset_id, CAST(sum(end_us - start_us) AS BIGINT) AS keep_us, sum(greatest(1, round_even((end_us - start_us) * 30 / 1000000.0, 0))) AS fr FROM segments GROUP BY 1) k ON k.asset_id = a.asset_id"""))
def a4_compression(spark, sf_dir):
    """A4: how much of each asset is kept, and whether the output's length differs from the decisions' by over 0.5 s."""
    k = segments(spark, sf_dir).groupBy("asset_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("k"), F.sum(E.frames(F.col("end_us") - F.col("start_us"))).alias("fr"))
    a = D.words(spark, sf_dir).groupBy("asset_id").agg(F.max("end_us").alias("source_us")).join(k, "asset_id", "left").withColumn("keep_us", F.coalesce("k", F.lit(0)))
    return a.select(
        "asset_id", "source_us", "keep_us", (F.col("keep_us") * F.lit(1.0) / F.col("source_us")).alias("ratio"),
        (F.lit(100.0) * (F.col("source_us") - F.col("keep_us")) / F.col("source_us")).alias("reduction"),
        (F.abs(F.col("keep_us") - F.col("fr") * 1000000 / F.lit(30.0)) > 500000).alias("differs"),
    )


_HUMAN = """,
human AS (SELECT s.asset_id, s.seg_id + CASE WHEN s.seg_id % 9 = 0 THEN 200000 ELSE 0 END AS seg_id, l.toxic = 0 AS keep FROM segments s
  JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = s.asset_id WHERE s.seg_id % 3 = 0)"""


@query(select(EDL + _HUMAN, """
SELECT coalesce(b.asset_id, h.asset_id) AS asset_id, coalesce(b.seg_id, h.seg_id) AS seg_id, start_us, end_us, coalesce(h.keep, b.keep) AS keep,
  CASE WHEN h.asset_id IS NOT NULL THEN 'human' ELSE decided_by END AS decided_by, b.asset_id IS NULL AS orphan
FROM edl b FULL JOIN human h ON h.asset_id = b.asset_id AND h.seg_id = b.seg_id"""))
def j9_human_override(spark, sf_dir):
    """Human decisions replace those of the same id; ones without a base row are shown."""
    lab = D.read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("asset_id")).agg(F.max("toxic").alias("toxic"))
    h = segments(spark, sf_dir).filter("seg_id % 3 = 0").join(lab, "asset_id")
    h = h.select("asset_id", (F.col("seg_id") + F.when(F.col("seg_id") % 9 == 0, 200000).otherwise(0)).alias("seg_id"), (F.col("toxic") == 0).alias("keep"))
    return E.merge_human(edl(spark, sf_dir), h)


@query(select(EDL + """,
twice AS (SELECT * FROM edl UNION ALL SELECT asset_id, seg_id + 1000000, start_us, end_us, keep, 'self_dedup_rule' FROM edl WHERE seg_id % 2 = 0)""", """
SELECT asset_id, seg_id, start_us, end_us, keep, decided_by FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, keep, start_us, end_us ORDER BY decided_by, seg_id) AS n FROM twice) WHERE keep OR n = 1"""))
def u3_distinct_drops(spark, sf_dir):
    """Fences stacked, equal drop rows once."""
    e = edl(spark, sf_dir)
    return E.distinct_drops(e.union(e.filter("seg_id % 2 = 0").withColumns({"seg_id": F.col("seg_id") + 1000000, "decided_by": F.lit("self_dedup_rule")})))


def _subtracted(name: str, rows: str, drops: str, by: str) -> str:
    """SQL of J8: rows(asset_id, start_us, end_us, keep, reason, decided_by) less drops, as a table of this name."""
    return f""",
{name}_0 AS (SELECT *, max(end_us) OVER (PARTITION BY asset_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {drops} WHERE end_us > start_us),
{name}_1 AS (SELECT *, sum(CASE WHEN start_us > before + 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM {name}_0),
{name}_d AS (SELECT asset_id, min(start_us) AS ds, max(end_us) AS de, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS dr FROM {name}_1 GROUP BY asset_id, island),
{name}_r AS (SELECT DISTINCT asset_id, start_us, end_us, keep, reason, decided_by FROM {rows}),
{name}_p AS (SELECT r.*, ds, de, dr, ds <= start_us + 300000 AND de >= end_us - 300000 AS covers, lag(de) OVER w AS pe, lead(ds) OVER w IS NULL AS is_last FROM {name}_r r
  JOIN {name}_d d ON d.asset_id = r.asset_id AND de > start_us + 300000 AND ds < end_us - 300000 WINDOW w AS (PARTITION BY r.asset_id, start_us, end_us, keep, reason, decided_by ORDER BY ds)),
{name}_f AS (SELECT asset_id, ds, de, min(struct_pack(s := start_us, e := end_us)) AS f FROM {name}_p WHERE NOT covers GROUP BY 1, 2, 3),
{name} AS (SELECT * FROM {name}_r r WHERE NOT EXISTS (SELECT 1 FROM {name}_d d WHERE d.asset_id = r.asset_id AND de > start_us + 300000 AND ds < end_us - 300000)
  UNION ALL SELECT asset_id, start_us, end_us, false, 'killed: ' || dr, '{by}' FROM {name}_p WHERE covers
  UNION ALL SELECT asset_id, coalesce(pe, start_us), ds, true, reason, decided_by FROM {name}_p WHERE keep AND NOT covers AND ds - coalesce(pe, start_us) > 300000
  UNION ALL SELECT asset_id, de, end_us, true, reason, decided_by FROM {name}_p WHERE keep AND NOT covers AND is_last AND end_us - de > 300000
  UNION ALL SELECT d.asset_id, greatest(d.ds, f.s), least(d.de, f.e), false, dr, '{by}' FROM {name}_d d LEFT JOIN {name}_f g ON g.asset_id = d.asset_id AND g.ds = d.ds AND g.de = d.de)"""


_PAUSED = KEPT.split(",\nkept AS")[0] + """,
p1 AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY asset_id ORDER BY word_idx) >= 800000 THEN 1 ELSE 0 END AS cut FROM words),
p2 AS (SELECT *, sum(cut) OVER (PARTITION BY asset_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS island FROM p1),
paused AS (SELECT * FROM (SELECT asset_id, greatest(min(start_us) - 150000, 0) AS start_us, max(end_us) + 150000 AS end_us, true AS keep, '' AS reason, 'rule' AS decided_by FROM p2 GROUP BY asset_id, island) WHERE end_us - start_us >= 300000)"""


def paused(spark, sf_dir) -> DataFrame:
    s = S.pause_segments(D.words(spark, sf_dir))
    return s.select("asset_id", "start_us", "end_us", F.lit(True).alias("keep"), F.lit("").alias("reason"), F.lit("rule").alias("decided_by"))


@query(select(_PAUSED + _subtracted("j8", "paused", "drops", "llm"), "SELECT asset_id, start_us, end_us, keep, reason FROM j8"))
def j8_subtracted_drops(spark, sf_dir):
    """Windows taken away from pause segments of all words."""
    return E.subtract_drops(paused(spark, sf_dir), D.drops(D.words(spark, sf_dir))).drop("decided_by")


_FENCES = """,
first_fence AS (SELECT asset_id, start_us - 700000 AS start_us, end_us + 900000 AS end_us, 'retake' AS reason FROM drops WHERE reason = 'rule'),
second_fence AS (SELECT asset_id, start_us, end_us, 'reviewer' AS reason FROM drops WHERE reason = 'reviewer')"""


@query(select(_PAUSED + _FENCES + _subtracted("u1", "paused", "first_fence", "self_dedup_rule") + """,
once AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, keep, start_us, end_us ORDER BY decided_by) AS n FROM u1) WHERE keep OR n = 1)"""
    + _subtracted("u2", "once", "second_fence", "llm") + """,
stacked AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, keep, start_us, end_us ORDER BY decided_by) AS n FROM u2) WHERE keep OR n = 1)""", """
SELECT asset_id, start_us, end_us, keep, decided_by, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us, keep, decided_by, reason) - 1 AS INTEGER) AS seg_id FROM stacked"""))
def u2_three_fences(spark, sf_dir):
    """Pause segments under a fence of retakes and a reviewer's on top, numbered anew."""
    d = D.drops(D.words(spark, sf_dir))
    wide = d.filter("reason = 'rule'").select("asset_id", (F.col("start_us") - 700000).alias("start_us"), (F.col("end_us") + 900000).alias("end_us"), F.lit("retake").alias("reason"))
    return E.stack_fences(paused(spark, sf_dir), [(wide, "self_dedup_rule"), (d.filter("reason = 'reviewer'"), "llm")]).drop("reason")


@query(select(SEGMENTS + """,
runs AS (SELECT w.*, w.word_idx - row_number() OVER (PARTITION BY w.asset_id ORDER BY w.word_idx) AS run FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.asset_id = w.asset_id AND w.word_idx BETWEEN s.first_idx AND s.last_idx)),
adlib AS (SELECT asset_id, min(start_us) AS start_us, max(end_us) AS end_us FROM runs GROUP BY asset_id, run HAVING max(end_us) - min(start_us) >= 500000)""", """
SELECT asset_id, start_us, end_us, 'matched' AS kind FROM segments UNION ALL SELECT asset_id, start_us, end_us, 'adlib' FROM adlib"""))
def u1_all_intervals(spark, sf_dir):
    """Segments and the runs between them in one list."""
    s = segments(spark, sf_dir)
    runs = S.uncovered_runs(D.words(spark, sf_dir), s)
    return s.select("asset_id", "start_us", "end_us", F.lit("matched").alias("kind")).unionByName(runs.select("asset_id", "start_us", "end_us", F.lit("adlib").alias("kind")))


@query(select(SEGMENTS + """,
u AS (SELECT w.asset_id, w.start_us, w.end_us FROM words w WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.asset_id = w.asset_id AND w.word_idx BETWEEN s.first_idx AND s.last_idx))""", """
SELECT a.asset_id, coalesce(n, 0) AS n_uncovered, coalesce(d, 0) AS uncovered_us, coalesce(d, 0) * 1.0 / a.total AS share FROM (SELECT asset_id, sum(end_us - start_us) AS total FROM words GROUP BY 1) a
LEFT JOIN (SELECT asset_id, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS d FROM u GROUP BY 1) u ON u.asset_id = a.asset_id"""))
def a22_uncovered_share(spark, sf_dir):
    """Words outside all segments and their share of the speech."""
    w, s = D.words(spark, sf_dir), segments(spark, sf_dir)
    c = s.select("asset_id", F.explode(F.sequence("first_idx", "last_idx")).alias("word_idx"), F.lit(1).alias("c"))
    j = w.join(c, ["asset_id", "word_idx"], "left").groupBy("asset_id")
    dur = F.col("end_us") - F.col("start_us")
    out = j.agg(F.count_if(F.col("c").isNull()).alias("n_uncovered"), F.coalesce(F.sum(F.when(F.col("c").isNull(), dur)), F.lit(0)).alias("uncovered_us"), F.sum(dur).alias("total"))
    return out.select("asset_id", "n_uncovered", "uncovered_us", (F.col("uncovered_us") * F.lit(1.0) / F.col("total")).alias("share"))


_TIMELINE = """,
tl AS (SELECT *, greatest(1, CAST(round_even((end_us - start_us) * 30 / 1000000.0, 0) AS BIGINT)) AS n_frames FROM segments),
tl2 AS (SELECT *, CAST(coalesce(sum(n_frames) OVER (PARTITION BY asset_id ORDER BY start_us, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_frame FROM tl)"""


@query(select(SEGMENTS + _TIMELINE, "SELECT asset_id, seg_id, n_frames, out_frame FROM tl2"))
def w19_output_timeline(spark, sf_dir):
    """Where each segment starts in the output, in frames."""
    return E.output_timeline(segments(spark, sf_dir)).select("asset_id", "seg_id", "n_frames", "out_frame")


@query(select(SEGMENTS + _TIMELINE, """
SELECT w.asset_id, w.word_idx, t.seg_id, t.out_frame * 1000000.0 / 30 + (w.start_us - t.start_us) AS out_us FROM words w JOIN tl2 t ON t.asset_id = w.asset_id
  AND w.start_us + w.end_us >= 2 * t.start_us AND w.start_us + w.end_us < 2 * t.end_us"""))
def w20_output_words(spark, sf_dir):
    """Words on the output's time."""
    tl = E.output_timeline(segments(spark, sf_dir))
    twice = F.col("start_us") + F.col("end_us")
    inside = (twice >= 2 * F.col("_start")) & (twice < 2 * F.col("_end"))
    j = I.point_join(D.words(spark, sf_dir), twice / 2, I.bucketed(tl, None, None, "seg_id", "out_frame"), inside, "inner")
    return j.select("asset_id", "word_idx", "seg_id", (F.col("out_frame") * F.lit(1000000.0) / 30 + (F.col("start_us") - F.col("_start"))).alias("out_us"))


@query(select(SEGMENTS, """
SELECT asset_id, seg_id, place FROM (SELECT asset_id, seg_id, row_number() OVER (PARTITION BY asset_id ORDER BY seg_id) - 1 AS place, count(*) OVER (PARTITION BY asset_id) AS n FROM segments)
WHERE CASE WHEN n < 5 THEN true ELSE place IN (0, n // 4, n // 2, 3 * n // 4, n - 1) END"""))
def w21_checkpoints(spark, sf_dir):
    """Up to five cuts of an asset, spread over it."""
    w = Window.partitionBy("asset_id")
    s = segments(spark, sf_dir).select("asset_id", "seg_id", (F.row_number().over(w.orderBy("seg_id")) - 1).alias("place"), F.count("*").over(w).alias("n"))
    n, p = F.col("n"), F.col("place")
    spread = (p == 0) | (p == F.floor(n / 4)) | (p == F.floor(n / 2)) | (p == F.floor(3 * n / 4)) | (p == n - 1)
    return s.filter((n < 5) | spread).select("asset_id", "seg_id", p.cast("long").alias("place"))


_CUTS = """,
cuts AS (SELECT asset_id, seg_id, start_us + (seg_id * 37 % 500 - 250) * 1000 AS start_us, end_us + (seg_id * 91 % 900 - 250) * 1000 AS end_us FROM segments WHERE seg_id % 4 <> 0)"""


def cuts(spark, sf_dir) -> DataFrame:
    s = segments(spark, sf_dir).filter("seg_id % 4 <> 0")
    return s.select("asset_id", "seg_id", (F.col("start_us") + (F.col("seg_id") * 37 % 500 - 250) * 1000).alias("start_us"), (F.col("end_us") + (F.col("seg_id") * 91 % 900 - 250) * 1000).alias("end_us"))


_ALL_CUTS = _CUTS + """,
ac AS (SELECT s.asset_id, s.seg_id, coalesce(c.start_us, s.start_us) AS start_us, coalesce(c.end_us, s.end_us) AS end_us, c.seg_id IS NULL AS fallback
  FROM segments s LEFT JOIN cuts c ON c.asset_id = s.asset_id AND c.seg_id = s.seg_id)"""


def all_cuts(spark, sf_dir) -> DataFrame:
    """Optimised cuts where there are any."""
    c = cuts(spark, sf_dir).withColumnsRenamed({"start_us": "_s", "end_us": "_e"}).withColumn("_there", F.lit(True))
    j = segments(spark, sf_dir).join(c, ["asset_id", "seg_id"], "left")
    return j.select("asset_id", "seg_id", F.coalesce("_s", "start_us").alias("start_us"), F.coalesce("_e", "end_us").alias("end_us"), F.col("_there").isNull().alias("fallback"))


@query(select(SEGMENTS + _ALL_CUTS, "SELECT * FROM ac"))
def j13_cuts_or_segments(spark, sf_dir):
    """The optimised cut of a segment, else its own times."""
    return all_cuts(spark, sf_dir)


def _recursive(ctes: str, recursion: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()},\n{recursion.strip()}\n{body}"


@query(_recursive(SEGMENTS + _ALL_CUTS, """
f AS (SELECT asset_id, seg_id, start_us, CASE WHEN end_us < start_us THEN start_us + 50000 ELSE end_us END AS end_us FROM ac WHERE seg_id = 1
  UNION ALL SELECT asset_id, seg_id, s, CASE WHEN e < s THEN s + 50000 ELSE e END FROM (
    SELECT a.asset_id, a.seg_id, CASE WHEN a.start_us < f.end_us THEN f.end_us + 1000 ELSE a.start_us END AS s, a.end_us AS e FROM f JOIN ac a ON a.asset_id = f.asset_id AND a.seg_id = f.seg_id + 1))""",
    "SELECT asset_id, seg_id, start_us, end_us FROM f"))
def w23_fixed_overlaps(spark, sf_dir):
    """Neighbouring cuts freed of overlaps from left to right."""
    return E.fix_overlaps(all_cuts(spark, sf_dir))


_OVER = """
o0 AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, seg_id) AS place FROM ac),
f AS (SELECT asset_id, seg_id, place, start_us, end_us, end_us AS cursor_us, true AS stays FROM o0 WHERE place = 1
  UNION ALL SELECT asset_id, seg_id, place, CASE WHEN over THEN c ELSE start_us END, end_us, CASE WHEN gone THEN c ELSE greatest(c, end_us) END, NOT gone FROM (
    SELECT a.*, f.cursor_us AS c, a.start_us < f.cursor_us - 10000 AS over, a.start_us < f.cursor_us - 10000 AND f.cursor_us - a.start_us >= a.end_us - a.start_us - 50000 AS gone
    FROM f JOIN o0 a ON a.asset_id = f.asset_id AND a.place = f.place + 1))"""


@query(_recursive(SEGMENTS + _ALL_CUTS, _OVER, "SELECT asset_id, seg_id, start_us, end_us FROM f WHERE stays"))
def w13_resolved_overlaps(spark, sf_dir):
    """Overlapping cuts pushed behind a cursor or left out."""
    return E.resolve_overlaps(all_cuts(spark, sf_dir))


@query(_recursive(SEGMENTS + _ALL_CUTS, _OVER, """
SELECT asset_id, pe + 150000 AS start_us, start_us - 150000 AS end_us FROM (SELECT *, max(end_us) OVER (PARTITION BY asset_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM f WHERE stays)
WHERE start_us - pe > 800000 AND start_us - pe - 300000 > 50000"""))
def w14_pause_drops(spark, sf_dir):
    """Drop rows for pauses between what is kept."""
    r = E.resolve_overlaps(all_cuts(spark, sf_dir))
    w = Window.partitionBy("asset_id").orderBy("start_us", "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("pe", F.max("end_us").over(w)).filter("start_us - pe > 800000 and start_us - pe - 300000 > 50000")
    return r.select("asset_id", (F.col("pe") + 150000).alias("start_us"), (F.col("start_us") - 150000).alias("end_us"))


@query(select(SEGMENTS, """
SELECT asset_id, 'head' AS part, CAST(0 AS BIGINT) AS start_us, min(start_us) - 300000 AS end_us FROM words GROUP BY 1 HAVING min(start_us) - 300000 > 50000
UNION ALL SELECT s.asset_id, 'tail', w.last + 300000, s.last FROM (SELECT asset_id, max(end_us) + 800000 AS last FROM segments GROUP BY 1) s JOIN (SELECT asset_id, max(end_us) AS last FROM words GROUP BY 1) w
  ON w.asset_id = s.asset_id WHERE s.last - w.last - 300000 > 50000"""))
def w15_head_and_tail(spark, sf_dir):
    """Blanks before the first and behind the last word."""
    w = D.words(spark, sf_dir).groupBy("asset_id").agg(F.min("start_us").alias("first"), F.max("end_us").alias("last"))
    head = w.filter("first - 300000 > 50000").select("asset_id", F.lit("head").alias("part"), F.lit(0).cast("long").alias("start_us"), (F.col("first") - 300000).alias("end_us"))
    s = segments(spark, sf_dir).groupBy("asset_id").agg((F.max("end_us") + 800000).alias("_end"))
    tail = w.join(s, "asset_id").filter("_end - last - 300000 > 50000").select("asset_id", F.lit("tail"), F.col("last") + 300000, F.col("_end"))
    return head.union(tail)


@query(select(SEGMENTS, """
SELECT asset_id, seg_id, CASE WHEN seg_id = 1 THEN least(start_us, greatest(fw - 300000, 0)) ELSE start_us END AS start_us,
  CASE WHEN seg_id = n THEN greatest(end_us, lw + 500000) ELSE end_us END AS end_us FROM (
  SELECT s.*, count(*) OVER (PARTITION BY s.asset_id) AS n, a.start_us AS fw, b.end_us AS lw FROM segments s
  JOIN words a ON a.asset_id = s.asset_id AND a.word_idx = s.first_idx JOIN words b ON b.asset_id = s.asset_id AND b.word_idx = s.last_idx)"""))
def w22_first_and_last(spark, sf_dir):
    """Room before the first and after the last word."""
    w = D.words(spark, sf_dir)
    s = segments(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("asset_id")))
    s = s.join(w.select("asset_id", F.col("word_idx").alias("first_idx"), F.col("start_us").alias("fw")), ["asset_id", "first_idx"])
    s = s.join(w.select("asset_id", F.col("word_idx").alias("last_idx"), F.col("end_us").alias("lw")), ["asset_id", "last_idx"])
    start = F.when(F.col("seg_id") == 1, F.least("start_us", F.greatest(F.col("fw") - 300000, F.lit(0)))).otherwise(F.col("start_us"))
    end = F.when(F.col("seg_id") == F.col("n"), F.greatest("end_us", F.col("lw") + 500000)).otherwise(F.col("end_us"))
    return s.select("asset_id", "seg_id", start.alias("start_us"), end.alias("end_us"))


_CUES = """,
cues AS (SELECT asset_id, seg_id AS cue_idx, text, start_us, CASE WHEN nx IS NULL THEN start_us + 3000000 ELSE greatest(start_us + 500000, nx - 50000) END AS end_us
  FROM (SELECT *, lead(start_us) OVER (PARTITION BY asset_id ORDER BY seg_id) AS nx FROM segments))"""


def cues(spark, sf_dir) -> DataFrame:
    """Cues from segments; each ends before the next, the last after 3 s."""
    following = F.lead("start_us").over(Window.partitionBy("asset_id").orderBy("seg_id"))
    s = segments(spark, sf_dir)
    end = F.when(following.isNotNull(), F.greatest(F.col("start_us") + 500000, following - 50000)).otherwise(F.col("start_us") + 3000000)
    return s.select("asset_id", F.col("seg_id").alias("cue_idx"), "text", "start_us", end.alias("end_us"))


@query(select(SEGMENTS + _CUES, "SELECT * FROM cues"))
def w17_cues(spark, sf_dir):
    """Cue times."""
    return cues(spark, sf_dir)


def _srt(us):
    return _hms(f"(({us} + 500) // 1000)", ",", 3)


def _ass(us):
    cs = f"(({us} + 5000) // 10000)"
    return f"CAST({cs} // 360000 AS VARCHAR) || ':' || lpad(CAST({cs} // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({cs} // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({cs} % 100 AS VARCHAR), 2, '0')"


@query(select(SEGMENTS + _CUES, f"""
SELECT asset_id, string_agg(cue_idx || chr(10) || {_srt('start_us')} || ' --> ' || {_srt('end_us')} || chr(10) || text || chr(10) || lower(text) || chr(10), chr(10) ORDER BY cue_idx) AS srt FROM cues GROUP BY 1"""))
def s12_srt(spark, sf_dir):
    """Subtitle text with a second line for each cue."""
    from cutloom.sources.files import srt_text

    return srt_text(cues(spark, sf_dir).withColumn("text_2", F.lower("text")))


@query(select(SEGMENTS + _CUES, f"""
SELECT asset_id, cue_idx, style, 'Dialogue: 0,' || {_ass('start_us')} || ',' || {_ass('end_us')} || ',' || style || ',,0,0,0,,' || t AS line FROM (
  SELECT *, 'Main' AS style, replace(replace(text, ',', '，'), chr(10), ' ') AS t FROM cues UNION ALL SELECT *, 'Second', replace(lower(text), ',', ' ') FROM cues)"""))
def s13_ass(spark, sf_dir):
    """Event lines of both languages."""
    from cutloom.sources.files import ass_lines

    return ass_lines(cues(spark, sf_dir).withColumn("text_2", F.lower("text")))


@query(select(SEGMENTS, """
SELECT asset_id, max(n) AS n_words, max(n) > 1500 AS cut, string_agg(printf('%8.3f %8.3f %s', start_us / 1000000.0, end_us / 1000000.0, word), chr(10) ORDER BY word_idx) FILTER (WHERE word_idx < 1500) AS listing
FROM (SELECT *, count(*) OVER (PARTITION BY asset_id) AS n FROM words) GROUP BY 1"""))
def t2_word_table(spark, sf_dir):
    """The first 1500 words as fixed-width lines, and whether there were more."""
    w = D.words(spark, sf_dir)
    line = F.format_string("%8.3f %8.3f %s", F.col("start_us") / F.lit(1000000.0), F.col("end_us") / F.lit(1000000.0), F.col("word"))
    w = w.select("asset_id", "word_idx", F.when(F.col("word_idx") < 1500, line).alias("line"))
    return w.groupBy("asset_id").agg(F.count("*").alias("n_words"), (F.count("*") > 1500).alias("cut"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("word_idx", "line")))), lambda x: x["line"]), "\n").alias("listing"))


@query(select(SEGMENTS, "SELECT asset_id, seg_id, mean_conf, left(text, 50) AS shown FROM segments WHERE mean_conf < 500"))
def t3_low_confidence(spark, sf_dir):
    """Kept segments of low confidence with their text cut to 50 characters."""
    return segments(spark, sf_dir).filter("mean_conf < 500").select("asset_id", "seg_id", "mean_conf", F.substring("text", 1, 50).alias("shown"))


@query(select(SEGMENTS, """
SELECT asset_id, seg_id, n_words, end_us > start_us AND length(text) = 0 AS empty_text, length(text) < 8 OR length(text) > 16 AS off_size,
  replace(replace(text, 'th', 'TH'), 'que', 'QUE') AS fixed FROM segments"""))
def p12_hygiene(spark, sf_dir):
    """Empty texts, cue length limits, known misrecognitions replaced."""
    s = segments(spark, sf_dir)
    n = F.length("text")
    return s.select("asset_id", "seg_id", "n_words", ((F.col("end_us") > F.col("start_us")) & (n == 0)).alias("empty_text"), ((n < 8) | (n > 16)).alias("off_size"), T.fix_words(F.col("text"), {"th": "TH", "que": "QUE"}).alias("fixed"))
