"""Queries on whole rules beside the shorter ones of the other modules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions import text as T
from cutloom.operators import checks as C
from cutloom.operators import edl as E
from cutloom.operators import intervals as I
from cutloom.plans import quality as Q
from cutloom.plans.edits import _ALL_CUTS, _CUES, _OVER, _TIMELINE, EDL, _recursive, all_cuts, cues, edl
from cutloom.plans.sql import SEGMENTS, WORDS, select
from cutloom.plans.words import segments
from cutloom.sources import files
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


@query(_recursive(SEGMENTS + _ALL_CUTS, _OVER, """
SELECT asset_id, seg_id, CASE WHEN start_us - pe > 800000 AND start_us - pe - 300000 > 50000 THEN greatest(start_us - 150000, pe + 150000) ELSE start_us END AS start_us, end_us
FROM (SELECT *, max(end_us) OVER (PARTITION BY asset_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM f WHERE stays)"""))
def w14_pulled_starts(spark, sf_dir):
    """Kept cuts, those behind a long pause with room before their start."""
    return E.pull_starts(E.resolve_overlaps(all_cuts(spark, sf_dir)))


@query(select(SEGMENTS + _ALL_CUTS, """
SELECT asset_id, seg_id, s AS start_us, e AS end_us FROM (SELECT c.asset_id, seg_id, greatest(c.start_us, greatest(first - 300000, 0)) AS s, least(c.end_us, last + 300000) AS e
  FROM ac c JOIN (SELECT asset_id, min(start_us) AS first, max(end_us) AS last FROM words GROUP BY 1) w ON w.asset_id = c.asset_id) WHERE e - s >= 50000"""))
def w15_clamped_keeps(spark, sf_dir):
    """Kept cuts within the first and last word's room; what is too short goes."""
    return E.clamp_keeps(all_cuts(spark, sf_dir), D.words(spark, sf_dir))


@query(select(SEGMENTS + _ALL_CUTS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seg_id) AS k, count(*) OVER (PARTITION BY asset_id) AS n FROM ac),
hd AS (SELECT o.asset_id, min(w.start_us) AS fw FROM o JOIN words w ON w.asset_id = o.asset_id AND w.start_us >= o.start_us WHERE k = 1 GROUP BY 1),
s1 AS (SELECT o.*, CASE WHEN k = 1 AND fw - start_us < 300000 THEN greatest(fw - 300000, 0) ELSE start_us END AS s FROM o LEFT JOIN hd ON hd.asset_id = o.asset_id),
tl AS (SELECT o.asset_id, max(w.end_us) AS lw FROM s1 o JOIN words w ON w.asset_id = o.asset_id AND w.start_us >= o.s - 1000000 WHERE k = n GROUP BY 1)""", """
SELECT s1.asset_id, seg_id, s AS start_us, greatest(CASE WHEN k = n THEN greatest(end_us, coalesce(lw + 500000, end_us)) ELSE end_us END, s + 50000) AS end_us FROM s1 LEFT JOIN tl ON tl.asset_id = s1.asset_id"""))
def w22_bounded_cuts(spark, sf_dir):
    """The first cut's head, the last one's tail, and the least length."""
    return E.bound_ends(all_cuts(spark, sf_dir), D.words(spark, sf_dir))


@query(select(SEGMENTS + _TIMELINE + """,
ow AS (SELECT w.asset_id, w.word_idx, t.out_frame * 1000000.0 / 30 + (w.start_us - t.start_us) AS out_us FROM words w JOIN tl2 t ON t.asset_id = w.asset_id AND w.start_us >= t.start_us AND w.start_us < t.end_us),
os AS (SELECT asset_id, seg_id, start_us, out_frame * 1000000.0 / 30 AS a, (out_frame + n_frames) * 1000000.0 / 30 AS b FROM tl2)""", """
SELECT w.asset_id, word_idx, seg_id, CAST(round(start_us + (out_us - a)) AS BIGINT) AS source_us FROM ow w JOIN os s ON s.asset_id = w.asset_id AND out_us >= a AND out_us < b"""))
def w20_source_times(spark, sf_dir):
    """The words' output times taken back to the source."""
    tl = E.output_timeline(segments(spark, sf_dir))
    inside = (F.col("start_us") >= F.col("_start")) & (F.col("start_us") < F.col("_end"))
    out = I.point_join(D.words(spark, sf_dir), F.col("start_us"), I.bucketed(tl, None, None, "out_frame"), inside, "inner")
    out = out.select("asset_id", "word_idx", (F.col("out_frame") * F.lit(1000000.0) / 30 + (F.col("start_us") - F.col("_start"))).alias("out_us"))
    return E.to_source(out, tl).select("asset_id", "word_idx", "seg_id", F.round("source_us").cast("long").alias("source_us"))


@query(select(EDL + """,
said AS (SELECT d.asset_id, d.seg_id, string_agg(w.word, ' ' ORDER BY w.word_idx) AS text FROM edl d JOIN words w ON w.asset_id = d.asset_id AND w.start_us + w.end_us >= 2 * d.start_us AND w.start_us + w.end_us < 2 * d.end_us GROUP BY 1, 2)""", """
SELECT e.asset_id, e.keep, CAST(row_number() OVER (PARTITION BY e.asset_id, e.keep ORDER BY e.start_us, e.seg_id) AS INTEGER) AS place, e.seg_id, e.end_us - e.start_us AS dur_us, left(coalesce(text, ''), CASE WHEN e.keep THEN 40 ELSE 50 END) AS shown, decided_by
FROM edl e LEFT JOIN said s ON s.asset_id = e.asset_id AND s.seg_id = e.seg_id"""))
def t4_decision_lists(spark, sf_dir):
    """T4: the dropped and the kept rows by start, their words cut to 50 and 40 characters."""
    e, w = edl(spark, sf_dir), D.words(spark, sf_dir)
    said = I.point_join(w, I.twice_mid() / 2, I.bucketed(e, None, None, "seg_id"), I.mid_inside(), "inner")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    j = e.join(said.groupBy("asset_id", "seg_id").agg(text.alias("text")), ["asset_id", "seg_id"], "left")
    place = F.row_number().over(Window.partitionBy("asset_id", "keep").orderBy("start_us", "seg_id"))
    shown = F.left(F.coalesce("text", F.lit("")), F.when(F.col("keep"), 40).otherwise(50))
    return j.select("asset_id", "keep", place.alias("place"), "seg_id", (F.col("end_us") - F.col("start_us")).alias("dur_us"), shown.alias("shown"), "decided_by")


_OTHER = """,
other AS (SELECT asset_id, word_idx, word, start_us + (word_idx * 37 % 260 - 130) * 1000 AS start_us, (conf_milli * 7 + word_idx) % 1000 AS conf_milli FROM words),
near AS (SELECT a.asset_id, a.word_idx, a.start_us, min(abs(a.start_us - b.start_us)) AS diff_us FROM words a JOIN other b ON b.asset_id = a.asset_id AND b.word = a.word AND b.conf_milli > 850 AND abs(a.start_us - b.start_us) < 1000000
  WHERE a.conf_milli > 850 GROUP BY 1, 2, 3),
tiles AS (SELECT *, ntile(20) OVER (PARTITION BY asset_id ORDER BY start_us, word_idx) AS tile FROM near)"""


@query(select(WORDS + _OTHER, """
SELECT asset_id, CAST(tile AS INTEGER) AS tile, word_idx, diff_us, diff_us < 100000 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, tile ORDER BY start_us, word_idx) AS n FROM tiles) WHERE n = 1"""))
def j18_sampled_differences(spark, sf_dir):
    """Words that two transcripts hold with confidence, up to twenty of them spread over time, and how far they differ."""
    w = D.words(spark, sf_dir)
    i = F.col("word_idx")
    other = w.select("asset_id", "word", (F.col("start_us") + (i * 37 % 260 - 130) * 1000).alias("start_us"), ((F.col("conf_milli") * 7 + i) % 1000).alias("conf_milli"))
    return C.sampled_differences(w, other)


@query(f"""SELECT asset_id, lag, peak, distance, abs(lag) * 1000 < 40 * 64 AS lag_pass, distance < 10 AS hash_pass, abs(lag) * 1000 < 40 * 64 AND distance < 10 AS seg_pass
FROM ({Q.SQL['m1_lags']}) l JOIN ({Q.SQL['m2_image_hashes']}) h USING (asset_id)""")
def v9_measured_sync(spark, sf_dir):
    """V9 on M1 and M3: measured lags of signals of 64 samples a second, and distances of measured hashes."""
    return sync(spark, sf_dir)


def sync(spark, sf_dir) -> DataFrame:
    return C.sync_verdicts(Q.m1_lags(spark, sf_dir), Q.m2_image_hashes(spark, sf_dir).select("asset_id", "distance"), 64)


@query(f"""SELECT asset_id // 10 AS recording, count(*) AS checked, count(*) FILTER (WHERE abs(lag) * 1000 < 40 * 64 AND distance < 10) AS passed, bool_and(abs(lag) * 1000 < 40 * 64 AND distance < 10) AS all_pass, max(abs(lag)) AS worst_lag
FROM ({Q.SQL['m1_lags']}) l JOIN ({Q.SQL['m2_image_hashes']}) h USING (asset_id) GROUP BY 1""")
def a15_sync_summary(spark, sf_dir):
    """Whether all checked segments of a recording are in sync."""
    ok = F.col("seg_pass")
    g = sync(spark, sf_dir).groupBy(F.floor(F.col("asset_id") / 10).alias("recording"))
    return g.agg(F.count("*").alias("checked"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("all_pass"), F.max(F.abs("lag")).alias("worst_lag"))


@query(select(WORDS + """,
ch AS (SELECT asset_id, turn AS chunk, count(*) AS n_words, max(end_us) - min(start_us) AS dur_us, 40000 * sum(length(word)) + 1500000 AS elapsed_us FROM words GROUP BY 1, 2)""", """
SELECT asset_id, count(*) AS n_chunks, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(elapsed_us) AS BIGINT) AS elapsed_us, sum(elapsed_us) * 1.0 / greatest(sum(dur_us), 10000) AS real_time_factor FROM ch GROUP BY 1"""))
def a16_chunk_throughput(spark, sf_dir):
    """Chunks of each asset, their words, the time that they took and the real-time factor."""
    chunk = D.words(spark, sf_dir).groupBy("asset_id", "turn").agg(
        F.count("*").alias("n_words"), (F.max("end_us") - F.min("start_us")).alias("dur_us"), (F.sum(F.length("word")) * 40000 + 1500000).alias("elapsed_us")
    )
    took = F.sum("elapsed_us")
    return chunk.groupBy("asset_id").agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"), took.alias("elapsed_us"), (took * F.lit(1.0) / F.greatest(F.sum("dur_us"), F.lit(10000))).alias("real_time_factor"))


#: Letters of the given texts as Han characters, so that rules on these have something to count.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 17 * k) for k in range(26))


@query(f"""WITH h AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{HAN}') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) AS n_runs, sha256(array_to_string(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), ' ')) AS runs_sha256 FROM h""")
def p10_runs_of_han_texts(spark, sf_dir):
    """P10: runs of Han characters in texts made of them."""
    h = D.read(spark, sf_dir, "documents").select("doc_id", T.han_runs(F.translate(F.lower("text"), LATIN, HAN)).alias("r"))
    return h.select("doc_id", F.size("r").cast("long").alias("n_runs"), F.sha2(F.array_join("r", " "), 256).alias("runs_sha256"))


@query(select(SEGMENTS + _CUES + f""",
hc AS (SELECT asset_id, cue_idx, text, length(regexp_replace(translate(lower(text), '{LATIN}', '{HAN}'), '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS n_han FROM cues)""", """
SELECT asset_id, cue_idx, CAST(n_han AS INTEGER) AS n_han, n_han < 8 OR n_han > 16 AS off_cue, n_han > 12 AS off_screen FROM hc"""))
def p14_han_limits(spark, sf_dir):
    """8 to 16 Han characters in a cue, at most 12 on screen."""
    c = cues(spark, sf_dir).withColumn("n_han", T.han_count(F.translate(F.lower("text"), LATIN, HAN)))
    n = F.col("n_han")
    return c.select("asset_id", "cue_idx", n, ((n < 8) | (n > 16)).alias("off_cue"), (n > 12).alias("off_screen"))


_DECIDED = EDL + """,
noted AS (SELECT asset_id, seg_id, CASE WHEN seg_id % 29 = 0 THEN NULL ELSE start_us END AS start_us, end_us, keep, CASE seg_id % 7 WHEN 0 THEN '' WHEN 1 THEN '[pause]' WHEN 2 THEN 'said [cut] so' ELSE 'said' END AS text,
  CASE WHEN seg_id % 5 = 0 THEN '[pause] long' ELSE 'rule' END AS reason, CASE seg_id % 11 WHEN 0 THEN 'nobody' WHEN 1 THEN NULL ELSE decided_by END AS decided_by FROM edl)"""


@query(select(_DECIDED, """
SELECT asset_id, seg_id, array_to_string(list_filter([CASE WHEN start_us IS NULL OR end_us IS NULL OR keep IS NULL OR decided_by IS NULL THEN 'missing' END, CASE WHEN coalesce(text, '') = '' THEN 'text' END,
  CASE WHEN regexp_matches(text, '\\[[^\\]]*\\]') AND NOT regexp_full_match(text, '\\[[^\\]]*\\]') THEN 'tag in text' END, CASE WHEN decided_by IS NOT NULL AND decided_by NOT IN ('rule', 'llm', 'self_dedup_rule', 'human') THEN 'decider' END,
  CASE WHEN end_us <= start_us THEN 'times' END], lambda x: x IS NOT NULL), ',') AS faults FROM noted"""))
def p12_decision_hygiene(spark, sf_dir):
    """Decision rows with something missing, without words, with tags among them, or by an unknown decider."""
    i = F.col("seg_id")
    noted = edl(spark, sf_dir).select(
        "asset_id", "seg_id", F.when(i % 29 != 0, F.col("start_us")).alias("start_us"), "end_us", "keep",
        F.when(i % 7 == 0, "").when(i % 7 == 1, "[pause]").when(i % 7 == 2, "said [cut] so").otherwise("said").alias("text"),
        F.when(i % 11 == 0, "nobody").when(i % 11 != 1, F.col("decided_by")).alias("decided_by"),
    )
    return C.decision_faults(noted).select("asset_id", "seg_id", F.array_join("faults", ",").alias("faults"))


_CATALOG = "cat AS (SELECT '[nation.' || lower(replace(n_name, ' ', '-')) || '] ' || n_name AS line FROM nation), ids AS (SELECT regexp_extract(line, '^\\[([a-z0-9_-]+\\.[a-z0-9_-]+)\\]', 1) AS component FROM cat)"


@query(f"""WITH {_CATALOG}, used AS (SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 3 = 0 THEN 'nation.' || lower(replace(n_name, ' ', '-')) WHEN o_orderkey % 3 = 1 THEN 'region.x' || n_nationkey ELSE 'nation.' || n_nationkey END AS component FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
SELECT asset_id, component, count(*) AS n FROM used WHERE component NOT IN (SELECT component FROM ids) GROUP BY 1, 2""")
def j21_unknown_ids(spark, sf_dir):
    """Components used that stand in no header line of a catalog."""
    slug = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    nation = D.read(spark, sf_dir, "nation")
    lines = nation.select(F.concat(F.lit("[nation."), slug, F.lit("] "), "n_name").alias("line"))
    k = F.col("o_orderkey") % 3
    used = D.read(spark, sf_dir, "orders").join(nation, (F.col("o_custkey") % 25).cast("int") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("asset_id"),
        F.when(k == 0, F.concat(F.lit("nation."), slug)).when(k == 1, F.concat(F.lit("region.x"), F.col("n_nationkey").cast("string"))).otherwise(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string"))).alias("component"),
    )
    return C.unknown_components(used, lines)


@query(select(WORDS, """
SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY start_us, turn, word_idx) - 1 AS INTEGER) AS word_idx, word, start_us, end_us, conf_milli / 1000.0 AS confidence FROM words"""))
def s2_stitched_words(spark, sf_dir):
    """Every turn as a chunk with times of its own, put back on one timeline."""
    w = D.words(spark, sf_dir)
    chunk = F.concat_ws("/", "asset_id", "turn")
    offsets = w.groupBy("asset_id", "turn").agg(F.min("start_us").alias("offset_us"))
    manifest = offsets.select(chunk.alias("chunk"), F.col("asset_id").alias("asset"), F.col("turn").alias("seq"), "offset_us")
    j = w.join(offsets, ["asset_id", "turn"])
    chunks = j.select(chunk.alias("asset_id"), "word_idx", "word", (F.col("start_us") - F.col("offset_us")).alias("start_us"), (F.col("end_us") - F.col("offset_us")).alias("end_us"), (F.col("conf_milli") / F.lit(1000.0)).alias("confidence"))
    return files.stitch(chunks, manifest)


@query(select(SEGMENTS, """
SELECT asset_id, start_us, end_us, CASE WHEN seg_id % 2 = 0 THEN 'full_repeat' ELSE 'stutter_restart' END AS reason, 'SD_' || seg_id AS drop_id FROM segments WHERE (seg_id * 37 % 100) / 100.0 >= 0.8"""))
def s7_duplicate_drops(spark, sf_dir):
    """The earlier saying of similar pairs as a drop."""
    i = F.col("seg_id")
    pairs = segments(spark, sf_dir).select(
        "asset_id", i.alias("pair_id"), ((i * 37 % 100) / F.lit(100.0)).alias("similarity"), F.when(i % 2 == 0, "full_repeat").otherwise("stutter_restart").alias("dup_type"), F.struct("start_us", "end_us").alias("seg_a")
    )
    return files.duplicate_drops(pairs)


def _tc(us: str) -> str:
    ms = f"(({us} + 500) // 1000)"
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


_ROWS = SEGMENTS + f""",
rw AS (SELECT asset_id, seg_id AS id, seg_id % 3 <> 0 AS keep, {_tc('start_us')} AS "start", {_tc('end_us')} AS "end", start_us / 1000000.0 AS start_s, end_us / 1000000.0 AS end_s, text, '' AS script_line, 0 AS pad_in_ms, 0 AS pad_out_ms, 'r' || seg_id AS reason, 'rule' AS decided_by, '' AS note FROM segments)"""


def decision_rows(spark, sf_dir) -> DataFrame:
    """Segments as standard decision rows."""
    s = segments(spark, sf_dir).select("asset_id", "seg_id", (F.col("seg_id") % 3 != 0).alias("keep"), "start_us", "end_us", "text", F.concat(F.lit("r"), F.col("seg_id").cast("string")).alias("reason"))
    return files.edl_rows(s)


@query(select(_ROWS, "SELECT * FROM rw"))
def s10_decisions_as_json(spark, sf_dir):
    """Decision rows written as a document an asset and read back."""
    path = D.scratch(spark, "decisions")
    files.write_edl_json(decision_rows(spark, sf_dir), path)
    return files.read_edl(spark, path)


@query(select(_ROWS, """
SELECT asset_id, CAST(id AS INTEGER) AS id, keep, "start", "end", start_s, end_s, text, reason, decided_by, round(end_s - start_s, 3) AS duration_s FROM rw"""))
def s11_decisions_as_csv(spark, sf_dir):
    """Decision rows written as a table of text with fixed columns and read back."""
    path = D.scratch(spark, "decisions")
    files.write_edl_csv(decision_rows(spark, sf_dir), path)
    kinds = {"id": "int", "keep": "boolean", "start_s": "double", "end_s": "double", "pad_in_ms": "int", "pad_out_ms": "int", "duration_s": "double"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in files.EDL_COLUMNS)
    back = spark.read.option("header", True).schema(f"asset_id long, {schema}").csv(path)
    return back.select("asset_id", "id", "keep", "start", "end", "start_s", "end_s", "text", "reason", "decided_by", "duration_s")


@query(select(SEGMENTS + """,
auto AS (SELECT asset_id, CAST(sum(end_us - start_us) AS BIGINT) AS keep_us FROM segments GROUP BY 1),
hand AS (SELECT s.asset_id, CAST(sum(s.end_us - s.start_us) AS BIGINT) AS hand_us FROM segments s LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = s.asset_id + s.seg_id WHERE coalesce(l.toxic, 0) = 0 GROUP BY 1),
src AS (SELECT asset_id, CASE WHEN asset_id % 10 <> 0 THEN max(end_us) END AS source_us FROM words GROUP BY 1)""", """
SELECT src.asset_id, source_us, keep_us, hand_us, round(keep_us::DOUBLE / source_us, 6) AS ratio, round(hand_us::DOUBLE / source_us, 6) AS hand_ratio, round(keep_us::DOUBLE / hand_us - 1, 6) AS over_hand
FROM src LEFT JOIN auto ON auto.asset_id = src.asset_id LEFT JOIN hand ON hand.asset_id = src.asset_id"""))
def a4_against_manual(spark, sf_dir):
    """A4: what is kept against the source's length, null where that is unknown, and against a cut by hand."""
    s = segments(spark, sf_dir)
    dur = F.col("end_us") - F.col("start_us")
    toxic = D.read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("toxic"))
    hand = s.join(toxic, F.col("asset_id") + F.col("seg_id") == F.col("_doc"), "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    source = D.words(spark, sf_dir).groupBy("asset_id").agg(F.max("end_us").alias("_end")).select("asset_id", F.when(F.col("asset_id") % 10 != 0, F.col("_end")).alias("source_us"))
    out = source.join(s.groupBy("asset_id").agg(F.sum(dur).alias("keep_us")), "asset_id", "left").join(hand.groupBy("asset_id").agg(F.sum(dur).alias("hand_us")), "asset_id", "left")
    share = lambda a, b: F.round(F.col(a).cast("double") / F.col(b), 6)
    return out.select("*", share("keep_us", "source_us").alias("ratio"), share("hand_us", "source_us").alias("hand_ratio"), F.round(F.col("keep_us").cast("double") / F.col("hand_us") - 1, 6).alias("over_hand"))
