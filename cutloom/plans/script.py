"""Queries on retakes, scripts, ranges and sessions, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutloom.functions import text as T
from cutloom.operators import align as A
from cutloom.operators import checks as C
from cutloom.operators import edl as E
from cutloom.operators import retakes as R
from cutloom.operators import signal as G
from cutloom.operators import speech as P
from cutloom.operators.phrases import locate_phrases
from cutloom.plans import quality as Q
from cutloom.plans.edits import _ALL_CUTS, _CUES, all_cuts, cues
from cutloom.plans.sql import SEGMENTS, WORDS, select
from cutloom.plans.words import _POINTS, points
from cutloom.sources import tables as D
from cutloom.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(select(WORDS + r""",
n AS (SELECT asset_id, word_idx, regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g') AS norm, start_us, end_us, coalesce(lead(start_us) OVER w - end_us > 250000, true) AS pause FROM words WINDOW w AS (PARTITION BY asset_id ORDER BY word_idx)),
c AS (SELECT *, sum(length(norm)) OVER (PARTITION BY asset_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS cum FROM n),
p AS (SELECT a.asset_id, a.word_idx AS i, b.word_idx AS j, a.start_us, b.end_us, b.pause, b.cum - a.cum + length(a.norm) AS n_chars FROM c a JOIN c b ON b.asset_id = a.asset_id AND b.word_idx BETWEEN a.word_idx + 2 AND a.word_idx + 70)""", r"""
SELECT asset_id, i, j, CASE WHEN pause THEN 0 ELSE 1 END AS track, start_us, end_us, CAST(n_chars AS INTEGER) AS n_chars FROM p WHERE n_chars BETWEEN 4 AND 60 AND (pause OR j - i < 10)"""))
def w12_windows(spark, sf_dir):
    """Candidate windows for retakes.  The SQL looks 70 words ahead, which no window of these texts exceeds; the operator
    looks as far as the letters allow."""
    return R.windows(D.words(spark, sf_dir)).select("asset_id", "i", "j", "track", "start_us", "end_us", F.length("norm").alias("n_chars"))


@query()
def w8_self_duplicates(spark, sf_dir):
    """Retakes and stutters of all conversations."""
    return R.self_duplicates(D.words(spark, sf_dir, 1)).select("asset_id", "a_i", "a_j", "b_i", "b_j", "similarity", "gap_us", "dup_type")


@query()
def a11_retake_quality(spark, sf_dir):
    """How well retakes are found in takes whose beginnings are said twice, by recording."""
    found = R.self_duplicates(D.takes(spark, sf_dir, 1)).select("asset_id", "a_i")
    found = D.in_turns(found, D.taken_turns(spark, sf_dir), "a_i")
    return C.detector_quality(found, D.retaken_turns(spark, sf_dir), ["asset_id", "turn"], ["asset_id"])


@query()
def j7_alignment(spark, sf_dir):
    """Script sentences in all conversations."""
    return A.align(D.words(spark, sf_dir, 1), D.sentences(spark, sf_dir)).select("asset_id", "item_id", "sent_id", "interval_idx", "first_idx", "last_idx", "confidence", "keep", "reason")


@query()
def a1_alignment_summary(spark, sf_dir):
    """A1: sentences, matches, repeats and match rate by item."""
    s = D.sentences(spark, sf_dir)
    m = A.align(D.words(spark, sf_dir, 1), s).groupBy("item_id", "sent_id").agg(F.count("*").alias("n"))
    j = s.join(m, ["item_id", "sent_id"], "left").groupBy("item_id")
    out = j.agg(F.count("*").alias("sentences"), F.count("n").alias("matched"), F.count_if(F.col("n") > 1).alias("repeats"))
    return out.withColumn("unmatched", F.col("sentences") - F.col("matched")).withColumn("match_rate", F.round(F.col("matched") / F.col("sentences"), 4))


@query()
def a1_asset_summary(spark, sf_dir):
    """A1: sentences, matches, repeats and what is left over, by recording and script."""
    s = D.sentences(spark, sf_dir)
    return A.summary(D.words(spark, sf_dir), s, A.align(D.words(spark, sf_dir, 1), s))


def _line(column: str) -> str:
    half = T.HALF_WIDTH.replace("'", "''")
    return rf"regexp_replace(translate({column}, '{T.FULL_WIDTH}', '{half}'), '[^\p{{L}}\p{{N}}_]', '', 'g')"


#: Scores at shared grams, as a window that holds so many of them is best where it ends with one or has the least length.
_OWN = "WITH RECURSIVE " + WORDS.strip() + rf""",
pt AS (SELECT conv_id AS asset_id, turn, string_split(regexp_replace(coalesce(text, ''), '([.!?])', '\1', 'g'), '') AS ps FROM conversations WHERE turn % 3 = 0),
p1 AS (SELECT asset_id, turn, unnest(ps) AS s, generate_subscripts(ps, 1) AS p FROM pt),
p2 AS (SELECT asset_id, turn, p, array_to_string(list_filter(regexp_extract_all(s, '\S+'), lambda w, i: (i - 1) % 7 <> 5), ' ') AS text FROM p1),
scr AS (SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY turn, p) AS INTEGER) AS sent_id, {_line('text')} AS norm FROM p2 WHERE length(text) >= 4),
se AS (SELECT asset_id, sent_id, norm, length(norm) AS q, greatest(4, CAST(floor(length(norm)::DOUBLE * 0.65::DOUBLE) AS BIGINT)) AS low, CAST(floor(length(norm)::DOUBLE * 2.2::DOUBLE) AS BIGINT) + 1 AS high,
  greatest(4, CAST(floor(length(norm)::DOUBLE * 0.8::DOUBLE) AS BIGINT)) AS radius FROM scr WHERE length(norm) >= 4),
sg AS (SELECT asset_id, sent_id, substr(norm, i + 1, 4) AS g, count(*) AS k FROM (SELECT *, unnest(range(q - 3)) AS i FROM se) GROUP BY ALL),
ln AS (SELECT *, sum(length(n)) OVER (PARTITION BY asset_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, {_line('word')} AS n FROM words)),
tx AS (SELECT asset_id, string_agg(n, '' ORDER BY word_idx) AS t, sum(length(n)) AS size FROM ln GROUP BY 1),
gr AS (SELECT asset_id, size, i AS p, substr(t, CAST(i + 1 AS BIGINT), 4) AS g FROM (SELECT *, unnest(range(CAST(size - 3 AS BIGINT))) AS i FROM tx)),
pl AS (SELECT sg.asset_id, sg.sent_id, size, p, k, sg.g, row_number() OVER (PARTITION BY sg.asset_id, sg.sent_id, sg.g ORDER BY p) AS rn FROM sg JOIN gr ON gr.asset_id = sg.asset_id AND gr.g = sg.g),
sh AS (SELECT a.asset_id, a.sent_id, a.size, a.p, coalesce(b.p, -1) AS before FROM pl a LEFT JOIN pl b ON b.asset_id = a.asset_id AND b.sent_id = a.sent_id AND b.g = a.g AND b.rn = a.rn - a.k),
pr AS (SELECT asset_id, sent_id, size, p, before, q, low, high, unnest(range(greatest(0, p - high + 4), p + 1)) AS s FROM sh JOIN se USING (asset_id, sent_id)),
ov AS (SELECT *, sum(CASE WHEN before < s THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, sent_id, s ORDER BY p ROWS UNBOUNDED PRECEDING) AS n_in, greatest(low, p - s + 4) AS len FROM pr),
be AS (SELECT asset_id, sent_id, s, min({{'f': -(2.0::DOUBLE * n_in / (len - 3 + q - 3)), 'l': len}}) AS b FROM ov WHERE len <= high AND s + len <= size GROUP BY ALL),
hi AS (SELECT asset_id, sent_id, s, -b.f AS f1, b.l AS len FROM be WHERE -b.f >= 0.25),
mx AS (SELECT h.*, radius FROM hi h JOIN se USING (asset_id, sent_id) WHERE NOT EXISTS (SELECT 1 FROM hi o WHERE o.asset_id = h.asset_id AND o.sent_id = h.sent_id AND abs(o.s - h.s) <= radius AND o.f1 > h.f1)),
mn AS (SELECT *, row_number() OVER (PARTITION BY asset_id, sent_id ORDER BY s) AS rn FROM mx),
fo AS (SELECT asset_id, sent_id, rn, s, s AS kept, true AS stays FROM mn WHERE rn = 1
  UNION ALL SELECT m.asset_id, m.sent_id, m.rn, m.s, CASE WHEN m.s - f.kept >= m.radius THEN m.s ELSE f.kept END, m.s - f.kept >= m.radius FROM fo f JOIN mn m ON m.asset_id = f.asset_id AND m.sent_id = f.sent_id AND m.rn = f.rn + 1),
rg AS (SELECT mx.asset_id, mx.sent_id, mx.s, f1, a.word_idx AS first_idx, b.word_idx AS last_idx, a.start_us, b.end_us FROM mx JOIN fo ON fo.asset_id = mx.asset_id AND fo.sent_id = mx.sent_id AND fo.s = mx.s AND stays
  JOIN ln a ON a.asset_id = mx.asset_id AND a.e > mx.s AND a.e - length(a.n) <= mx.s JOIN ln b ON b.asset_id = mx.asset_id AND b.e > mx.s + len - 1 AND b.e - length(b.n) <= mx.s + len - 1),
cf AS (SELECT rg.asset_id, sent_id, s, first_idx, last_idx, rg.start_us, rg.end_us, round_even(f1 * CASE WHEN avg(w.conf_milli) >= 500 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END, 4) AS confidence
  FROM rg JOIN words w ON w.asset_id = rg.asset_id AND w.word_idx BETWEEN first_idx AND last_idx GROUP BY rg.asset_id, sent_id, s, first_idx, last_idx, rg.start_us, rg.end_us, f1),
own AS (SELECT *, row_number() OVER (PARTITION BY asset_id, sent_id ORDER BY start_us, end_us, s) - 1 AS interval_idx, row_number() OVER (PARTITION BY asset_id, sent_id ORDER BY start_us DESC, end_us DESC, s DESC) = 1 AS keep FROM cf WHERE confidence >= 0.25)"""


@query(_OWN + """
SELECT asset_id, sent_id, CAST(interval_idx AS INTEGER) AS interval_idx, first_idx, last_idx, confidence, keep, CASE WHEN keep THEN '' ELSE 'repeat_discard' END AS reason FROM own""")
def j7_own_scripts(spark, sf_dir):
    """The sentences of each recording's own script in it."""
    return A.align(D.words(spark, sf_dir), D.scripts(spark, sf_dir)).select("asset_id", "sent_id", "interval_idx", "first_idx", "last_idx", "confidence", "keep", "reason")


@query(_OWN + """,
ms AS (SELECT asset_id, count(*) AS matched, count(*) FILTER (WHERE n > 1) AS repeats FROM (SELECT asset_id, sent_id, count(*) AS n FROM own GROUP BY 1, 2) GROUP BY 1),
lo AS (SELECT *, word_idx - row_number() OVER (PARTITION BY asset_id ORDER BY word_idx) AS run FROM words w WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.asset_id = w.asset_id AND w.word_idx BETWEEN o.first_idx AND o.last_idx)),
ad AS (SELECT asset_id, count(*) AS adlibs FROM (SELECT asset_id, run FROM lo GROUP BY 1, 2 HAVING max(end_us) - min(start_us) >= 500000) GROUP BY 1)
SELECT ms.asset_id, matched, repeats, sentences, coalesce(adlibs, 0) AS adlibs, sentences - matched AS unmatched, round(matched::DOUBLE / sentences, 4) AS match_rate
FROM ms JOIN (SELECT asset_id, count(*) AS sentences FROM scr GROUP BY 1) c ON c.asset_id = ms.asset_id LEFT JOIN ad ON ad.asset_id = ms.asset_id""")
def a1_own_scripts(spark, sf_dir):
    """Sentences, matches, repeats and what is left over, by recording."""
    w, s = D.words(spark, sf_dir), D.scripts(spark, sf_dir)
    return A.summary(w, s, A.align(w, s))


_RANGED = ",\nrw AS (SELECT *, word_idx // 60 AS range_id FROM words)"


def ranged(spark, sf_dir):
    return D.words(spark, sf_dir).withColumn("range_id", F.floor(F.col("word_idx") / 60).cast("int"))


@query(select(WORDS + _RANGED + """,
a AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY asset_id, range_id ORDER BY word_idx) > 800000 THEN 1 ELSE 0 END AS cut, min(start_us) OVER (PARTITION BY asset_id, range_id) AS lo, max(end_us) OVER (PARTITION BY asset_id, range_id) AS hi FROM rw),
b AS (SELECT *, sum(cut) OVER (PARTITION BY asset_id, range_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS island FROM a)""", """
SELECT asset_id, range_id, min(word_idx) AS first_idx, max(word_idx) AS last_idx, greatest(min(start_us) - 150000, min(lo)) AS start_us, least(max(end_us) + 150000, min(hi)) AS end_us FROM b GROUP BY asset_id, range_id, island"""))
def w3_split_ranges(spark, sf_dir):
    """Ranges of words cut at pauses of more than 0.8 s."""
    return P.split_ranges(ranged(spark, sf_dir))


@query(select(WORDS + _RANGED + r""",
a AS (SELECT *, CASE WHEN lower(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')) IN ('the', 'que', 'la', 'in', 'un', 'les') AND coalesce(start_us - lag(end_us) OVER w, 300000) >= 300000 AND coalesce(lead(start_us) OVER w - end_us, 300000) >= 300000 THEN 1 ELSE 0 END AS o
  FROM rw WINDOW w AS (PARTITION BY asset_id ORDER BY word_idx)),
b AS (SELECT *, min(o) OVER (PARTITION BY asset_id, range_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS head, min(o) OVER (PARTITION BY asset_id, range_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM a),
g AS (SELECT asset_id, range_id, min(start_us) AS s, max(end_us) AS e, max(CASE WHEN head = 1 THEN end_us END) AS h, min(CASE WHEN tail = 1 AND head = 0 THEN start_us END) AS t, CAST(sum(greatest(head, tail)) AS BIGINT) AS n_removed FROM b GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN h IS NOT NULL THEN least(h + 150000, e) ELSE s END AS start_us FROM g),
y AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(t - 150000, start_us) ELSE e END AS end_us FROM x)""", r"""
SELECT asset_id, range_id, start_us, end_us, n_removed FROM y WHERE end_us - start_us >= 50000"""))
def w16_trimmed_ranges(spark, sf_dir):
    """Ranges without fillers that stand apart at their ends."""
    return P.trim_fillers(ranged(spark, sf_dir), F.lower(T.normalize(F.col("word"))).isin(*D.FILLERS))


@query(select(SEGMENTS + _POINTS, """
SELECT p.asset_id, p.point_id, p.t_us, first(w.word_idx ORDER BY w.start_us, w.word_idx) AS word_idx, min(w.start_us) AS word_start_us FROM points p LEFT JOIN words w ON w.asset_id = p.asset_id AND w.start_us >= p.t_us GROUP BY 1, 2, 3"""))
def j14_next_words(spark, sf_dir):
    """The word that follows each cut point."""
    return P.next_words(points(spark, sf_dir), D.words(spark, sf_dir)).withColumn("point_id", F.col("point_id").cast("int"))


@query(select(WORDS + r""",
n AS (SELECT asset_id, word_idx, start_us, end_us, regexp_replace(word, '[\s，。、！？,.!?]', '', 'g') AS n FROM words),
t AS (SELECT asset_id, string_agg(n, '' ORDER BY word_idx) AS text FROM n GROUP BY 1),
q AS (SELECT asset_id, string_agg(word, ' ' ORDER BY word_idx) AS phrase FROM words WHERE word_idx BETWEEN 5 AND 7 GROUP BY 1 UNION ALL SELECT DISTINCT asset_id, 'nowhere at all' FROM words),
c AS (SELECT *, sum(length(n)) OVER (PARTITION BY asset_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS hi FROM n),
f AS (SELECT q.asset_id, phrase, nullif(position(regexp_replace(phrase, '[\s，。、！？,.!?]', '', 'g') IN text), 0) AS p, length(regexp_replace(phrase, '[\s，。、！？,.!?]', '', 'g')) AS l FROM q JOIN t ON t.asset_id = q.asset_id)""", r"""
SELECT f.asset_id, phrase, a.word_idx AS first_idx, b.word_idx AS last_idx, a.start_us, b.end_us FROM f LEFT JOIN c a ON a.asset_id = f.asset_id AND p BETWEEN a.hi - length(a.n) + 1 AND a.hi
LEFT JOIN c b ON b.asset_id = f.asset_id AND p + l - 1 BETWEEN b.hi - length(b.n) + 1 AND b.hi"""))
def j15_located_phrases(spark, sf_dir):
    """Where a phrase of each asset is said first."""
    w = D.words(spark, sf_dir)
    said = w.filter("word_idx between 5 and 7").groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return locate_phrases(w, said.union(w.select("asset_id").distinct().select("asset_id", F.lit("nowhere at all"))))


@query(select(SEGMENTS + _CUES, """
SELECT c.asset_id, c.cue_idx, coalesce(t.en, '') AS en FROM cues c LEFT JOIN (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY turn) AS cue_idx, 't' || turn AS en FROM (SELECT DISTINCT conv_id AS asset_id, turn FROM conversations)) t
ON t.asset_id = c.asset_id AND t.cue_idx = c.cue_idx"""))
def j16_translations(spark, sf_dir):
    """Cues with the translation at the same place."""
    t = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("index")).distinct().withColumn("en", F.concat(F.lit("t"), F.col("index").cast("string")))
    return P.translations(cues(spark, sf_dir), t).select("asset_id", "cue_idx", "en")


@query("WITH RECURSIVE " + WORDS.strip() + r""",
ln AS (SELECT asset_id, line_no, ks, row_number() OVER (PARTITION BY asset_id ORDER BY line_no) AS place FROM (
  SELECT conv_id AS asset_id, CAST(turn AS INTEGER) AS line_no, list_slice(list_filter(regexp_extract_all(coalesce(text, ''), '\S+'), lambda x: length(x) >= 6), 1, 3) AS ks FROM conversations)),
kw AS (SELECT asset_id, line_no, unnest(ks) AS k, generate_subscripts(ks, 1) AS pos FROM ln),
st AS (SELECT asset_id, word_idx, start_us, string_agg(word, '') OVER (PARTITION BY asset_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM words),
hit AS (SELECT DISTINCT kw.asset_id, line_no, pos, word_idx AS j FROM kw JOIN st ON st.asset_id = kw.asset_id AND contains(ahead, k)),
span AS (SELECT asset_id, line_no, pos, j, coalesce(lag(j) OVER (PARTITION BY asset_id, line_no, pos ORDER BY j), -1) AS pj FROM hit),
f AS (SELECT asset_id, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS start_us, 0 AS cur, false AS hit FROM (SELECT DISTINCT asset_id FROM ln)
  UNION ALL SELECT n.asset_id, n.place, CASE WHEN w.word_idx IS NULL THEN coalesce(f.start_us + 600000, 0) ELSE w.start_us END, CASE WHEN w.word_idx IS NULL THEN f.cur ELSE w.word_idx + 1 END, w.word_idx IS NOT NULL
  FROM f JOIN ln n ON n.asset_id = f.asset_id AND n.place = f.place + 1
  LEFT JOIN span b1 ON b1.asset_id = n.asset_id AND b1.line_no = n.line_no AND b1.pos = 1 AND b1.j >= f.cur AND b1.pj < f.cur
  LEFT JOIN span b2 ON b2.asset_id = n.asset_id AND b2.line_no = n.line_no AND b2.pos = 2 AND b2.j >= f.cur AND b2.pj < f.cur
  LEFT JOIN span b3 ON b3.asset_id = n.asset_id AND b3.line_no = n.line_no AND b3.pos = 3 AND b3.j >= f.cur AND b3.pj < f.cur
  LEFT JOIN words w ON w.asset_id = n.asset_id AND w.word_idx = coalesce(b1.j, b2.j, b3.j))
SELECT f.asset_id, line_no, start_us, hit FROM f JOIN ln ON ln.asset_id = f.asset_id AND ln.place = f.place""")
def w18_cursor_matches(spark, sf_dir):
    """The first long words of every turn as keywords, matched on the conversation's words in order."""
    t = D.read(spark, sf_dir, "conversations")
    keys = F.slice(F.filter(D.tokens(F.col("text")), lambda x: F.length(x) >= 6), 1, 3)
    return P.cursor_match(D.words(spark, sf_dir), t.select(F.col("conv_id").alias("asset_id"), F.col("turn").cast("int").alias("line_no"), keys.alias("keywords")))


@query(select(SEGMENTS + _ALL_CUTS + """,
b AS (SELECT *, lag(end_us) OVER w AS before, lead(seg_id) OVER w IS NULL AS is_last, row_number() OVER w = 1 AS is_first FROM ac WINDOW w AS (PARTITION BY asset_id ORDER BY seg_id)),
c AS (SELECT *, CASE WHEN is_first THEN start_us ELSE greatest(start_us, before + 1000) END AS s FROM b)""", """
SELECT asset_id, seg_id, s AS start_us, CASE WHEN is_last THEN end_us ELSE greatest(end_us, s + 50000) END AS end_us FROM c"""))
def t7_guarded_cuts(spark, sf_dir):
    """Cuts kept in order after snapping."""
    return G.valley_guard(all_cuts(spark, sf_dir).drop("fallback"))


@query("WITH RECURSIVE " + (SEGMENTS + _ALL_CUTS).strip() + """,
v AS (SELECT s.asset_id, s.seg_id, s.start_us, s.end_us, ac.start_us AS vs, ac.end_us AS ve, CASE WHEN s.seg_id % 11 = 0 THEN s.start_us - 300000 END AS gs, CASE WHEN s.seg_id % 11 = 0 THEN s.end_us + 400000 END AS ge,
  max(s.seg_id) OVER (PARTITION BY s.asset_id) AS n FROM segments s JOIN ac ON ac.asset_id = s.asset_id AND ac.seg_id = s.seg_id),
f AS (SELECT asset_id, seg_id, start_us AS s, greatest(CASE WHEN seg_id = n THEN end_us ELSE least(ve, end_us + 250000) END, start_us + 50000) AS e FROM v WHERE seg_id = 1
  UNION ALL SELECT asset_id, seg_id, s, greatest(e, s + 50000) FROM (SELECT v.asset_id, v.seg_id, coalesce(gs, greatest(vs, f.e + 1000)) AS s, coalesce(ge, CASE WHEN v.seg_id = n THEN end_us ELSE least(ve, end_us + 250000) END) AS e
    FROM f JOIN v ON v.asset_id = f.asset_id AND v.seg_id = f.seg_id + 1))
SELECT asset_id, seg_id, s AS start_us, e AS end_us FROM f""")
def t7_ordered_valleys(spark, sf_dir):
    """Cuts at valleys, each behind the fixed end of the one before; every eleventh is given and may overlap."""
    raw, moved = Q.segments(spark, sf_dir), all_cuts(spark, sf_dir).select("asset_id", "seg_id", F.col("start_us").alias("valley_start_us"), F.col("end_us").alias("valley_end_us"))
    given = lambda c: F.when(F.col("seg_id") % 11 == 0, c)
    c = raw.select("asset_id", "seg_id", "start_us", "end_us", given(F.col("start_us") - 300000).alias("given_start_us"), given(F.col("end_us") + 400000).alias("given_end_us"))
    return E.guard_valleys(c.join(moved, ["asset_id", "seg_id"]))


_VALLEY_CUTS = f"""WITH {Q._SIGNALS}, p AS (SELECT asset_id, k AS point_id, CAST(asset_id * 7919 % 5000 + k * 1300 AS BIGINT) AS t_us FROM signals, range(3) t(k)),
m AS (SELECT p.*, greatest(t_us - 2500, 0) AS lo, t_us + 2500 AS hi FROM p),
b AS (SELECT m.asset_id, point_id, first(frame_idx ORDER BY rms, frame_idx) AS frame_idx, min(rms) AS rms FROM m JOIN fr ON fr.asset_id = m.asset_id AND frame_idx * 1000 >= lo AND frame_idx * 1000 < hi GROUP BY 1, 2),
c AS (SELECT m.asset_id, m.point_id, t_us, CAST(coalesce(least(greatest(b.frame_idx * 1000 + 500, lo), hi), t_us) AS BIGINT) AS cut_us, coalesce(20 * log10(o.rms + 1e-9) - 20 * log10(b.rms + 1e-9), 0) AS gain_db
  FROM m LEFT JOIN b ON b.asset_id = m.asset_id AND b.point_id = m.point_id LEFT JOIN fr o ON o.asset_id = m.asset_id AND o.frame_idx = t_us // 1000)"""


def valley_cuts(spark, sf_dir):
    """Three points in the frames, of 1 ms, of each signal, the last ones behind its end now and then."""
    s = Q.signals(spark, sf_dir)
    p = s.select("asset_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("point_id"))
    p = p.withColumn("t_us", (F.col("asset_id") * 7919 % 5000 + F.col("point_id") * 1300).cast("long")).withColumn("point_id", F.col("point_id").cast("long"))
    return G.valley_cuts(p, G.frame_rms(s, 8), 1000, 2500)


@query(_VALLEY_CUTS + " SELECT asset_id, point_id, t_us, cut_us, round(gain_db, 6) AS gain_db FROM c")
def t5_valley_cuts(spark, sf_dir):
    """Cuts in the middle of the quietest frame near each point, and what each gains."""
    return valley_cuts(spark, sf_dir).withColumn("gain_db", F.round("gain_db", 6))


@query(_VALLEY_CUTS + " SELECT asset_id, count(*) AS cuts, round(avg(gain_db), 6) AS mean_gain_db FROM c GROUP BY 1")
def a21_mean_gains(spark, sf_dir):
    """The mean gain of a recording's cuts."""
    return valley_cuts(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("cuts"), F.round(F.avg("gain_db"), 6).alias("mean_gain_db"))


@query(f"""WITH {Q._SIGNALS}, s AS (SELECT asset_id, CAST(asset_id % 4 AS INTEGER) AS a, CAST(7 - asset_id % 3 AS INTEGER) AS b FROM signals),
l AS (SELECT s.asset_id, first(frame_idx ORDER BY rms, frame_idx) AS a2 FROM s JOIN fr ON fr.asset_id = s.asset_id AND frame_idx BETWEEN a AND a + 2 GROUP BY 1),
r AS (SELECT s.asset_id, first(frame_idx ORDER BY rms, frame_idx DESC) AS b2 FROM s JOIN fr ON fr.asset_id = s.asset_id AND frame_idx BETWEEN b - 2 AND b GROUP BY 1)
SELECT s.asset_id, CASE WHEN b2 - a2 >= 2 THEN a2 ELSE a END AS start_frame, CASE WHEN b2 - a2 >= 2 THEN b2 ELSE b END AS end_frame FROM s JOIN l ON l.asset_id = s.asset_id JOIN r ON r.asset_id = s.asset_id""")
def t6_snapped_edges(spark, sf_dir):
    """Starts snapped to a quiet frame on their right, ends to one on their left; short results are undone."""
    sig = Q.signals(spark, sf_dir)
    edges = sig.select("asset_id", (F.col("asset_id") % 4).cast("int").alias("start_frame"), (7 - F.col("asset_id") % 3).cast("int").alias("end_frame"))
    return G.snap_edges(edges, G.frame_rms(sig, 8), 2, 2)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
f AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM f GROUP BY user_id, s""")
def st2_event_sessions(spark, sf_dir):
    """ST2: sessions of users' events with pauses of up to six hours (the function also runs on streams)."""
    e = D.read(spark, sf_dir, "events").select("user_id", "ts")
    return ingest.sessions(e, "user_id", 6 * 3600 * 1000).withColumnsRenamed({"start": "start_ts", "end": "end_ts"})


@query("""SELECT user_id AS asset_id, event_type AS chunk, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) WHERE user_id % 3 <> 0 OR event_type <> 'click' GROUP BY 1, 2""")
def st1_new_chunks(spark, sf_dir):
    """ST1: rows that arrive twice count once, and chunks that are done don't come again."""
    e = D.read(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_type").alias("chunk"), F.col("event_id").alias("word_idx"), "ts")
    done = e.filter("asset_id % 3 = 0 and chunk = 'click'")
    fresh = ingest.new_chunks(ingest.chunks_once(e.union(e)), done)
    return fresh.groupBy("asset_id", "chunk").agg(F.count("*").alias("n"))
