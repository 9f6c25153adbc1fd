"""Queries on files for each asset: tables written as players, editors and reviewers read them, and read back, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.plans.edits import _CUES, cues
from cutloom.plans.rules import _ROWS, decision_rows
from cutloom.plans.sql import SEGMENTS, WORDS, select
from cutloom.plans.words import segments
from cutloom.sources import asset_files as files
from cutloom.sources import files as readers
from cutloom.sources import tables as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _numbered(df: DataFrame, name: str = "asset_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


@query(select(SEGMENTS + _CUES, """
SELECT asset_id, cue_idx, (start_us + 500) // 1000 * 1000 AS start_us, (end_us + 500) // 1000 * 1000 AS end_us, text, CASE WHEN cue_idx % 3 > 0 THEN lower(text) ELSE '' END AS text_2 FROM cues"""))
def s12_subtitle_files(spark, sf_dir):
    """A subtitle file for each asset, read back."""
    path = D.scratch(spark, "subtitles")
    files.write_srt(cues(spark, sf_dir).withColumn("text_2", F.when(F.col("cue_idx") % 3 > 0, F.lower("text"))), path)
    return _numbered(files.read_srt(spark, path))


@query(select(SEGMENTS + _CUES, """
SELECT asset_id, style, (start_us + 5000) // 10000 * 10000 AS start_us, (end_us + 5000) // 10000 * 10000 AS end_us, text FROM (
  SELECT asset_id, start_us, end_us, 'Main' AS style, replace(text, ',', '，') AS text FROM cues UNION ALL SELECT asset_id, start_us, end_us, 'Second', replace(lower(text), ',', ' ') FROM cues)"""))
def s13_event_files(spark, sf_dir):
    """A file of events in two languages for each asset, read back."""
    path = D.scratch(spark, "events")
    files.write_ass(readers.ass_lines(cues(spark, sf_dir).withColumn("text_2", F.lower("text"))), path)
    return _numbered(files.read_ass(spark, path))


@query(select(_ROWS, "SELECT * FROM rw"))
def s10_decision_files(spark, sf_dir):
    """A decision document for each asset, read back."""
    path = D.scratch(spark, "decisions")
    files.write_edl_files(decision_rows(spark, sf_dir), path, [c for c in readers.EDL_COLUMNS if c != "duration_s"])
    return readers.read_edl(spark, path)


def _turns(spark, sf_dir) -> DataFrame:
    t = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), "turn", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"))
    return t.withColumn("text", F.translate("text", ".!?", "。！？"))


_TURNS = r"tn AS (SELECT conv_id AS asset_id, turn, translate(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '.!?', '。！？') AS text FROM conversations)"


@query(f"""WITH {_TURNS},
p AS (SELECT asset_id, turn, trim(unnest(string_split(regexp_replace(text, '([。！？；])', '\\1\u0001', 'g'), '\u0001'))) AS s, generate_subscripts(string_split(regexp_replace(text, '([。！？；])', '\\1\u0001', 'g'), '\u0001'), 1) AS k FROM tn WHERE turn > 0)
SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY turn, k) AS INTEGER) AS sent_id, s AS script_text FROM p WHERE s <> ''""")
def s3_script_files(spark, sf_dir):
    """S3: the sentences of each asset's script, between two markers of its file."""
    path, t = D.scratch(spark, "scripts"), _turns(spark, sf_dir)
    line = F.when(F.col("turn") == 0, F.concat(F.lit("about the take\n"), F.lit("## SCRIPT"))).otherwise(F.concat(F.col("text"), F.lit("\n")))
    last = t.select("asset_id").distinct().select("asset_id", F.lit(2**31).alias("line_no"), F.lit("## END\nnot said").alias("line"))
    files.write_lines(t.select("asset_id", F.col("turn").alias("line_no"), line.alias("line")).unionByName(last), path, "md")
    return _numbered(readers.script_sentences(spark, path, "## SCRIPT", "## END"))


@query(f"""WITH {_TURNS}, l AS (SELECT asset_id, turn, CASE turn % 5 WHEN 0 THEN '# ' || text WHEN 1 THEN '---' ELSE text END AS t FROM tn)
SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY turn) AS INTEGER) AS line_no, t AS text FROM l WHERE t <> '' AND t NOT LIKE '#%' AND NOT regexp_matches(t, '^[-=─]{{3,}}$')""")
def s4_script_lines(spark, sf_dir):
    """The lines of each asset's script that are subtitles."""
    path, turn = D.scratch(spark, "lines"), F.col("turn") % 5
    line = F.when(turn == 0, F.concat(F.lit("# "), F.col("text"))).when(turn == 1, "---").otherwise(F.concat(F.col("text"), F.lit("\n")))
    files.write_lines(_turns(spark, sf_dir).select("asset_id", F.col("turn").alias("line_no"), line.alias("line")), path, "md")
    return _numbered(readers.script_lines(spark, path))


def _list(spark, rows: DataFrame, column: Column, order: str, name: str) -> str:
    """rows as a JSON array for each asset, written; column: an element."""
    path = D.scratch(spark, name)
    each = rows.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, column.alias("_x")))), lambda x: x["_x"]).alias("all"))
    files.write_documents(each.select("asset_id", F.to_json("all").alias("document")), path)
    return path


def _seconds(c: str) -> Column:
    return F.col(c) / F.lit(1000000.0)


@query(select(WORDS, "SELECT asset_id, start_us, end_us, CASE WHEN reason = 'rule' THEN 'rule' ELSE 'llm_drop' END AS reason, '' AS drop_id FROM drops"))
def s5_drop_windows(spark, sf_dir):
    """Windows to drop from a list for each asset; some have no reason."""
    d = D.drops(D.words(spark, sf_dir))
    one = F.struct(_seconds("start_us").alias("start_s"), _seconds("end_us").alias("end_s"), F.when(F.col("reason") == "rule", F.col("reason")).alias("reason"))
    return _numbered(readers.read_intervals(spark, _list(spark, d, one, "start_us", "windows")))


@query(select(SEGMENTS, "SELECT asset_id, start_us, end_us, CASE WHEN seg_id % 2 = 0 THEN 'off topic' ELSE 'llm_drop' END AS reason, CASE WHEN seg_id % 3 = 0 THEN 'D' || seg_id ELSE '' END AS drop_id FROM segments WHERE seg_id % 4 < 3"))
def s6_reviewer_drops(spark, sf_dir):
    """A reviewer's intervals from a document for each asset."""
    i, path = F.col("seg_id"), D.scratch(spark, "reviews")
    one = F.struct(_seconds("start_us").alias("start_s"), _seconds("end_us").alias("end_s"), F.when(i % 2 == 0, "off topic").alias("reason"), F.when(i % 3 == 0, F.concat(F.lit("D"), i.cast("string"))).alias("drop_id"))
    each = segments(spark, sf_dir).filter(i % 4 < 3).groupBy("asset_id").agg(F.array_sort(F.collect_list(one)).alias("edl_drop_intervals"))
    files.write_documents(each.select("asset_id", F.to_json(F.struct("edl_drop_intervals")).alias("document")), path)
    return _numbered(readers.read_intervals(spark, path, "edl_drop_intervals"))


@query(select(SEGMENTS, """
SELECT asset_id, CAST(CASE WHEN asset_id % 2 = 0 THEN 25 ELSE 30 END AS INTEGER) AS fps, 1080 AS width, 1920 AS height, 'i' || seg_id AS id, start_us / 1000000.0 AS start_s, end_us / 1000000.0 AS end_s,
  CASE WHEN seg_id % 3 = 0 THEN 'paper' ELSE 'frosted' END AS theme, left(text, 20) AS label FROM segments"""))
def s14_overlay_files(spark, sf_dir):
    """Inserts from an overlay document for each asset, with the defaults of documents."""
    i, path = F.col("seg_id"), D.scratch(spark, "overlays")
    one = F.struct(i.alias("_n"), F.concat(F.lit("i"), i.cast("string")).alias("id"), _seconds("start_us").alias("start_s"), _seconds("end_us").alias("end_s"), F.when(i % 3 == 0, "paper").alias("theme"), F.create_map(F.lit("label"), F.substring("text", 1, 20)).alias("vars"))
    each = segments(spark, sf_dir).groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct(i, F.to_json(one).alias("j")))).alias("s"))
    head = F.when(F.col("asset_id") % 2 == 0, '{"fps":25,"inserts":[').otherwise('{"inserts":[')
    files.write_documents(each.select("asset_id", F.concat(head, F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]}")).alias("document")), path)
    o = readers.read_overlays(spark, path).select(F.col("spec_id").alias("asset_id"), "fps", "width", "height", "id", "start_s", "end_s", "theme", F.col("vars")["label"].alias("label"))
    return _numbered(o)


@query(select(SEGMENTS, """
SELECT asset_id, 'R' || seg_id AS id, CASE WHEN seg_id % 2 = 0 THEN 'keyword_absent' ELSE 'duration_check' END AS verify_method, CASE WHEN seg_id % 5 > 0 THEN start_us / 1000000.0 END AS from_s,
  CASE WHEN seg_id % 2 = 0 THEN 'um,' || n_words END AS absent, CASE WHEN seg_id % 2 = 1 THEN n_words / 2.0 END AS min_duration_s FROM segments"""))
def s15_checklist_files(spark, sf_dir):
    """Regression items from a checklist for each asset."""
    i, path = F.col("seg_id"), D.scratch(spark, "checklists")
    even = i % 2 == 0
    one = F.struct(
        F.concat(F.lit("R"), i.cast("string")).alias("id"), F.when(even, "keyword_absent").otherwise("duration_check").alias("verify_method"), F.when(i % 5 > 0, F.array(_seconds("start_us"), _seconds("end_us"))).alias("output_window_s"),
        F.when(even, F.array(F.lit("um"), F.col("n_words").cast("string"))).alias("keywords_absent"), F.when(~even, F.col("n_words") / F.lit(2.0)).alias("min_duration_s"),
    )
    each = segments(spark, sf_dir).groupBy("asset_id").agg(F.collect_list(one).alias("items"))
    files.write_documents(each.select("asset_id", F.to_json(F.struct(F.lit("1").alias("version"), "items")).alias("document")), path)
    c = readers.read_checklist(spark, path)
    return _numbered(c.select("asset_id", "id", "verify_method", F.get("output_window_s", F.lit(0)).alias("from_s"), F.array_join("keywords_absent", ",").alias("absent"), "min_duration_s"))


@query(select(SEGMENTS, """
SELECT asset_id, seg_id AS scene_no, (start_us // 1000) / 1000.0 AS start_s, (end_us // 1000) / 1000.0 AS end_s, CASE WHEN seg_id = 1 THEN 'hook' ELSE 'body' END AS role, 'part ' || seg_id AS title, trim(left(text, 30)) AS narration, n_words || ' words' AS note FROM segments"""))
def s16_storyboard_files(spark, sf_dir):
    """The scenes of a storyboard in Markdown for each asset."""
    i, path = F.col("seg_id"), D.scratch(spark, "storyboards")
    sec = lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000000), F.floor(F.col(c) / 1000) % 1000)
    head = F.concat(F.lit("### Scene "), F.lpad(i.cast("string"), 6, "0"), F.lit(" · "), sec("start_us"), F.lit("s–"), sec("end_us"), F.lit("s · "), F.when(i == 1, "hook").otherwise("body"), F.lit(" · part "), i.cast("string"))
    body = F.concat(head, F.lit("\n\n- narration："), F.substring("text", 1, 30), F.lit("\n- note: "), F.col("n_words").cast("string"), F.lit(" words\n"))
    files.write_lines(segments(spark, sf_dir).select("asset_id", i.alias("line_no"), body.alias("line")), path, "md")
    s = readers.storyboard_scenes(spark, path)
    return _numbered(s.select(F.col("spec_id").alias("asset_id"), "scene_no", "start_s", "end_s", "role", "title", F.col("fields")["narration"].alias("narration"), F.col("fields")["note"].alias("note")))
