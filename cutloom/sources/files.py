"""Readers and writers of transcript, decision and subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions import text as T

WORD = "struct<word:string,start:double,end:double,confidence:double>"
TRANSCRIPT = f"source string, model string, language string, language_probability double, duration_s double, transcribe_time_s double, words array<{WORD}>, segments array<struct<start:double,end:double,text:string>>"
EDL_COLUMNS = "id,keep,start,end,start_s,end_s,text,script_line,pad_in_ms,pad_out_ms,reason,decided_by,note,duration_s".split(",")


def _asset() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Files -> asset_id (the name without its ending), value: the whole text.  Plain files are read as bytes, as the reader of
    texts sets up configuration and codecs for each file, which takes longer than reading a small one; compressed files go
    through it.  Spark gives a task a few files only, however small they are; here at most as many tasks as shuffles have share them."""
    packed = "bz2", "deflate", "gz", "lz4", "snappy", "zst"
    plain = spark.read.format("binaryFile").load(path).filter(~F.col("_metadata.file_name").rlike(rf"\.({'|'.join(packed)})$"))
    texts = spark.read.option("pathGlobFilter", f"*.{{{','.join(packed)}}}").text(path, wholetext=True)
    return plain.select(_asset().alias("asset_id"), F.col("content").cast("string").alias("value")).union(texts.select(_asset(), "value")).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file -> words(asset_id, word_idx, word, start_us, end_us, confidence), in the order of the
    list.  The asset is the file's name without its ending; empty word lists give no rows, missing confidence null."""
    t = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).select(_asset().alias("asset_id"), F.posexplode("words").alias("word_idx", "w"))
    us = lambda c: F.round(c * 1000000).cast("long")
    return t.select("asset_id", "word_idx", "w.word", us(F.col("w.start")).alias("start_us"), us(F.col("w.end")).alias("end_us"), "w.confidence")


def stitch(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunk words(asset_id, ...) and manifest(chunk, asset, seq, offset_us) -> one timeline, renumbered by start, seq
    and position."""
    m = manifest.select(F.col("chunk").alias("_chunk"), F.col("asset").alias("_asset"), "seq", "offset_us")
    j = chunks.join(m, F.col("asset_id") == F.col("_chunk"))
    j = j.withColumns({"start_us": F.col("start_us") + F.col("offset_us"), "end_us": F.col("end_us") + F.col("offset_us")})
    order = Window.partitionBy("_asset").orderBy("start_us", "seq", "word_idx")
    return j.withColumn("n", F.row_number().over(order) - 1).select(F.col("_asset").alias("asset_id"), F.col("n").alias("word_idx"), "word", "start_us", "end_us", "confidence")


def read_intervals(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Windows to drop, a JSON array or the array field of a document; reasons default to llm_drop, ids to ''."""
    one = "struct<start_s:double,end_s:double,reason:string,drop_id:string>"
    df = spark.read.schema(f"{field} array<{one}>" if field else "start_s double, end_s double, reason string, drop_id string").option("multiLine", True).json(path)
    df = df.select(_asset().alias("asset_id"), F.explode(field).alias("d")).select("asset_id", "d.*") if field else df.select(_asset().alias("asset_id"), "*")
    us = lambda c: F.round(F.col(c) * 1000000).cast("long")
    return df.select("asset_id", us("start_s").alias("start_us"), us("end_s").alias("end_us"), F.coalesce("reason", F.lit("llm_drop")).alias("reason"), F.coalesce("drop_id", F.lit("")).alias("drop_id"))


def duplicate_drops(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The earlier segment of each pair at the threshold as a drop."""
    return pairs.filter(F.col("similarity") >= threshold).select("asset_id", F.col("seg_a.start_us").alias("start_us"), F.col("seg_a.end_us").alias("end_us"), F.col("dup_type").alias("reason"), F.concat(F.lit("SD_"), F.col("pair_id").cast("string")).alias("drop_id"))


def edl_rows(rules: DataFrame) -> DataFrame:
    """Standard decision rows; start, end as timecodes where they are missing, notes ''."""
    has = set(rules.columns)
    of = lambda c, default: F.coalesce(F.col(c), default) if c in has else default
    return rules.select(
        "asset_id", F.col("seg_id").alias("id"), "keep", of("start", T.timecode(F.col("start_us"))).alias("start"), of("end", T.timecode(F.col("end_us"))).alias("end"),
        (F.col("start_us") / F.lit(1000000.0)).alias("start_s"), (F.col("end_us") / F.lit(1000000.0)).alias("end_s"), of("text", F.lit("")).alias("text"),
        of("script_line", F.lit("")).alias("script_line"), of("pad_in_ms", F.lit(0)).alias("pad_in_ms"), of("pad_out_ms", F.lit(0)).alias("pad_out_ms"),
        of("reason", F.lit("")).alias("reason"), of("decided_by", F.lit("rule")).alias("decided_by"), of("note", F.lit("")).alias("note"),
    )


def write_edl_json(rows: DataFrame, path: str) -> None:
    """One nested document per asset."""
    fields = [c for c in EDL_COLUMNS if c != "duration_s"]
    rows.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments")).write.json(path)


def read_edl(spark: SparkSession, path: str) -> DataFrame:
    """Decision documents -> rows."""
    one = "struct<id:int,keep:boolean,start:string,end:string,start_s:double,end_s:double,text:string,script_line:string,pad_in_ms:int,pad_out_ms:int,reason:string,decided_by:string,note:string>"
    return spark.read.schema(f"asset_id long, segments array<{one}>").json(path).selectExpr("asset_id", "inline(segments)")


def write_edl_csv(rows: DataFrame, path: str) -> None:
    """The fixed columns, durations in seconds to 3 decimals."""
    rows.withColumn("duration_s", F.round(F.col("end_s") - F.col("start_s"), 3)).select("asset_id", *EDL_COLUMNS).write.option("header", True).csv(path)


def srt_text(cues: DataFrame) -> DataFrame:
    """asset_id, srt: numbered cues with times and one or two lines, blank lines between."""
    second = F.when(F.coalesce("text_2", F.lit("")) != "", F.concat(F.col("text_2"), F.lit("\n"))).otherwise("")
    one = F.concat(F.col("cue_idx").cast("string"), F.lit("\n"), T.timecode_srt(F.col("start_us")), F.lit(" --> "), T.timecode_srt(F.col("end_us")), F.lit("\n"), F.col("text"), F.lit("\n"), second)
    each = cues.select("asset_id", "cue_idx", one.alias("one")).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("cue_idx", "one"))).alias("c"))
    return each.select("asset_id", F.array_join(F.transform("c", lambda x: x["one"]), "\n").alias("srt"))


def ass_lines(cues: DataFrame) -> DataFrame:
    """A dialogue line per cue and language."""
    main = F.translate(F.replace(F.col("text"), F.lit(","), F.lit("，")), "\n", " ")
    both = cues.select("asset_id", "cue_idx", "start_us", "end_us", F.lit("Main").alias("style"), main.alias("t")).unionByName(cues.select("asset_id", "cue_idx", "start_us", "end_us", F.lit("Second").alias("style"), F.translate("text_2", ",", " ").alias("t")))
    line = F.concat(F.lit("Dialogue: 0,"), T.timecode_ass(F.col("start_us")), F.lit(","), T.timecode_ass(F.col("end_us")), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"), F.col("t"))
    return both.select("asset_id", "cue_idx", "style", line.alias("line"))


def script_sentences(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """S3: the section of a script between a line with the start marker and the next with the end marker, as sentences.

    No start marker: no rows.  Blank lines are skipped, sentences end after 。！？； or a line end."""
    t = whole_files(spark, path).select("asset_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    first = F.min(F.when(F.contains("text", F.lit(start)), F.col("line"))).over(Window.partitionBy("asset_id"))
    t = t.withColumn("first", first).filter(F.col("line") > F.col("first"))
    last = F.min(F.when(F.contains("text", F.lit(end)), F.col("line"))).over(Window.partitionBy("asset_id"))
    t = t.withColumn("last", last).filter(F.col("last").isNull() | (F.col("line") < F.col("last"))).filter(~F.contains("text", F.lit(start)) & (F.trim("text") != ""))
    s = t.select("asset_id", "line", F.posexplode(F.split("text", "(?<=[。！？；])")).alias("pos", "s")).withColumn("s", F.trim("s")).filter("s <> ''")
    return s.select("asset_id", F.row_number().over(Window.partitionBy("asset_id").orderBy("line", "pos")).alias("sent_id"), F.col("s").alias("script_text"))


def script_lines(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle lines of a script: no blanks, headings or rules."""
    t = whole_files(spark, path).select("asset_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    t = t.withColumn("text", F.trim("text")).filter("text <> ''").filter(~F.col("text").rlike("^#") & ~F.col("text").rlike("^[-=─]{3,}$"))
    return t.select("asset_id", F.row_number().over(Window.partitionBy("asset_id").orderBy("line")).alias("line_no"), "text")


def read_overlays(spark: SparkSession, path: str) -> DataFrame:
    """Overlay specs -> inserts, with the defaults of a spec; vars stay a map of strings."""
    one = "struct<id:string,template:string,placement:string,start_s:double,end_s:double,vars:map<string,string>,theme:string,based_on:string,note:string,edited_by:string>"
    df = spark.read.schema(f"source string, fps int, width int, height int, theme string, inserts array<{one}>").option("multiLine", True).json(path)
    df = df.select(_asset().alias("spec_id"), F.coalesce("fps", F.lit(30)).alias("fps"), F.coalesce("width", F.lit(1080)).alias("width"), F.coalesce("height", F.lit(1920)).alias("height"), F.coalesce("theme", F.lit("frosted")).alias("spec_theme"), F.posexplode("inserts").alias("pos", "i"))
    return df.select("spec_id", "fps", "width", "height", "pos", "i.*").withColumn("theme", F.coalesce("theme", F.lit("frosted")))


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    """Regression items."""
    one = "struct<id:string,category:string,source_window_s:array<double>,output_window_s:array<double>,verify_method:string,keywords_absent:array<string>,keywords_present:array<string>,min_duration_s:double,max_duration_s:double>"
    return spark.read.schema(f"version string, items array<{one}>").option("multiLine", True).json(path).select(_asset().alias("asset_id"), F.explode("items").alias("i")).select("asset_id", "i.*")


def storyboard_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown scenes "### Scene NN · a s–b s · role · title" with "- field：value" lines -> rows with a map of fields."""
    t = whole_files(spark, path).select(F.col("asset_id").alias("spec_id"), F.explode(F.split("value", r"(?m)^### +(?=Scene)")).alias("b"))
    head = F.regexp_extract("b", r"^([^\n]*)", 1)
    part = lambda i: F.trim(F.try_element_at(F.split(head, "·"), F.lit(i)))
    time = lambda i: F.regexp_extract(part(2), r"([\d.]+)\s*s?\s*[–-]\s*([\d.]+)", i).try_cast("double")
    pairs = F.regexp_extract_all("b", F.lit(r"(?m)^- +([^：:\n]+[：:][^\n]*)"), F.lit(1))
    fields = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^：:]+)", 1)).alias("k"), F.trim(F.regexp_extract(p, r"^[^：:]+[：:](.*)$", 1)).alias("v")))))
    return t.filter(F.col("b").rlike("^Scene")).select("spec_id", F.regexp_extract("b", r"^Scene\s+(\d+)", 1).cast("int").alias("scene_no"), time(1).alias("start_s"), time(2).alias("end_s"), part(3).alias("role"), part(4).alias("title"), fields.alias("fields"))
