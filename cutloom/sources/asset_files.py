"""One file for each asset, as players and editors read them: a Spark data source that writes lines, and readers.

Tasks write under names of their own attempt and tell the driver what they wrote; only then, in commit(), do files take their
names, so a task that is repeated or given up leaves nothing.  Every asset's lines must reach one task in order, which
write_lines() sees to.
"""

from __future__ import annotations

import uuid
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cutloom.functions import text as T
from cutloom.sources.files import whole_files
from cutloom.sources.tables import by_asset

Lines = namedtuple("Lines", "asset_id line")


def filesystem(path: str):
    """pyarrow's file system and the path in it; a bare path is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Pairs (name while written, final name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class LineWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", "txt"), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, base = filesystem(self.path)
        # A folder for each attempt, as tasks that make files in the same one wait for each other.
        folder = f"{self.pending}/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        out, done, asset, stream = Written(), set(), None, None
        for row in rows:
            if row.asset_id != asset:
                if stream:
                    stream.close()
                if row.asset_id in done:
                    raise ValueError(f"lines of asset {row.asset_id} don't stand together")
                asset = row.asset_id
                done.add(asset)
                own = f"{folder}/{len(done)}"
                stream = fs.open_output_stream(f"{base}/{own}")
                out.files.append((own, f"{quote(asset, safe='')}.{self.suffix}"))
            stream.write((row.line + "\n").encode())
        if stream:
            stream.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(FileSelector(base)):
                if info.type == FileType.File:
                    fs.delete_file(info.path)
        for own, name in (pair for m in messages if m for pair in m.files):
            fs.move(f"{base}/{own}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Whatever attempts have left goes."""
        from pyarrow.fs import FileType

        fs, base = filesystem(self.path)
        if fs.get_file_info(f"{base}/{self.pending}").type == FileType.Directory:
            fs.delete_dir(f"{base}/{self.pending}")


class BatchWriter(LineWriter, DataSourceArrowWriter):
    """Takes Arrow batches; an asset's lines in one go through write() as one."""

    def write(self, batches: Iterator) -> Written:
        return super().write(self.joined(batches))

    @staticmethod
    def joined(batches: Iterator) -> Iterator[Lines]:
        import pyarrow.compute as pc

        for batch in batches:
            runs, lines, start = pc.run_end_encode(batch.column("asset_id")), batch.column("line").to_pylist(), 0
            for asset, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                yield Lines(asset, "\n".join(lines[start:end]))
                start = end


class AssetFiles(DataSource):
    """Format assetfiles; options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "assetfiles"

    def schema(self) -> str:
        return "asset_id string, line_no long, line string"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, overwrite)


def write_lines(lines: DataFrame, path: str, suffix: str) -> None:
    """lines(asset_id, line_no, line) -> path/<asset_id>.<suffix> for each asset, its lines by number; files of this name are
    replaced, others go.  Rows without an asset or a line are left out."""
    lines.sparkSession.dataSource.register(AssetFiles)
    rows = lines.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line"))
    # Dealt over a set number of tasks: merged by their size, few would be left for the many files.
    rows = by_asset(rows.filter("asset_id is not null and line is not null")).sortWithinPartitions("asset_id", "line_no", "line")
    rows.write.format("assetfiles").mode("overwrite").option("suffix", suffix).save(path)


def write_documents(documents: DataFrame, path: str, suffix: str = "json") -> None:
    """documents(asset_id, document) -> a file for each asset."""
    write_lines(documents.select("asset_id", F.lit(0).alias("line_no"), F.col("document").alias("line")), path, suffix)


def write_edl_files(rows: DataFrame, path: str, fields: list[str]) -> None:
    """A decision document for each asset, its segments by the first of fields."""
    each = rows.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments"))
    write_documents(each.select("asset_id", F.to_json(F.struct("asset_id", "segments")).alias("document")), path)


def write_srt(cues: DataFrame, path: str) -> None:
    """cues(asset_id, cue_idx, start_us, end_us, text, text_2) as a subtitle file for each asset; line ends inside a text
    become spaces, as a blank line would end the cue."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*[\r\n]+\s*", " ")
    second = F.nullif(flat(F.col("text_2")), F.lit(""))
    line = F.concat_ws("\n", F.col("cue_idx").cast("string"), F.concat(T.timecode_srt(F.col("start_us")), F.lit(" --> "), T.timecode_srt(F.col("end_us"))), flat(F.col("text")), second, F.lit(""))
    write_lines(cues.select("asset_id", F.col("cue_idx").alias("line_no"), line.alias("line")), path, "srt")


def write_ass(lines: DataFrame, path: str) -> None:
    """Event lines(asset_id, cue_idx, style, line) as a file for each asset, under the fixed headings."""
    # Fixed values of the format.
    head = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
    heads = lines.select("asset_id").distinct().select("asset_id", F.lit(-1).cast("long").alias("line_no"), F.lit(head).alias("line"))
    rank = F.when(F.col("style") == "Main", 0).otherwise(1)
    write_lines(heads.unionByName(lines.select("asset_id", (F.col("cue_idx").cast("long") * 2 + rank).alias("line_no"), "line")), path, "ass")


def _files(spark: SparkSession, path: str) -> DataFrame:
    # Spark gives file names in URL form, and the names are quoted ids.
    return whole_files(spark, path).withColumn("asset_id", F.url_decode(F.url_decode("asset_id")))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files -> asset_id (string), cue_idx, start_us, end_us, text, text_2 ('' if there is one line)."""
    cue = r"(?m)^(?=\d+\r?\n\d{2,}:\d\d:\d\d,\d{3} --> )"
    t = _files(spark, path).select("asset_id", F.explode(F.split("value", cue)).alias("c")).filter(F.col("c").rlike(r"^\d+\r?\n"))
    lines = F.split(F.regexp_replace("c", r"\s+$", ""), r"\r?\n")
    t = t.select("asset_id", lines.alias("l"))
    line = lambda i: F.coalesce(F.get("l", F.lit(i)), F.lit(""))
    time = lambda i: T.parse_timecode(F.replace(F.trim(F.get(F.split(line(1), " --> "), F.lit(i))), F.lit(","), F.lit(".")))
    rest = F.array_join(F.slice("l", 4, F.greatest(F.size("l") - 3, F.lit(0))), "\n")
    return t.select("asset_id", line(0).cast("int").alias("cue_idx"), time(0).alias("start_us"), time(1).alias("end_us"), line(2).alias("text"), rest.alias("text_2"))


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    """Event lines of files -> asset_id (string), style, start_us, end_us, text."""
    t = _files(spark, path).select("asset_id", F.explode(F.split("value", r"\r?\n")).alias("line")).filter(F.startswith("line", F.lit("Dialogue:")))
    part = F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", 10)
    return t.select("asset_id", part[3].alias("style"), T.parse_timecode(part[1]).alias("start_us"), T.parse_timecode(part[2]).alias("end_us"), part[9].alias("text"))
