"""Files for each asset: what is written is read back, and repeated tasks leave one file."""

import gzip
import json
import os
from collections import namedtuple

import pyarrow as pa
import pytest

from cutloom.sources import asset_files as A
from cutloom.sources.files import whole_files

CUES = "asset_id string, cue_idx int, start_us long, end_us long, text string, text_2 string"


def cues(n=40):
    return [(f"a/b {a}", i, i * 2_000_000, i * 2_000_000 + 1_500_000, f"text {i}, said", f"second {i}" if i % 3 else None) for a in range(5) for i in range(1, n)]


def test_subtitles_come_back(spark, tmp_path):
    df = spark.createDataFrame(cues() + [(None, 1, 0, 1, "x", None)], CUES).repartition(7)
    A.write_srt(df, str(tmp_path / "srt"))
    assert sorted(os.listdir(tmp_path / "srt")) == [f"a%2Fb%20{a}.srt" for a in range(5)]
    assert sorted(map(tuple, A.read_srt(spark, str(tmp_path / "srt")).collect())) == sorted((*c[:5], c[5] or "") for c in cues())
    assert (tmp_path / "srt" / "a%2Fb%200.srt").read_text().startswith("1\n00:00:02,000 --> 00:00:03,500\ntext 1, said\nsecond 1\n\n2\n")
    lines = df.selectExpr("asset_id", "cue_idx", "'Main' as style", "concat('Dialogue: 0,0:00:0', cue_idx % 10, '.00,0:01:00.50,Main,,0,0,0,,', text) as line")
    A.write_ass(lines, f"file://{tmp_path}/ass")
    got = A.read_ass(spark, str(tmp_path / "ass")).collect()
    assert sorted((r.asset_id, r.style, r.start_us, r.end_us, r.text) for r in got) == sorted((c[0], "Main", c[1] % 10 * 1_000_000, 60_500_000, c[4]) for c in cues())


def test_writing_again_replaces_and_drops(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "asset_id string, line_no long, line string")
    A.write_lines(df, str(tmp_path), "txt")
    A.write_lines(df.filter("asset_id = 'b'").selectExpr("asset_id", "line_no", "'z' as line"), str(tmp_path), "txt")
    assert os.listdir(tmp_path) == ["b.txt"] and (tmp_path / "b.txt").read_text() == "z\n"
    A.write_lines(df.limit(0), str(tmp_path), "txt")
    assert os.listdir(tmp_path) == []


def test_a_repeated_attempt_leaves_one_file(tmp_path):
    row = namedtuple("row", "asset_id line_no line")
    rows = [row("a", i, str(i)) for i in range(3)]
    w = A.LineWriter({"path": str(tmp_path), "suffix": "txt"}, True)
    w.write(iter(rows[:2]))  # an attempt that was lost after it wrote
    w.commit([w.write(iter(rows)), None])
    assert os.listdir(tmp_path) == ["a.txt"] and (tmp_path / "a.txt").read_text() == "0\n1\n2\n"
    w.write(iter(rows))
    w.abort([])
    assert os.listdir(tmp_path) == ["a.txt"]
    with pytest.raises(ValueError):
        w.write(iter([rows[0], row("b", 0, ""), rows[1]]))


def test_decision_documents(spark, tmp_path):
    df = spark.createDataFrame([(7, 2, True), (7, 1, False), (9, 1, True)], "asset_id long, id int, keep boolean")
    A.write_edl_files(df, str(tmp_path), ["id", "keep"])
    assert json.loads((tmp_path / "7.json").read_text()) == {"asset_id": 7, "segments": [{"id": 1, "keep": False}, {"id": 2, "keep": True}]}


def test_many_small_files_take_few_steps(spark, tmp_path):
    """Lines of an asset reach the writer joined, tasks are not merged by size, and plain files are read as bytes."""
    batches = [pa.record_batch([a, list(range(len(a))), [f"{x}{i}\n" for i, x in enumerate(a)]], names=["asset_id", "line_no", "line"]) for a in (["a", "a", "b"], ["b", "b", "c"])]
    w = A.AssetFiles({"path": str(tmp_path / "one")}).writer(None, True)
    w.commit([w.write(iter(batches))])
    assert {f: (tmp_path / "one" / f).read_text() for f in os.listdir(tmp_path / "one")} == {"a.txt": "a0\n\na1\n\n", "b.txt": "b2\n\nb0\n\nb1\n\n", "c.txt": "c2\n\n"}
    with pytest.raises(ValueError):
        w.write(iter([batches[0], batches[0]]))
    assert [tuple(x) for x in w.joined(batches[:1])] == [("a", "a0\n\na1\n"), ("b", "b2\n")]

    spark.sparkContext.setJobGroup("write", "write")
    A.write_srt(spark.createDataFrame(cues(), CUES), str(tmp_path / "srt"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    last = max(s for j in tracker.getJobIdsForGroup("write") for s in tracker.getJobInfo(j).stageIds)
    assert tracker.getStageInfo(last).numTasks == 4
    assert "binaryFile" in A.read_srt(spark, str(tmp_path / "srt"))._jdf.queryExecution().optimizedPlan().toString()


def test_whole_files(spark, tmp_path):
    files = {"a.md": "x\r\ny\n", "b": "é，\n", "c.md": ""}  # an empty file gives no row, as with the reader of texts
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "d.md.gz").write_bytes(gzip.compress(b"packed\n"))
    assert {r.asset_id: r.value for r in whole_files(spark, str(tmp_path)).collect()} == {"a": "x\r\ny\n", "b": "é，\n", "d.md": "packed\n"}
    for i in range(200):
        (tmp_path / f"{i}.md").write_bytes(b"x")
    many = whole_files(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 4 and many.count() == 203
