"""Readers and writers on small files."""

import json

import pytest

from cutloom.sources import files as f


@pytest.fixture
def folder(tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
        return str(tmp_path / name)

    return put


def test_transcripts_and_chunks(spark, folder, tmp_path):
    word = lambda w, s, **k: {"word": w, "start": s, "end": s + 0.5, **k}
    folder("c1.json", {"words": [word("a", 0.0, confidence=0.5), word("b", 1.0)]})
    folder("c2.json", {"words": [word("c", 0.25)]})
    folder("c3.json", {"words": []})
    w = f.read_transcripts(spark, str(tmp_path / "c*.json"))
    assert {(r.asset_id, r.word_idx, r.word, r.start_us, r.confidence) for r in w.collect()} == {("c1", 0, "a", 0, 0.5), ("c1", 1, "b", 1_000_000, None), ("c2", 0, "c", 250_000, None)}
    m = spark.createDataFrame([("c1", "x", 1, 0), ("c2", "x", 2, 50_000_000)], "chunk string, asset string, seq int, offset_us long")
    assert [(r.asset_id, r.word_idx, r.word, r.start_us) for r in f.stitch(w, m).orderBy("word_idx").collect()] == [("x", 0, "a", 0), ("x", 1, "b", 1_000_000), ("x", 2, "c", 50_250_000)]


def test_intervals_and_scripts(spark, folder):
    a = folder("ng.json", [{"start_s": 1, "end_s": 2.5, "reason": "cough"}, {"start_s": 3, "end_s": 4}])
    assert [tuple(r)[1:] for r in f.read_intervals(spark, a).orderBy("start_us").collect()] == [(1_000_000, 2_500_000, "cough", ""), (3_000_000, 4_000_000, "llm_drop", "")]
    b = folder("rev.json", {"edl_drop_intervals": [{"start_s": 1, "end_s": 2, "drop_id": "d"}]})
    assert f.read_intervals(spark, b, "edl_drop_intervals").first().drop_id == "d"
    s = folder("s.md", "# t\nintro\n## SCRIPT\n一句。二句！\n\nlast line\n## END\nafter。")
    assert [r.script_text for r in f.script_sentences(spark, s, "SCRIPT", "END").orderBy("sent_id").collect()] == ["一句。", "二句！", "last line"]
    assert f.script_sentences(spark, s, "NONE", "END").count() == 0
    assert [r.text for r in f.script_lines(spark, folder("l.md", "# h\n\n---\nx\n ───\ny\n")).orderBy("line_no").collect()] == ["x", "y"]


def test_edl_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([(7, 1, True, 0, 1_500_000, "hi"), (7, 2, False, 1_500_000, 2_000_000, "um")], "asset_id long, seg_id int, keep boolean, start_us long, end_us long, text string")
    rows = f.edl_rows(rules)
    f.write_edl_json(rows, str(tmp_path / "j"))
    back = f.read_edl(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, back.select("id", "keep", "start", "end_s", "text").collect())) == [(1, True, "00:00:00.000", 1.5, "hi"), (2, False, "00:00:01.500", 2.0, "um")]
    f.write_edl_csv(rows, str(tmp_path / "c"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert csv.columns == ["asset_id", *f.EDL_COLUMNS] and {r.duration_s for r in csv.collect()} == {"1.5", "0.5"}
    pairs = spark.createDataFrame([(7, 3, 0.9, "full_repeat", (0, 5), (9, 12)), (7, 4, 0.5, "x", (0, 1), (2, 3))], "asset_id long, pair_id int, similarity double, dup_type string, seg_a struct<start_us:long,end_us:long>, seg_b struct<start_us:long,end_us:long>")
    assert [tuple(r) for r in f.duplicate_drops(pairs).collect()] == [(7, 0, 5, "full_repeat", "SD_3")]


def test_overlays_checklists_and_boards(spark, folder):
    o = f.read_overlays(spark, folder("o.json", {"fps": 25, "inserts": [{"id": "a", "template": "title", "vars": {"text": "x", "n": 3}}]})).first()
    assert (o.fps, o.width, o.theme, o.vars) == (25, 1080, "frosted", {"text": "x", "n": "3"})
    c = f.read_checklist(spark, folder("k.json", {"items": [{"id": "1", "output_window_s": None, "keywords_absent": []}]})).first()
    assert c.output_window_s is None and c.keywords_absent == []
    text = "# Board\n### Scene 01 · 0s–4.5s · hook · Opening\n- 组件：card\n- narration: hello: you\n\n### Scene 02 · 4.5s–9s · body · Next\n- 组件：list\n"
    s = f.storyboard_scenes(spark, folder("b.md", text)).orderBy("scene_no").collect()
    assert [(r.scene_no, r.start_s, r.end_s, r.role, r.title) for r in s] == [(1, 0.0, 4.5, "hook", "Opening"), (2, 4.5, 9.0, "body", "Next")]
    assert s[0].fields == {"组件": "card", "narration": "hello: you"}
