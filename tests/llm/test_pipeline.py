"""Every stage of the pipeline on what the one before kept."""


import corpus_pipeline as p
import numpy as np
from test_decontaminate import brute as leaks
from test_neardup import brute as groups
from test_packing import hold

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in p.STAGES] == ["quality", "language", "neardup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = [docs], docs.columns
    for _, stage in p.STAGES[:-1]:
        df = stage(spark, kept[-1], SF)
        assert df.columns == columns
        kept.append(spark.createDataFrame(df.collect(), docs.schema))
    rows = [{r.doc_id: r.text for r in df.collect()} for df in kept]
    assert all(b.items() <= a.items() for a, b in zip(rows, rows[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(d in rows[1]) == (labels[d] == 1) for d in rows[0] if d in labels]) > 0.9
    assert len(rows[2]) > 0.98 * len(rows[1])
    assert rows[3].keys() == {d for d, (_, _, k) in groups(list(rows[2].items()), (80, 100)).items() if k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows[4].keys() == {d for d, *_, bad in leaks(list(rows[3].items()), items) if not bad}
    hold(list(rows[4].items()), p.STAGES[-1][1](spark, kept[-1], SF).collect())
    assert p.run(spark, SF).count() > 0


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "de", None, 3), (3, "word " * 50_000, "en", "b", 250_000), (3, "word " * 50_000, "en", "b", 250_000)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() <= len(rows)


def test_rows_that_share_an_id_are_told_by_their_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "b " * 30, "en", "s", 60), (1, "a " * 30, "en", "s", 60), (1, "a " * 30, "en", None, 60), (1, None, "en", "z", 0), (2, "own words of this one", "en", None, 3)]
    for n in (1, 3):
        out = p.neardup_stage(spark, spark.createDataFrame(rows, schema).repartition(n), SF).collect()
        assert sorted(map(tuple, out)) == [(1, "a " * 30, "en", None, 60), (2, "own words of this one", "en", None, 3)]


def test_columns_with_odd_names_and_types(spark):
    schema = "doc_id long, `a.b` string, text string, _kept int, _none map<string,int>, _row string, _c0 binary, lang string, hits struct<`x.y`:int>"
    rows = [(i, "s", t, i, {"k": i}, None, b"z", "en", (i,)) for i, t in enumerate(["plain words of a text that says a little " * 9, None, "", "plain words of a text that says a little " * 9])]
    rows += [(0, "s", rows[0][2], 9, {"k": 1}, None, b"z", "en", None), (None, None, "x", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema and all(r in docs.collect() for r in out.collect())
    assert sorted((r.doc_id is None, r.doc_id, r._kept) for r in p.neardup_stage(spark, docs, SF).collect()) == [(False, 0, 0), (False, 1, 1), (False, 2, 2), (True, None, None)]
