"""Quality, language and token counts: held-out accuracy, exact library counts, small algebra checks, odd rows."""

import random
import zlib

import numpy as np
import sentencepiece

from cutloom.llm import language as lang
from cutloom.llm import quality as q
from cutloom.llm import token_counts as tc
from cutloom.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"
MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "x"), (5, "12 34 !!"), (6, "a" * 200_000), (7, "the cat " * 40_000), (7, "the cat"), (8, "\x00�日本")]


def odd(spark):
    return spark.createDataFrame([(a, b, "en", 0.5, 1) for a, b in ODD], "doc_id long, text string, lang string, score double, held_out int")


def test_trees_learn_and_flat_walk_equals_a_plain_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = q.fit(x[:2000], y[:2000], trees=30, depth=3)
    score = trees.score(x)
    assert ((score[2000:] > 0.5) == y[2000:]).mean() > 0.95
    for row, s in zip(x[:50], score[:50]):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < 7:
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            total += leaf[at - 7]
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9
    assert (q.fit(np.zeros((0, 6), np.float32), np.zeros(0)).score(x[:3]) == 0.5).all()
    assert (q.fit(x[:9], np.ones(9)).score(x[:3]) > 0.9).all()


def test_quality_query_holds_out(spark):
    out = {r.doc_id: r for r in q.op4_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in out.items())
    held = [(out[r.doc_id].predicted, r.quality) for r in labels if out[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_odd_rows(spark):
    df = odd(spark)
    trees = q.train(df, spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    assert q.classify(df, trees).count() == len(ODD) and q.classify(df.limit(0), trees).count() == 0
    assert q.keep_good(df, trees, 0.0).columns == df.columns and q.keep_good(df, trees, 0.0).count() == len(ODD)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    e, a, s = rng.random((1, 4, 3)), rng.random((3, 3)), rng.random(3)
    there = np.array([[True, True, True, False]])
    e[0, 3] = 1
    post = lang.forward_backward(e, there, a, s)[0][0, :3]
    want = np.zeros((3, 3))
    for p in np.ndindex(3, 3, 3):
        w = s[p[0]] * e[0, 0, p[0]] * a[p[0], p[1]] * e[0, 1, p[1]] * a[p[1], p[2]] * e[0, 2, p[2]]
        for t in range(3):
            want[t, p[t]] += w
    assert np.allclose(post, want / want.sum(axis=1, keepdims=True))


def test_language_query_holds_out(spark):
    out = {r.doc_id: r for r in lang.op7_language(spark, SF).collect()}
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [out[d].lang_pred == x for d, x in docs.items() if out[d].held_out and x]
    assert len(out) == len(docs) and np.mean(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in out.items())


def test_language_odd_rows_and_switches(spark):
    texts = [("the cat and the dog were here with you", "en"), ("der hund und die katze sind nicht hier", "de")] * 20
    model = lang.fit(texts)
    names, share = lang.label(model, ["the dog and the cat", "die katze und der hund", None, "", "12 !!", "the cat and the dog der hund und die katze"])
    assert names[:5] == ["en", "de", "und", "und", "und"] and share[5] < 0.9 and share[2] == 0
    df = odd(spark)
    out = {r.doc_id: r.lang_pred for r in lang.identify(df, model).collect()}
    assert out[1] == out[2] == out[3] == out[5] == "und" and out[7] == "en"
    assert lang.identify(df.limit(0), model).count() == 0
    assert {r.doc_id for r in lang.keep_identified(df, model).collect()}.isdisjoint({1, 2, 3, 5})
    assert lang.label(lang.fit([]), ["a"])[0] == ["und"] and lang.label(model, []) [0] == []
    assert lang.train(df.limit(0)).languages == []


def test_counts_of_every_prefix():
    m, library = tc.PrefixCounts(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    parts = ["a", "e", "in", "th", "er", " ", "  ", "\n", "é", "ß", ".", "...", "<s>", "日", "🙂", "\t", "0", "12", "▁", "tion", "The", "​", "<unk>", "x"]
    texts = ["", " ", "  ", "\n", "a ", "a\n b", "\nabc"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 18))) for _ in range(1500)]
    assert m.counts(texts).tolist() == [len(library.encode(t)) for t in texts]
    for t in texts[:300]:
        want = [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        assert m.prefixes(t).tolist() == want
        assert m.truncation(t, 3) == max(i for i, n in enumerate(want) if n <= 3)


def test_token_count_query_and_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op8_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert out == {d: (len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts.items()}
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tc.token_counts(odd(spark), MODEL).collect())
    assert got == sorted((d or 0, len(library.encode(t or ""))) for d, t in ODD)
    assert tc.token_counts(odd(spark).limit(0), MODEL).count() == 0
    tables = {r.doc_id: r for r in tc.prefix_tables(odd(spark).filter("doc_id < 6"), MODEL, [0, 2]).collect()}
    assert tables[1].prefix_tokens == [0] and tables[5].cut_chars[0] == 0 and len(tables[5].prefix_tokens) == 9


def test_a_long_chain_is_one_chain():
    rng = np.random.default_rng(4)
    for lengths in ([1, 5, 64, 65, 66, 128, 129, 700], [2], [200], []):
        n = np.array(lengths, dtype=np.int64)
        emission, a, s = rng.random((50, 3)) ** 4, rng.random((3, 3)) ** 2, rng.random(3)
        codes = rng.integers(0, 50, n.sum())
        got = lang.chain_shares(emission, codes, n, a, s)
        for i, end in enumerate(np.cumsum(n)):
            e = emission[codes[end - n[i] : end]][None]
            assert np.allclose(got[i], lang.forward_backward(e, np.ones(e.shape[:2], bool), a, s)[0][0].sum(axis=0))


def test_word_65_sees_word_64():
    emission, a, s = np.array([[1.0, 1.0], [1.0, 1e-9]]), np.array([[1.0, 1e-6], [1e-6, 1.0]]), np.ones(2)
    share = lang.chain_shares(emission, np.array([0] * 63 + [1] + [0] * 36), np.array([100]), a, s)
    assert share[0, 0] > 99.9


def test_all_letters_of_a_long_word_count():
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(100))
    for at in (3, 30, 50, 80, 97):
        other = long[:at] + "z" + long[at + 1 :]
        one, two = lang.hashed([long, other, "short"]), lang.hashed(["x", other, long])
        assert sorted(one.of(np.array([0]))[0].tolist()) == sorted(two.of(np.array([2]))[0].tolist())
        assert sorted(one.of(np.array([0]))[0].tolist()) != sorted(one.of(np.array([1]))[0].tolist())
    assert lang.hashed([long]).count[0] == 101 + 100 + 2
    model = lang.fit([("aaab " * 20, "x"), ("zzzy " * 20, "y")] * 10)
    assert lang.label(model, ["zq" * 6 + "a" * 80 + "zq" * 6, "a" * 3000])[0] == ["x", "x"]


def test_quality_query_equals_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    trees = q.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality"))
    out = {r.doc_id: r.score for r in q.op4_quality(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        x, total = np.float32(q.statistics(r.text)), trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if x[feature[at]] > cut[at] else 1)
            total += leaf[at - len(feature)]
        assert abs(out.pop(r.doc_id) - 1 / (1 + np.exp(-total))) < 1e-9
    assert not out


def test_language_query_equals_one_chain_for_each_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    model = lang.train(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang.op7_language(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        w = lang.words_of(r.text)
        name, score = out.pop(r.doc_id)
        if not w:
            assert (name, score) == ("und", 0)
            continue
        e = model.scores(w)
        e = np.exp(e - e.max(axis=1, keepdims=True))[None]
        share = lang.forward_backward(e, np.ones((1, len(w)), bool), np.exp(model.transition), np.exp(model.start))[0][0].mean(axis=0)
        assert name == model.languages[int(share.argmax())] and abs(score - share.max()) < 1e-4
    assert not out


def test_training_takes_a_bounded_number_of_rows_whatever_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, y: seen.append(len(x)))
    docs = spark.range(20_000).selectExpr("if(id % 2 = 0, 1, id) as doc_id", "concat('text ', id) as text")
    q.train(docs, docs.selectExpr("doc_id", "1 as quality"), max_train=300)
    assert 0 < seen.pop() < 400
    monkeypatch.setattr(lang, "fit", lambda rows: seen.append(rows))
    docs = spark.range(20_000).selectExpr("id as doc_id", "'en' as lang", "if(id % 2 = 0, 'one chain in all of them', concat('text ', translate(id, '0123456789', 'abcdefghij'))) as text")
    lang.train(docs, max_train=5_000, max_chains=300)
    rows = seen.pop()
    assert 100 < len(rows) < 400 and len(rows) == len(set(rows))


def test_training_chains_hold_all_letters():
    words = ["ab"] * 130 + ["x" * 9001] + ["y" * 300] * 64
    chains = lang.training_chains(words)
    assert "".join(chains).replace(" ", "") == "".join(words) and max(map(len, chains)) <= lang.TRAIN_CHARS
    assert lang.training_chains([]) == []


def test_spans_of_code_switched_texts(spark):
    docs = [(d.lang, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").filter("length(text) between 200 and 3000").limit(300).collect()]
    model = lang.fit([(" ".join(lang.words_of(t)), x) for x, t in docs[:200]])
    by = {}
    for x, t in docs[200:]:
        by.setdefault(x, []).append(lang.words_of(t)[:40])
    (a, wa), (b, wb) = [(x, next(w for w in t if len(w) >= 30)) for x, t in sorted(by.items()) if any(len(w) >= 30 for w in t)][:2]
    mixed = " ".join([*wa[:30], *wb[:30]])
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 34"), (5, "12 " + " ".join(wa[:30]) + " 99"), (6, mixed)]
    got = {r.doc_id: r.spans for r in lang.identify_spans(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int"), model).collect()}
    assert got[2] == got[3] == got[4] == [] and got[1] == got[6]
    word = [s.lang for s in got[1] for _ in range(s.first, s.stop)]
    assert len(word) == 60 and sum(x == y for x, y in zip(word, [a] * 30 + [b] * 30)) >= 54
    n = len(lang.words_of(rows[4][1]))
    assert got[5][0].first == 0 and got[5][-1].stop == n and max(got[5], key=lambda s: s.stop - s.first).lang == a
