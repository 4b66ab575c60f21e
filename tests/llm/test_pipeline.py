"""The pipeline on a small folder against its stages done plainly."""

import random

import corpus_pipeline
from quillon.llm import langid
from test_jaccard import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    words = {"en": "the of and to in that is was for on with river house people water time".split(), "de": "der die das und von mit den nicht ein fluss haus leute wasser zeit ist auf".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "er", "en"]) for _ in range(n))
    item = say("en", 30)
    rows = [(i, say(lang, 60 + i % 40), lang, f"s{i % 4}", 0) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[4][1] + " more", "en", "s0", 0), (201, rows[4][1], "en", "s1", 0), (202, "12345 !!", "en", "s1", 0), (203, None, "en", "s2", 0), (204, say("en", 20) + " " + item + " " + say("en", 20), "en", "s3", 0)]
    rows += [(205, say("de", 40) + " mail a.b@c.de or 10.1.2.3 now", "de", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i for i, (_, root) in brute([(i, t) for i, t, *_ in rows if langid.words_of(t)], 5, 80).items() if i == root} - {204}
    assert not {200, 201, 202, 203, 204} & kept
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {r.doc_id: r for r in docs.collect()}
    assert set(clean) == kept and clean[0].text == rows[0][1]
    assert "<email>" in clean[205].text and "<ip>" in clean[205].text and clean[205].n_chars == len(clean[205].text)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) <= kept and all(0 < r.taken <= 3 * r["size"] and r["size"] == len(r.text.split()) and r.text == clean[i].text for i, r in got.items())
    for source, target in {(r.source, r.target) for r in got.values()}:
        assert sum(r.taken for r in got.values() if r.source == source) == round(target)


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    text = lambda k: " ".join(f"the river of{k} and{k * 7} people in that{k * 3} house was for water{j}" for j in range(6))
    rows = [(1, text(1), "en", "a", 0), (1, text(1), "en", "a", 0), (1, text(2), "en", None, 0), (None, text(3), None, "a", None), (None, text(4), "en", "b", 0), (None, text(4), "en", "b", 0), (None, None, None, None, None), (2, "", "en", "a", 0)]
    rows += [(10 + i, text(20 + i), "en", "a", 0) for i in range(30)]
    # A leak in a row without an id goes too.
    rows += [(None, "so " + text(70) + " it", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 as size", "2 as id", "3 as row_key", "4 as found").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, text(1)), (2, text(70))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    got = docs.collect()
    assert len(got) == len({r.text for r in got}) == 34 and {r.text for r in got} == {t for _, t, *_ in rows if t} - {rows[-1][1]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_languages_are_found_in_few_rows_at_a_time(spark):
    # Who writes the stage's result sets no size of Python's batches: none may be left to run then.
    rows = [(i, "the river and the people" if i % 9 else "12", "en", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert "EvalPython" not in got._jdf.queryExecution().toString() and {r.doc_id for r in got.collect()} == {i for i in range(60) if i % 9}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
