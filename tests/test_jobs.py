"""The jobs over growing input, reruns and odd rows, in folders of their own."""

import logging
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import cohorts, common, term_layer

DOCS = "doc_id long, text string, lang string, extra int"
FIRST = [(1, "Red fish, blue fish.", "en", 0), (2, None, "en", 0), (3, "", None, 0), (4, "ein Fisch É2", "de", 0), (None, "lost words", "en", 0), (5, "red red", None, 0)]
SECOND = [(6, "blue sea", "en", 0), (1, "not taken again", "en", 0), (7, "fish", "de", 0), (7, "sea", "de", 0), (8, "x " * 50_000, "fr", 0)]


def arrive(spark, rows, path):
    spark.createDataFrame(rows, DOCS).repartition(2).write.mode("append").parquet(path)


def layer_of(rows):
    """(lang, gene, col) and value of each term, in plain Python."""
    counts, out = {}, {}
    for doc, text, lang, _ in rows:
        if doc is not None:
            counts.setdefault(doc, Counter()).update((lang, t) for t in re.findall(r"[^\W_]+", (text or "").lower()))
    for doc, terms in counts.items():
        for (lang, term), n in terms.items():
            out[lang, term, doc] = math.log1p(n / sum(terms.values()) * 10_000)
    return out


def layer(spark, output):
    return {(r.lang, r.gene, r.col): r.value for r in term_layer.table(spark, output, "layer").collect()}


def same(got, want):
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_layer_grows_with_its_input(spark, tmp_path, caplog):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    caplog.set_level(logging.INFO)
    arrive(spark, FIRST, docs)
    config = term_layer.Config(files_per_batch=1, variable=3)
    assert term_layer.run(spark, docs, out, mark, config) == {"read": 6, "columns": 5, "variable": 3}
    same(layer(spark, out), layer_of(FIRST))
    arrive(spark, SECOND, docs)
    got = term_layer.run(spark, docs, out, mark, term_layer.Config(variable=3))
    assert got == {"read": 5, "columns": 8, "variable": 3}  # the first files aren't read again
    new = layer_of(FIRST + [r for r in SECOND if r[0] != 1])
    same(layer(spark, out), new)
    assert sorted(r.col for r in term_layer.table(spark, out, "columns").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    # statistics over both runs' parts are those of the whole layer
    terms = {g for _, g, _ in new}
    score = {}
    for t in terms:
        v = [sum(x for (_, g, c), x in new.items() if g == t and c == doc) for doc in range(1, 9)]
        mean = sum(v) / 8
        score[t] = (-sum((x - mean) ** 2 for x in v) / 7 / mean, t)
    kept = {r.gene: r.score for r in term_layer.table(spark, out, "variable").collect()}
    assert list(kept) and set(kept) == {t for _, t in sorted(score.values())[:3]} and all(abs(kept[t] + score[t][0]) < 1e-6 for t in kept)
    assert "batch" in caplog.text and f"{out}/layer" in caplog.text and f"read 5 rows of {docs}" in caplog.text
    # nothing new: nothing changes
    assert term_layer.run(spark, docs, out, mark, config)["read"] == 0
    same(layer(spark, out), new)


def test_a_batch_run_again_replaces_its_own_rows(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    arrive(spark, FIRST, docs)
    term_layer.run(spark, docs, out, mark)
    before = layer(spark, out)
    again = spark.read.parquet(docs)
    term_layer.take(again, 0, out, term_layer.Config())
    same(layer(spark, out), before)
    # a run that ended before its mark was set: the whole input once more, into the same output
    term_layer.run(spark, docs, out, str(tmp_path / "mark2"))
    same(layer(spark, out), before)


def test_layer_of_a_single_file_and_of_nothing(spark, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame(FIRST, DOCS).coalesce(1).write.parquet(docs)
    file = spark.read.parquet(docs).select(F.input_file_name()).first()[0]
    term_layer.run(spark, file, str(tmp_path / "out"), str(tmp_path / "mark"))
    same(layer(spark, str(tmp_path / "out")), layer_of(FIRST))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert term_layer.run(spark, str(tmp_path / "none"), str(tmp_path / "out2"), str(tmp_path / "mark2")) == {"read": 0, "columns": 0, "variable": 0}


def test_settings(spark, tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('cohort = "kind"\nonly = ["a"]\n')
    assert common.settings(spark, str(path), cohorts.Config) == cohorts.Config("kind", ("a",))
    assert common.settings(spark, None, term_layer.Config) == term_layer.Config()
    with pytest.raises(ValueError, match="cohort, only"):
        common.settings(spark, str(path), term_layer.Config)
    for module in (cohorts, term_layer):
        assert common.settings(spark, module.__file__.replace(".py", ".toml"), module.Config) == module.Config()


def clinic(spark, tmp_path, more=()):
    patients = [(i, ["a", "b", None][i % 3], float(i * 37 % 11)) for i in range(60)] + [(99, "a", 1.0), *more]
    visits = [(100 * i + j, i, f"2020-01-{1 + (i * 7 + j * 5) % 28:02d}", "F" if (i * 5 + j * 3) % 7 < 4 else "O") for i in [*range(60), *(m[0] for m in more)] for j in range(1 + i % 4)]
    spark.createDataFrame(patients, "c_custkey long, c_mktsegment string, c_acctbal double").write.mode("overwrite").parquet(str(tmp_path / "p"))
    spark.createDataFrame(visits, "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string").write.mode("overwrite").parquet(str(tmp_path / "v"))
    return str(tmp_path / "p"), str(tmp_path / "v"), str(tmp_path / "out")


def rows_of(spark, out, name):
    return sorted((tuple(r) for r in cohorts.table(spark, out, name).collect()), key=repr)


def test_cohorts(spark, tmp_path):
    from phenospark.operators import survival

    p, v, out = clinic(spark, tmp_path)
    assert cohorts.run(spark, p, v, out) == {"patients": 60, "cohorts": 3}
    first = [rows_of(spark, out, n) for n in ("phenotype", "summary")]
    assert cohorts.run(spark, p, v, out) == {"patients": 60, "cohorts": 3}
    assert [rows_of(spark, out, n) for n in ("phenotype", "summary")] == first
    table = cohorts.table(spark, out, "phenotype")
    scores = spark.read.parquet(p).selectExpr("c_custkey AS col", "c_acctbal AS score")
    for c, where in (("a", "cohort = 'a'"), (None, "cohort IS NULL")):
        own = table.where(where)
        alone = {r.col: r["rank"] for r in survival.guanrank(own.select("col", "time", "status")).collect()}
        assert len(alone) == 20 and all(abs(alone[r.col] - r["rank"]) < 1e-12 and r.s == 1 - r["rank"] for r in own.collect())
        (got,) = [r for r in first[1] if r[4] == c]
        assert got[:2] == (20, sum(r.status for r in own.collect()))
        assert abs(got[3] - survival.concordance(own.join(scores, "col")).first().concordance) < 1e-12
    # one cohort alone, over grown input: the others stay as they were
    p, v, out = clinic(spark, tmp_path, [(200, "a", 3.0), (201, "b", 4.0)])
    cohorts.run(spark, p, v, out, cohorts.Config(only=("a",)))
    assert Counter(r[6] for r in rows_of(spark, out, "phenotype")) == {"a": 21, "b": 20, None: 20}
    assert [r for r in rows_of(spark, out, "phenotype") if r[6] != "a"] == [r for r in first[0] if r[6] != "a"]
    cohorts.run(spark, p, v, out)
    assert Counter(r[6] for r in rows_of(spark, out, "phenotype")) == {"a": 21, "b": 21, None: 20}
