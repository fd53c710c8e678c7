"""Joins with whole texts give the same rows whether their other side is broadcast or dealt."""

import pytest

from phenospark.llm import common
from phenospark.llm.chosen_path import keep_one
from phenospark.llm.pii import sanitise

TEXT = "one two three four five six seven eight nine ten"
ROWS = [
    (1, TEXT + " a@b.com"),
    (2, TEXT + " a@b.com"),
    (2, TEXT + " a@b.com"),
    (3, "write to x.y@site.org or +44 20 7946 0958 é"),
    (4, None),
    (5, ""),
    (None, TEXT + " a@b.com"),
    (6, "nothing here at all to be found by anyone"),
    (6, "nothing here at all to be found by anyone"),
]


@pytest.mark.parametrize("most", [common.SIDE_BYTES, -1])
def test_sides(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIDE_BYTES", most)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    clean = sorted(map(tuple, sanitise(docs).collect()), key=str)
    assert clean == sorted(((i, t and t.replace("a@b.com", "<email>").replace("x.y@site.org", "<email>").replace("+44 20 7946 0958", "<phone>")) for i, t in ROWS), key=str)
    kept = sorted(map(tuple, keep_one(docs).collect()), key=str)
    assert kept == sorted([ROWS[0], ROWS[3], ROWS[4], ROWS[5], ROWS[6], ROWS[7]], key=str)
