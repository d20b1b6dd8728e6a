from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quiverlake.llm.residue import Model, judge_residue, residue_documents, train, units, weak_labels
from tests.conftest import rows

PLAIN = ["The wheel warms the shelf near the harbour.", "Section 5: the gate and the boat.", "La page 404 du livre est perdue.", "Der Turm zeigt die Brücke.", "She explains how JavaScript came to town.", "The set {1, 2, 3} holds three numbers.", "It costs $5 or 20% less [sic].", "For x < 3 and y > 7 the rule fails [12].", "Two <s> tokens <|endoftext|> here.", "The path {upper branch} was lost."]
BAD = ["Dear {{name}}, the wheel warms the shelf.", "Hello ${Title}, welcome back.", "[INSERT CITY HERE] is near.", "404 – Not Found", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet vellum ornat consec.", "Internal Server Error: the server was unable to complete your request. Please try again later.", "Acceso denegado. No tiene permiso para ver esta página.", "text text text text text text"]


@pytest.fixture(scope="module")
def model(spark) -> Model:
    data = [(i, t, f"host{i % 13}") for i, t in enumerate(PLAIN * 40 + BAD * 5)]
    return train(spark.createDataFrame(data, "doc_id bigint, text string, source string"))


def test_judges(model):
    for t in PLAIN:
        h, r = model.judge(t)
        assert h <= 0 and r < 0.7, t
    for t in BAD:
        h, r = model.judge(t)
        assert h > 0 or r >= 0.7, t
    mixed = "Access denied. " + " ".join(PLAIN[:4])
    assert model.judge(mixed)[1] < 0.7  # speaks about it, but consists of content


def test_unseen_forms(model):
    assert model.judge("Hello {{ shipping_zone }}, your parcel is here.")[0] > 0
    assert model.judge("PLEASE ENABLE JAVASCRIPT.")[1] >= 0.7
    assert model.judge("zxcv zxcv zxcv zxcv zxcv zxcv")[1] >= 0.7


def test_held_out_hosts(model):
    assert model.held_out["units"] > 0 and model.held_out["residue_recall"] >= 0.9 and model.held_out["placeholder_precision"] >= 0.9


def test_weak_labels():
    assert weak_labels("Dear [Your Name],") == (True, False) and weak_labels("503 – Service Unavailable") == (False, True)
    assert weak_labels("The poster shows error 404 as a riddle.") == (False, False) and weak_labels("Ελλάδα και θάλασσα") == (False, False)
    assert units("<p>A b.\nC d!</p> <s> e") == ["A b.", "C d!", "e"]


def test_tables(spark, model):
    data = [(1, BAD[0]), (2, PLAIN[0]), (3, None), (4, ""), (5, " \t\n"), (1, BAD[0]), (None, BAD[3]), (6, PLAIN[0] * 20_000), (7, "".join(f"The wheel number {i} warms the shelf near the harbour. " for i in range(5000)))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("source", F.lit(None).cast("string")).withColumn("residue", F.lit(0))
    assert rows(residue_documents(docs, model)) == [(1,), (1,), (None,)]
    assert judge_residue(docs, model).count() == len(data)
    assert rows(residue_documents(docs.limit(0))) == []
