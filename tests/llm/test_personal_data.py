"""Spans that the trees add: recall and precision on spelt-out forms, whatever the size of the table."""

import random

import numpy as np
import pytest

from docassay.llm import pii


def line(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def planted(n):
    """Texts with one span in another form, and where it is if it still is personal data."""
    rng, texts, want = random.Random(41), [], set()
    for i in range(n):
        kind = pii.KINDS[i % 4]
        other, good = pii.altered(pii.made_up(kind, rng), kind, i // 4)
        head = line(rng, 5) + " " + {"email": "", "ip": "", "card": "my card ", "phone": "call "}[kind]
        texts.append(head + other + " " + line(rng, 5))
        if good:
            want.add((i, kind, len(head), len(head) + len(other)))
    return texts, want


@pytest.mark.parametrize("sample", [0, 3, 400])
def test_recall_and_precision_of_added_spans(spark, sample):
    rng = random.Random(5)
    rows = [(i, f"{line(rng, 20)} order 20{i % 90:02d}-{i % 12 + 1:02d}-11 total {i * 7919} {pii.made_up(pii.KINDS[i % 4], rng)} {line(rng, 9)}") for i in range(sample)]
    model, least = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"), forms=pii.FORMS)
    assert np.isfinite(least).all()
    texts, want = planted(800)
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, least)
    got = set()
    for r in found.collect():
        for span in set(r["spans"].split(",")) - {"", *r["base"].split(",")}:
            kind, start, end = span.split(":")
            got.add((r["doc_id"], kind, int(start), int(end)))
    for kind in pii.KINDS:
        mine, right = {g for g in got if g[1] == kind}, {w for w in want if w[1] == kind}
        print(sample, kind, "recall", len(mine & right) / len(right), "precision", len(mine & right) / max(1, len(mine)))
        assert len(mine & right) >= 0.9 * len(right) and len(mine & right) >= 0.95 * len(mine)


def test_clean_texts_get_no_span(spark):
    rng = random.Random(8)
    texts = [f"{line(rng, 30)} in {1900 + i % 120} at {i % 24}:30 version {i}.{i % 7}.{i % 11} of {i * 104729} parts, page {i}" for i in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["spans"] for r in pii.find_personal_data(docs, *pii.learn(docs, forms=pii.FORMS)).collect()} == {""}


def test_repeated_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "7 . " * 20000 + "a dot " * 20000 + "9" * 50000), (2, "x at y " * 10000)] + [(3, "a@b.com")] * 40, "doc_id long, text string")
    found = {r["doc_id"]: r["base"] for r in pii.find_personal_data(docs, *pii.learn(docs, forms=50)).collect()}
    assert found[3] == "email:0:7" and found[1] == found[2] == ""


def test_every_text_counts(spark):
    """Trees and thresholds come from all texts, in whatever partitions: each of them gives its examples."""
    texts = [f"write to me.{i}@mail{i % 9}.example.com or call +1 (743) 555-{3000 + i % 6000} from 10.0.{i % 250}.7 {i * 37} times" for i in range(4600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.counted_examples(docs).groupBy().sum("n").first()[0]
    assert found == sum(len(pii.examples(t)) for t in texts) > 40000
    models = [pii.learn(docs.limit(60).repartition(k), least_sample=10) for k in (1, 5)]
    asked = np.random.default_rng(3).integers(0, 40, (200, pii.N_FEATURES)).astype(float)
    assert (models[0][0].margin(asked) == models[1][0].margin(asked)).all() and (models[0][1] == models[1][1]).all()
