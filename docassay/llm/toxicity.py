"""Toxicity: an averaged bag of subword vectors under a linear softmax, so misspelt insults share their n-grams' vectors."""

from __future__ import annotations

from docassay.llm.common import table
from docassay.llm.subword import Bag, Training, fit, scored_rows

BAG = Bag(sizes=(3, 4, 5), lower=True, kind="alnum", words=True)
HOW = Training()


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, BAG, HOW)
    return scored_rows(docs, model, 5, 0)
