"""Quality: learned vectors of hashed words and character n-grams, averaged per document, under a softmax.

Case and signs count: what spoils a text is often neither a letter nor lower case.
"""

from __future__ import annotations

from docassay.llm.common import table
from docassay.llm.subword import Bag, Training, fit, scored_rows

BAG = Bag(sizes=(2, 3, 4), lower=False, kind="space", words=True, repeats=True)
HOW = Training()


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, BAG, HOW)
    return scored_rows(docs, model, 3, 1)
