"""One row of each component, whatever the ids."""

import pytest

from pointweave.llm import near_text, simhash

TEXTS = ["one two three four five six", "other words of another text here", "a third text unlike the two before"]


@pytest.mark.parametrize("module", [simhash, near_text])
def test_null_and_repeated_ids(spark, module):
    rows = [(None, t) for t in TEXTS] + [(None, TEXTS[0]), (7, "seven of one kind is here"), (7, "and quite another seven stands there"), (8, TEXTS[1])]
    kept = module.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, TEXTS[0]), (0, TEXTS[2]), (7, rows[4][1]), (7, rows[5][1]), (8, TEXTS[1])])
