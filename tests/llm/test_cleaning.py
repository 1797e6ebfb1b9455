"""Spans belong to texts, not to doc_ids, and are found on either side of the broadcast bound."""

import pytest

from tideline.llm.contamination import Contamination

ITEM = " ".join(f"word{i}" for i in range(20))
DOCS = [
    (None, f"Before. {ITEM} After."), (1, f"Short. {ITEM}"), (1, f"A much longer beginning of another text. {ITEM} And é its end, {ITEM}"),
    (2, "Nothing leaks."), (3, None), (4, ""), ((1 << 60) + 1, f"Before. {ITEM} After."), (5, f"Before. {ITEM} After."),
]


@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_every_document_is_cleaned(spark, bound):
    c = Contamination(spark.createDataFrame([(1, ITEM)], "item_id long, passage string"), broadcast_grams=bound)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    want = [(d, t and t.replace(ITEM, " "), t.count(ITEM) if t else 0) for d, t in DOCS]
    assert sorted(map(str, (tuple(r) for r in c.cleaned(docs).collect()))) == sorted(map(str, want))
    spans = sorted(map(str, (tuple(r) for r in c.spans(docs).collect())))
    assert spans == sorted(str((d, i, i + len(ITEM), 20)) for d, t in DOCS if t for i in range(len(t)) if t.startswith(ITEM, i))
