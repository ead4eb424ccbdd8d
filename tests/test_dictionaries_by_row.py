"""detect: dictionaries of any size find the same values, in every row, in raw and normalised text."""

import pytest

from veilspark.config import EngineConfig
from veilspark.functions.spans import no_spans
from veilspark.operators import detect as module
from veilspark.operators import dictionary

ROWS = [(None, "call Annabel Lee today", False), (1, "for Annabel Lee", False), (1, "Annabel Lee is here, and Annabel Lee", False), (None, "nobody", False)]
ROWS += [(2, "full width Ａｎｎａｂｅｌ Lee", False), (3, "hidden Anna​bel Lee", False), (4, "in code Anna​bel Lee", True), (5, None, False)]
EXPECTED = sorted((t or "", v) for t, v in [(ROWS[0][1], ["Annabel Lee"]), (ROWS[1][1], ["Annabel Lee"]), (ROWS[2][1], ["Annabel Lee"] * 2), (ROWS[3][1], []), (ROWS[4][1], ["Ａｎｎａｂｅｌ Lee"]), (ROWS[5][1], ["Anna​bel Lee"]), (None, [])])


@pytest.mark.parametrize("size", [2_000_000, 12])
def test_known_and_sensitive_values(spark, monkeypatch, size):
    monkeypatch.setattr(dictionary, "SHARD", size)
    monkeypatch.setattr(module, "detected", lambda text, code, config: no_spans())
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, is_code boolean")
    values = spark.createDataFrame([("PERSON", "Annabel Lee"), ("PERSON", "Someone Else")], "label string, value string")
    found = module.detect(docs, EngineConfig(), known=values).select("text", "is_code", "spans").collect()
    got = {c: sorted((r["text"] or "", [r["text"][m["start"] : m["end"]] for m in r["spans"]]) for r in found if r["is_code"] == c) for c in (False, True)}
    assert got[False] == EXPECTED
    assert [v for _, v in got[True]] == [[]]
    listed = module.detect(docs, EngineConfig(), sensitive=values).select("text", "spans").collect()
    plain = sorted((r["text"], [r["text"][m["start"] : m["end"]] for m in r["spans"]]) for r in listed if r["spans"])
    assert plain == sorted((t, v) for t, v in EXPECTED if v and v[0] == "Annabel Lee")
