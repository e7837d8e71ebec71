"""Benchmark blocks hold each item once."""

from rulewatch.llm import decontaminate


def test_repeated_items_travel_once(spark, monkeypatch):
    blocks = []
    search = decontaminate._searched
    monkeypatch.setattr(decontaminate, "_searched", lambda rows, block, width: blocks.append(block) or search(rows, block, width))
    text = "some words of an item"
    benchmark = spark.createDataFrame([(1, text)] * 50, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {text} after")], "doc_id long, text string")
    assert decontaminate.contamination(docs, benchmark, block_bytes=2 * len(text)).first()["n_hit"] == 5
    assert blocks == [[("1", text.encode())]]
