"""Markdown is dealt to tasks by its lines, not by the size of the tables it was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import to_html


def test_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(to_html, "TASK_BYTES", 1000)
    rows = spark.range(100).select(F.col("id").alias("doc"), F.repeat(F.lit("a\n"), 9).alias("text"))
    # 18 bytes and 10 lines each.
    assert to_html._spread(rows).rdd.getNumPartitions() == -(-100 * (18 + 10 * 64) // 1000)
    assert to_html._spread(rows.limit(0)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_items_keep_their_wrapped_lines(spark):
    text = "- a\nwrapped\n- b\n\ntext\n\n- c\n- d\n   more"
    rows = spark.createDataFrame([(1, text), (2, None)], "k int, markdown string")
    found = {r["k"]: r["html"] for r in to_html.markdown_to_html(rows, "k", "markdown").collect()}
    assert found == {
        1: "<ul>\n<li>a\nwrapped</li>\n<li>b</li>\n</ul>\n<div>text</div>\n<ul>\n<li>c</li>\n<li>d\nmore</li>\n</ul>", 2: ""}
