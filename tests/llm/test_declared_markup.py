"""The language that a page declares counts wherever its html tag ends."""

import os

from framelake.llm import queries

from conftest import SMALL


def test_late_html_tag_is_read(spark, tmp_path, monkeypatch):
    os.symlink(f"{SMALL}/documents.parquet", tmp_path / "documents.parquet")
    late = f"<!-- {'x' * 3000} --><html data-a='{'y' * 3000}' lang=\"de\"><body>a</body></html>"
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = spark.createDataFrame([(1, "http://a.com/b", late), (2, "http://a.com/c", "<html><body>a</body></html>")], "page_id long, url string, html string")
    rows.select(*(c for c in rows.columns if c in pages.columns)).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(queries.language_id, "identify", lambda frame, model, ids: frame)
    got = queries.op6_language_id(spark, str(tmp_path)).filter("page_id is not null").select("page_id", "declared").collect()
    assert dict(map(tuple, got)) == {1: "de", 2: None}
