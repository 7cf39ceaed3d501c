"""Columns of the caller come out of the license scan as they went in."""

from turnlens.llm import licenses


def test_scan_keeps_columns_of_the_caller(spark):
    text = "released under the MIT License here"
    rows = [(1, text, "a", "b", "c", 5), (None, None, None, None, None, None), (1, text, "a", "b", "c", 5), (2, "", "x", "y", "z", 6)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, _h1 string, _h2 string, _w string, n_words int")
    out = licenses.scan(frame)
    assert out.columns == ["doc_id", "text", "_h1", "_h2", "_w", "n_words", "places", "templates", "score"]
    found = out.collect()
    assert sorted(tuple(r)[:5] for r in found if r["doc_id"]) == sorted(r[:5] for r in rows if r[0])
    assert sorted((r["n_words"], len(r["places"])) for r in found) == [(0, 0), (0, 0), (6, 1), (6, 1)]
    assert licenses.scan(frame.limit(0)).count() == 0
