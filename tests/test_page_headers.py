"""The columns of a folder of response pages."""

import json

from popweave.sources import responses as H


def test_columns_in_the_order_in_which_pages_name_them(spark, tmp_path):
    """By path, line and place, over repeated headers, a header of another order, and lines without one."""
    pages = {
        "b.txt": [[["z", "b"], ["1", "2"]], [["y"], ["3"]]],
        "a.txt": [[], [["b", None, "a"], ["1", "2", "3"]], [["a", "c", "b"], ["4", "5", "6"]], [["b", None, "a"], ["7", "8", "9"]]],
    }
    for name, docs in pages.items():
        (tmp_path / name).write_text("".join(json.dumps(d) + "\n" for d in docs))
    found = H.scan_header_json(spark, str(tmp_path), per_line=True)
    assert found.columns == ["b", "a", "c", "z", "y"]
    assert found.count() == 5


def test_no_task_sorts_the_pages_rows(spark, tmp_path, monkeypatch):
    """What is sorted for the names is one row for each file and different header, not one for every name of every line."""
    (tmp_path / "a.txt").write_text((json.dumps([["k", "v"], ["1", "2"]]) + "\n") * 300)
    plans, real = [], type(spark.range(1)).orderBy

    def noted(df, *cols, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *cols, **kw)

    monkeypatch.setattr(type(spark.range(1)), "orderBy", noted)
    H.scan_header_json(spark, str(tmp_path), per_line=True)
    assert any("HashAggregate(keys=[path" in p.replace("ObjectHashAggregate", "") for p in plans)
