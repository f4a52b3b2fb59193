"""Regions whose spans and cells lie by id are put together without dealing them again."""

from quill.operators.extract import extract_regions
from quill.operators.layout import lines_in_cells
from quill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_regions_are_not_dealt_again(spark):
    frame = catalog.QUERIES["table_fragments"](spark, SF)
    frame.collect()
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lines_in_and_outside_cells_of_two_levels(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, 0.0, 0.0, 10.0, 5000.0), (2, 0, 1, 5.0, 0.0, 10.0, 10.0)], "doc_id long, row int, col int, cx0 double, cy0 double, cx1 double, cy1 double")
    spots = [(1, 0, 5.0, 5.0), (1, 1, 50.0, 5.0), (2, 0, 7.0, 5.0), (2, 1, 7.0, 4000.0), (2, 2, 50.0, 0.0), (3, 0, 5.0, 5.0)]
    lines = spark.createDataFrame([(d, n, x, x, y, y, f"{d}.{n}") for d, n, x, y in spots], "doc_id long, line int, x0 double, x1 double, y0 double, y1 double, text string")
    inside = sorted((r.doc_id, r.line, r.col) for r in lines_in_cells(lines, cells, "doc_id", 64.0).collect())
    both = [(r.doc_id, r.line, r.col) for r in lines_in_cells(lines, cells, "doc_id", 64.0, outside=True).collect()]
    assert inside == [(1, 0, 0), (2, 0, 0), (2, 0, 1), (2, 1, 0)] == sorted(r for r in both if r[2] is not None)
    assert len([r for r in both if r[2] is None and r[0] == 3]) == 1 and {r[:2] for r in both} == {s[:2] for s in spots}
    spans = lines.selectExpr("doc_id", "line", "0 AS span", "0 AS block", "x0", "x1", "y0", "y1", "text", "false AS bold", "false AS italic", "1D AS dir_x", "0D AS dir_y")
    requests = spark.createDataFrame([(k, "table", 0.0, 0.0, 100.0, 9000.0) for k in (1, 2, 3, 4)], "doc_id long, kind string, x0 double, y0 double, x1 double, y1 double")
    dealt = [f.repartition(4, "doc_id") for f in (requests, spans, cells)]
    for asked, said, grid, parts in ((requests, spans, cells, None), (*dealt, 4)):
        got = {r.doc_id: r.xml for r in extract_regions(asked, said, cells=grid, parts=parts).collect()}
        assert {k: x.count("<td>") for k, x in got.items()} == {1: 1, 2: 2, 3: 1, 4: 1}
        assert "1.0" in got[1] and "1.1" not in got[1] and got[2].count("2.0") == 2 and "2.2" not in got[2] and got[3].count("3.0") == 1
