"""Table regions without a grid, and image regions as crops."""

from quill.operators.extract import extract_images, extract_regions

SPANS = "doc_id long, line long, span long, block long, x0 double, y0 double, x1 double, y1 double, text string, bold boolean, italic boolean, dir_x double, dir_y double"
REQUESTS = "doc_id long, kind string, x0 double, y0 double, x1 double, y1 double"


def test_tables_without_a_grid(spark):
    spans = [(1, 0, 0, 0, 5.0, 1.0, 50.0, 9.0, "a exam-", False, False, 1.0, 0.0), (1, 1, 0, 0, 5.0, 11.0, 50.0, 19.0, "ple & b", True, False, 1.0, 0.0), (2, 0, 0, 0, 5.0, 1.0, 50.0, 9.0, "  ", False, False, 1.0, 0.0)]
    requests = [(k, "table", 0.0, 0.0, 100.0, 100.0) for k in (1, 2, 3)]
    images = spark.createDataFrame([(3,)], "doc_id long")
    got = {r.doc_id: (r.xml, r.needs_reading) for r in extract_regions(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(spans, SPANS), images).collect()}
    whole = '<informaltable frame="box" rules="all"><tbody><tr><td><para>{}</para></td></tr></tbody></informaltable>'
    assert got == {1: (whole.format("a example &amp; b"), False), 2: (whole.format(""), False), 3: (None, True)}


def test_image_regions(spark):
    requests = [(1, "image", 10.0, 10.0, 60.0, 60.0), (2, "image", 0.0, 0.0, 100.0, 100.0), (3, "image", 10.0, 10.0, 60.0, 60.0), (4, "table", 10.0, 10.0, 60.0, 60.0), (5, "image", 10.0, 10.0, 60.0, 60.0)]
    images = [(1, 7, 0.0, 0.0, 100.0, 100.0, 0.0, False, 200, 400), (2, 8, 0.0, 0.0, 50.0, 100.0, 0.0, False, 10, 10), (2, 9, 50.0, 0.0, 100.0, 100.0, 0.0, False, 10, 10), (3, 7, 0.0, 0.0, 100.0, 100.0, 0.5, False, 10, 10), (4, 7, 0.0, 0.0, 100.0, 100.0, 0.0, False, 10, 10)]
    frame = spark.createDataFrame(images, "doc_id long, image_id long, ix0 double, iy0 double, ix1 double, iy1 double, skew double, masked boolean, width int, height int")
    got = [(r.doc_id, r.image_id, tuple(r.box)) for r in extract_images(spark.createDataFrame(requests, REQUESTS), frame).collect()]
    assert got == [(1, 7, (20, 40, 120, 240))]


def test_redaction_boxes(spark):
    from quill.operators.streams import redaction_boxes

    rows = [(1, 1, 0, s, p, c, 5.0 * i, 0.0, 5.0 * i + 4, 9.0 + i) for i, (s, p, c) in enumerate([(0, 0, "a"), (0, 1, "C"), (1, 0, "O"), (1, 1, "P"), (2, 0, "C"), (2, 1, "O"), (2, 2, "P")])] + [(1, 1, 1, 0, 0, "x", 0.0, 0.0, 1.0, 1.0)]
    chars = spark.createDataFrame(rows, "doc_id long, page long, line long, span long, pos long, c string, x0 double, y0 double, x1 double, y1 double")
    (got,) = redaction_boxes(chars, "COP").collect()
    assert (got.line, tuple(got.rect), [b.x0 for b in got.boxes]) == (0, (5.0, 0.0, 19.0, 12.0), [5.0, 10.0, 15.0])
    assert redaction_boxes(chars, "").isEmpty() and redaction_boxes(chars, "none").isEmpty()
