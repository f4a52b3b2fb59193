"""Header cells of reviewed tables, and lost words, on small tables."""

from quill.operators import readings, requests, state
from quill.operators.layout import lines_in_cells


def test_headers_are_snapped_where_a_table_has_one(spark):
    cells = [(1, 0, 0, "ITEM N0."), (1, 0, 1, "QTY"), (1, 1, 0, "1"), (1, 1, 1, "2"), (2, 0, 0, "17"), (2, 1, 0, "18"), (3, 0, 0, None), (3, 1, 0, "a"), (4, 0, 0, "Weight"), (4, 1, 0, "b")]
    frame = spark.createDataFrame(cells, "img_id long, row long, col long, text string")
    got = {(r.img_id, r.col): r.text for r in readings.review_header(frame, ["ITEM NO.", "QTY"]).collect()}
    assert got == {(1, 0): "ITEM NO.", (1, 1): "QTY", (3, 0): "", (4, 0): "Weight"}


def test_lost_words(spark):
    words = spark.createDataFrame([("a", w) for w in "x y x z".split()] + [("b", w) for w in "x z q".split()] + [("c", None)], "text_id string, word string")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", "a"), (4, "a", "none"), (5, "none", "a"), (6, "c", "b")], "pair_id long, old string, new string")
    assert {r.pair_id: r.n_lost for r in state.lost_words(words, pairs).collect()} == {1: 2, 2: 1, 3: 0, 4: 4, 5: 0, 6: 0}


def test_merged_continuations_are_judged_anew(spark):
    schema = "token string, kind string, items array<string>, xml string, valid boolean"
    base = spark.createDataFrame([("a", "paragraph", ["<para>x</para>"], "", False), ("b", "orderedlist", ["<listitem><para>x</para></listitem>"], "", True), ("c", "paragraph", ["<para></para>"], "", True)], schema)
    more = spark.createDataFrame([("a", "paragraph", ["<para>y</para>"]), ("b", "orderedlist", ["<listitem><para>y</listitem>"]), ("c", "list", ["<para>z</para>"])], "token string, kind string, items array<string>")
    got = {r.token: (r.merged, r.empty, r.valid) for r in requests.merge_and_judge(base, more).collect()}
    assert got == {"a": (True, False, True), "b": (True, False, False), "c": (False, True, None)}


def test_tall_cells_make_few_rows(spark):
    lines = spark.createDataFrame([(1, k, 10.0, 20.0 * k, 20.0, 20.0 * k + 10) for k in range(500)], "doc_id long, line long, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(1, "all", 0.0, 0.0, 100.0, 1e9), (1, "one", 0.0, 40.0, 100.0, 60.0), (1, "few", 0.0, -50.0, 100.0, 700.0), (1, "none", 0.0, 60.0, 100.0, 60.0)], "doc_id long, cell string, cx0 double, cy0 double, cx1 double, cy1 double")
    got = lines_in_cells(lines, cells, "doc_id", 10.0).groupBy("cell").count().collect()
    assert {r["cell"]: r["count"] for r in got} == {"all": 500, "one": 1, "few": 35}
