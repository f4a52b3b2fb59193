"""Layout, review, state, stream and source operators on worked examples."""

import difflib
import json
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.operators import layout as layout_ops
from quill.operators import raster, readings, requests, state, streams, tables
from quill.operators.layout import in_region, list_items, paragraphs
from quill.sources import layout, markup
from quill.streaming.limiter import limit_stream


def test_text_functions(spark):
    one = lambda column: spark.range(1).select(column.alias("v")).first().v
    s = F.lit
    assert one(T.strip(s("  x y \n"))) == "x y" and one(T.collapse(s(" a\n\t b "))) == "a b"
    assert one(T.strip_envelope(s("```xml\n<?xml version='1.0'?><!DOCTYPE a>\n<a/>\n```"))) == "<a/>"
    assert one(T.squash(s("<a> \n <b> x</b></a>"))) == "<a><b> x</b></a>"
    assert one(T.attr_int(s(' colspan = "3" x'), "colspan")) == 3 and one(T.attr_int(s("span=0"), "span")) == 1 and one(T.attr_int(s(""), "span")) == 1
    assert one(T.flag_page_refs(s("x (see pages 3-4 there) (pages are)"))) == 'x <span class="page-ref-flag">(see pages 3-4 there)</span> (pages are)'
    assert one(T.shape(s("416-76 Y1b"))) == "999-99A9A" and one(T.comma_repair(s("BOLT. M6 x. "))) == "BOLT, M6 x. "
    assert one(T.join_lines(F.array(s("exam-"), s("ple of-"), s("Text"), s("x")))) == "example of- Text x"
    assert one(T.join_lines(F.array(s(""), s(""), s("a-"), s("b"), s(""), s("c")))) == "ab  c" and one(T.join_lines(F.array().cast("array<string>"))) == ""
    assert one(T.ascii_only(s(" aé b\u4e00 "))) == "a b" and one(T.indent_of(s("a\n \tb"), s(4))) == " \t" and one(T.bare_paragraph(s(" a  <b "))) == "<para>a &lt;b</para>"
    assert one(requests.fraction_to_pixels(s(0.25), s(10))) == 3 and one(requests.fraction_to_pixels(s(7.0), s(10))) == 10
    assert one(T.line_of(s("a\nb\n\U0001f600c"), s(5))) == 3 and one(T.escape_html(s("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"


def layout_of(spark, texts, gaps=None, blocks=None):
    rows, y = [], 0.0
    for k, t in enumerate(texts):
        y += (gaps or {}).get(k, 0)
        rows.append((1, k, (blocks or {}).get(k, 0), t, y, y + 10, 10.0, 90.0, 1.0, 0.0))
        y += 10
    return spark.createDataFrame(rows, "doc_id long, line long, block long, text string, y0 double, y1 double, x0 double, x1 double, dir_x double, dir_y double")


def test_paragraphs(spark):
    texts = ["One wrapped", "line here", "next. block", "joined as wrap", "After a gap"]
    got = [r.text for r in paragraphs(layout_of(spark, texts, gaps={4: 6}, blocks={2: 1, 3: 2, 4: 2})).orderBy("para").collect()]
    assert got == ["One wrapped line here next. block joined as wrap", "After a gap"]
    got = [r.text for r in paragraphs(layout_of(spark, ["Ends here.", "new block"], blocks={1: 1})).orderBy("para").collect()]
    assert got == ["Ends here.", "new block"]
    assert in_region(layout_of(spark, ["a", " ", "b"]), 0, 0, 60, 25).count() == 1


def test_list_items(spark):
    got = [(r.item, r.ordered, r.text) for r in list_items(layout_of(spark, ["intro", "1.) first", "goes on", "2.", "(b) third", "•"])).orderBy("item").collect()]
    assert got == [(1, True, "first goes on"), (2, True, "third")]


def test_review(spark):
    rows = [(1, 0, 0, "NO", True, 0.99), (1, 0, 1, "CODE", True, 0.99), (1, 0, 2, "NAME", True, 0.99)]
    names = ["BOLT. M6", "nut 9.5mm", "A", None, "B"]
    for r in range(1, 6):
        rows += [(1, r, 0, ["1", "2", "3", "4", "7"][r - 1], True, 0.99), (1, r, 1, ["41-A1", "41-A2", "41-A3", "41A4", "41-A5"][r - 1], r != 2, 0.99), (1, r, 2, names[r - 1], True, 0.5 if r == 3 else 0.99)]
    cells = spark.createDataFrame(rows, "img_id long, row long, col long, text string, agree boolean, conf double")
    got = {(r.body_row, r.col): (r.text, list(r.why)) for r in readings.review(cells).collect()}
    flagged = {k: v[1] for k, v in got.items() if v[1]}
    assert flagged == {(4, 0): ["sequence 4 to 7"], (1, 1): ["readings differ"], (3, 1): ["off the column's pattern"], (2, 2): ["low confidence 0.50"], (1, 2): ["letter case"]}
    assert got[0, 2][0] == "BOLT, M6" and got[3, 2] == ("", [])


def accepted(times, most, window):
    live, out = [], []
    for t in sorted(times):
        live = [x for x in live if x > t - window]
        out.append(len(live) < most)
        if out[-1]:
            live.append(t)
    return out


def test_limiter(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 4)}", float(rng.randint(0, 300))) for _ in range(300)] + [("edge", float(t)) for t in (0, 0, 60, 60, 60)]
    frame = spark.createDataFrame(rows, "key string, at double")
    expected = {k: accepted([t for x, t in rows if x == k], 2, 60) for k in {r[0] for r in rows}}
    got = state.limit_requests(frame, ["key"], 2, 60).toPandas()
    for k, want in expected.items():
        assert got[got["key"] == k].sort_values(["at", "allowed"], ascending=[True, False])["allowed"].tolist() == want
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = limit_stream(stream, 2, 60, drop_idle=False).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    live = spark.table("limited").toPandas()
    for k, want in expected.items():
        assert live[live["key"] == k]["allowed"].tolist() == want


def test_limiter_holds_no_key_as_one_row(spark):
    frame = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"), F.col("id").cast("double").alias("at"))
    got = state.limit_requests(frame, ["key"], 2, 60)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    hot = accepted([float(i) for i in range(300_000) if i % 3], 2, 60)
    assert got.filter("key is null").count() == len(hot) and got.filter("key is null and allowed").count() == sum(hot)


def test_limiter_drops_idle_keys(spark, tmp_path):
    """A key that is idle by the clock is forgotten, so the same request passes once more."""
    (tmp_path / "in").mkdir()

    def put(name, rows):
        spark.createDataFrame(rows, "key string, at double").coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / name).rename(tmp_path / "in" / name)

    stream = spark.readStream.schema("key string, at double").parquet(str(tmp_path / "in" / "*"))
    put("a", [("k", 1.0), ("k", 1.0)])
    run = limit_stream(stream, 1, 0.5).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="200 milliseconds").start()
    wait = lambda n: next((True for _ in range(300) if spark.table("idle").count() >= n or time.sleep(0.1)), False)
    assert wait(2)
    for _ in range(100):
        if (run.lastProgress or {}).get("stateOperators", [{}])[0].get("numRowsTotal", 1) == 0:
            break
        time.sleep(0.1)
    put("b", [("k", 1.0)])
    assert wait(3)
    run.stop()
    assert sorted(r.allowed for r in spark.table("idle").collect()) == [False, True, True]


def test_sessions_at_the_boundary(spark):
    frame = spark.createDataFrame([("a", 0), ("a", 20), ("a", 41)], "k string, t long")
    assert [(r.start, r.end, r.n) for r in state.idle_sessions(frame, "k", "t", 20).orderBy("session").collect()] == [(0, 20, 2), (41, 41, 1)]


def test_widths_overlaps_and_merges(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 3), (1, 0, 1, 1, 1), (1, 1, 0, 1, 65535), (1, 5, 0, 4, 1)], "table_id long, row int, col int, colspan int, rowspan int")
    assert sorted((r.row, r.width) for r in tables.row_widths(cells).collect()) == [(0, 3), (1, 3), (5, 5)]
    rng = random.Random(2)
    box = lambda: [float(rng.randint(0, 300)), float(rng.randint(0, 300)), float(rng.randint(1, 200)), float(rng.randint(1, 200))]
    clips, images = [(i, i % 2, *box()) for i in range(40)], [(i, i % 2, *box()) for i in range(40)]
    shape = lambda rows, id_, names: spark.createDataFrame([(a, k, x, y, x + w, y + h) for a, k, x, y, w, h in rows], f"{id_} long, k long, " + ", ".join(f"{n} double" for n in names))
    got = {r.clip_id: (r.image_id, r.overlap) for r in layout_ops.best_overlap(shape(clips, "clip_id", ("x0", "y0", "x1", "y1")), shape(images, "image_id", ("ix0", "iy0", "ix1", "iy1")), "k", 0.0, 0.0).collect()}
    for a, k, x, y, w, h in clips:
        areas = {i: max(0, min(x + w, p + r) - max(x, p)) * max(0, min(y + h, q + s) - max(y, q)) for i, j, p, q, r, s in images if j == k}
        best = max(areas.values())
        assert got.get(a) == (None if best == 0 else (min(i for i, v in areas.items() if v == best), best))
    base = spark.createDataFrame([("a", "list", ["x"], [1], "old", 5), ("b", "list", ["y"], [2], "old", 6)], "token string, kind string, items array<string>, regions array<int>, xml string, page int")
    more = spark.createDataFrame([("a", "list", ["z"], [3]), ("b", "paragraph", ["w"], [4])], "token string, kind string, items array<string>, regions array<int>")
    merged = {r.token: (r.items, r.regions, r.xml, r.page, r.merged) for r in state.merge_continuations(base, more).collect()}
    assert merged == {"a": (["x", "z"], [1, 3], "<itemizedlist>\nx\nz\n</itemizedlist>", 5, True), "b": (["y"], [2], "<itemizedlist>\ny\n</itemizedlist>", 6, False)}


def test_header_snap_by_force(spark):
    rng = random.Random(4)
    known = ["ITEM NO.", "PART NO.", "QTY", "DESCRIPTION"]
    texts = ["".join(rng.choices("ITEMPARTNO. QYDSC", k=rng.randint(1, 11))) for _ in range(60)] + ["item no", "Qty.", "", "PARTNO"]
    got = {r.text: r.snapped for r in readings.snap_headers(spark.createDataFrame([(t,) for t in texts], "text string"), known).collect()}

    def ratio(a, b):
        return difflib.SequenceMatcher(None, b, a).ratio()

    for t in texts:
        form = " ".join(t.split()).upper()
        best = max(known, key=lambda k: ratio(k, form))
        if ratio(best, form) < 0.6:
            assert got[t] == t
        else:
            assert ratio(got[t], form) == ratio(best, form)


def test_requests(spark):
    raw = ["[[0,0,3,3],[5,5,1,1]]", "[]", "[[1,2,3]]", "nope", "[" + ",".join(["[0,0,1,1]"] * 21) + "]", None, "[[0,0,null,3]]"]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id long, raw string")
    assert [r.v for r in frame.orderBy("id").select(requests.erase_rects(F.col("raw")).alias("v")).collect()] == [[[0.0, 0.0, 2.0, 2.0]], [], None, None, None, None, None]


def test_streams(spark):
    data = {
        1: rb"BT (x) Tj (AB) Tj [(C) 3 (D)] TJ ET BT (AB) Tj ET (CD) Tj",
        2: rb"BT (a\(b\)) Tj <63 64> Tj ET",
        3: rb"BT (A) Tj 0 -14 Td (B) Tj (CD) Tj ET",
        4: rb"BT <5> Tj (ABCD) Tj ET \xff\xfe",
        5: rb"BT () Tj (ABCD) Tj ET",
    }
    rows = spark.createDataFrame([(k, 1, 7, v) for k, v in data.items()] + [(1, 1, 8, None)], "doc_id long, page long, xref long, data binary")
    runs = {(r.doc_id, r.first, r.last) for r in streams.line_runs(streams.shown_strings(rows), "ABCD").collect()}
    assert runs == {(1, 1, 2), (3, 0, 2), (4, 1, 1), (5, 0, 1), (5, 1, 1)}
    assert [(r.doc_id, r.first, r.last) for r in streams.line_runs(streams.shown_strings(rows), "a(b)cd").collect()] == [(2, 0, 1)]
    got = {(r.doc_id, r.xref): (r.possible, r.data and bytes(r.data)) for r in streams.remove_line(rows, "ABCD").collect()}
    assert got[1, 7] == (True, b"BT (x) Tj   ET BT (AB) Tj ET (CD) Tj") and got[1, 8] == (True, None)
    assert got[3, 7] == (True, b"BT  0 -14 Td   ET") and got[4, 7] == (True, rb"BT <5> Tj  ET \xff\xfe")
    assert got[2, 7] == (False, data[2]) and got[5, 7] == (False, data[5])
    assert streams.line_runs(streams.shown_strings(rows), "\u4e00").isEmpty()
    records = spark.createDataFrame([(1, 1, 0, 5, b"a"), (1, 1, 1, 6, b"b"), (1, 1, 2, 5, b"c"), (1, 1, 3, 7, None)], "doc_id long, page long, ordinal long, xref long, data binary")
    assert sorted((r.ordinal, r.xref) for r in streams.distinct_streams(records).collect()) == [(0, 5), (1, 6)]


def test_raster(spark):
    pixels = [[255] * 12 for _ in range(10)]
    for y in range(3, 6):
        pixels[y][2:7] = [10] * 5
    rows = spark.createDataFrame([(1, y, p) for y, p in enumerate(pixels)], "img_id long, y int, pixels array<int>")
    assert [r.ink for r in raster.row_ink(rows).orderBy("y").collect()] == [0, 0, 0, 5, 5, 5, 0, 0, 0, 0]
    cut = [r.pixels for r in raster.crop(rows, 2, 3, 5, 3, radius=1).orderBy("y").collect()]
    assert cut == [[255, 10, 10, 10, 255], [10] * 5, [255, 10, 10, 10, 255]]
    assert raster.crop(rows, 2, 3, 50, 3).isEmpty()
    boxes = spark.createDataFrame([(1, 2, 3, 4, 5)], "img_id long, x0 int, y0 int, x1 int, y1 int")
    assert [r.ink for r in raster.row_ink(raster.erase(rows, boxes)).orderBy("y").collect()][3:6] == [3, 3, 5]


def test_pages(spark, tmp_path):
    line = lambda text, y: {"bbox": [0, y, 9, y + 9], "dir": [1, 0], "spans": [{"bbox": [0, y, 5, y + 9], "text": text, "font": "F", "flags": 16}, {"bbox": [5, y, 9, y + 9], "text": "!", "font": "F", "flags": 0}]}
    image = {"xref": 4, "bbox": [0, 0, 10, 20], "transform": [10, 0, 0, 20, 0, 0], "smask": 0, "width": 100, "height": 200}
    pages = [{"doc_id": 1, "page": 1, "blocks": [{"lines": [line("a", 0), line("b", 10)]}, {"lines": None}, {"lines": [line("c", 20)]}], "images": [image, {**image, "xref": 5, "transform": [0, 10, 20, 0, 0, 0], "smask": 7}]}, {"doc_id": 2, "page": 1}]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)) + "\nnot json\n")
    rows = layout.read_pages(spark, str(tmp_path / "pages.json"))
    assert [(r.block, r.line, r.span, r.text, r.y0) for r in layout.layout_spans(rows).orderBy("line", "span").collect()] == [(0, 0, 0, "a", 0.0), (0, 0, 1, "!", 0.0), (0, 1, 0, "b", 10.0), (0, 1, 1, "!", 10.0), (2, 2, 0, "c", 20.0), (2, 2, 1, "!", 20.0)]
    assert [(r.xref, r.skew, r.masked, r.ix1, r.iy1) for r in layout.page_images(rows).orderBy("xref").collect()] == [(4, 0.0, False, 10.0, 20.0), (5, 31.0, True, 10.0, 20.0)]
    assert [r.n_pages for r in layout_ops.page_counts(rows).orderBy("doc_id").collect()] == [1, 1]
    sizes = spark.createDataFrame([(10, 10), (9, 10)], "w int, h int")
    assert [r.p for r in sizes.select(raster.size_problem(F.col("w"), F.col("h"), 10, 5).alias("p")).collect()] == [None, "at least 10 x 5 pixels, not 9 x 10"]


def test_sources(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Second \r\nbody")
    (tmp_path / "a.md").write_text("no heading")
    tabs = markup.labelled_tabs(markup.read_texts(spark, str(tmp_path / "*.md"))).collect()
    assert [(r.name, r.label, r.body) for r in tabs] == [("a.md", "Untitled", "no heading"), ("b.md", "Second", "body")]
    (tmp_path / "rules.json").write_text('{"tags": {"x": ["Para", "title"], "y": ["para"]}}')
    (tmp_path / "bad.json").write_text("nope")
    names = lambda p: sorted(r.name for r in markup.read_vocabulary(spark, str(tmp_path / p), ["A"]).collect())
    assert names("rules.json") == ["para", "title"] and names("bad.json") == ["a"]
    assert names("missing.json") == ["a"]
    assert markup.optional_text(spark, str(tmp_path / "a.md")) == "no heading" and markup.optional_text(spark, str(tmp_path / "none")) is None
    (tmp_path / "x.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    (tmp_path / "fake.png").write_bytes(b"12345678")
    (tmp_path / "long.jpg").write_bytes(bytes.fromhex("FFD8FF00") * 9)
    uploads = markup.read_uploads(spark, str(tmp_path), most_bytes=8).collect()
    assert [(r.name, r.kind, r.length) for r in uploads] == [("x.png", "png", 8)] and len(uploads[0].token) == 32
    assert markup.setting("most", {"most": 3}, 9, env={}) == 3 and markup.setting("most", {}, 9, env={"MOST": "x"}) == 9 and markup.setting("most", {}, 9, env={"MOST": "4"}) == 4
    assert markup.setting("flag", {}, True, env={"FLAG": "false"}) is False and markup.setting("flag", {}, True, env={"FLAG": "maybe"}) is True
    assert markup.setting("name", {}, "plain", env={"NAME": ""}) == "plain" and markup.setting("name", {}, "plain", env={"NAME": "x"}) == "x"
    results = spark.createDataFrame(pd.DataFrame({"token": ["ab", "ab", "zz"], "version": [1, 2, 1], "kind": ["old", "list", "x"]}))
    markup.save_results(results, str(tmp_path / "out"))
    saved = lambda: sorted((r.token, r.kind) for r in markup.load_results(spark, str(tmp_path / "out"), "kind string").collect())
    assert saved() == [("ab", "list")]
    markup.save_results(results.limit(0).unionAll(spark.createDataFrame(pd.DataFrame({"token": ["bb", "cc"], "version": [1, 1], "kind": ["p", "q"]}))), str(tmp_path / "out"))
    markup.save_results(spark.createDataFrame(pd.DataFrame({"token": ["ab"], "version": [1], "kind": ["new"]})), str(tmp_path / "out"))
    assert saved() == [("ab", "new"), ("bb", "p"), ("cc", "q")]
    markup.delete_results(spark, str(tmp_path / "out"), ["bb", "zz"])
    assert saved() == [("ab", "new"), ("cc", "q")]
    page = spark.createDataFrame([("<!-- a\n# b --> # Title\nbody <!-- c -->",)], "text string")
    assert markup.legal_page(page).first().text == "body "
