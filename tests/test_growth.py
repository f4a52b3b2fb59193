"""What must not grow with the input: tables that plans broadcast through the driver, rows that joins or windows make."""

from pyspark.sql import functions as F

from quill.operators.findings import dedup_findings
from quill.operators.layout import best_overlap
from quill.operators.lineage import _KEPT, cut, met_by_text
from quill.operators.repairs import strip_xinfo
from quill.operators.state import lost_of_lists
from quill.operators.tags import matched, tag_stream
from quill.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    """The plan as it was run, with what was decided on the way."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_table_regions_are_not_broadcast(spark):
    assert "Broadcast" not in plan(catalog.QUERIES["table_fragments"](spark, SF))


def test_readings_are_not_broadcast(spark):
    for name in ("ocr_flags", "ocr_review_apply", "ocr_column_profile"):
        assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF)), name


def test_equal_rectangles_meet_once(spark):
    n = 3000
    clips = spark.range(n).selectExpr("id AS clip_id", "0 AS k", "0D AS x0", "0D AS y0", "10D AS x1", "10D AS y1")
    images = spark.range(n).selectExpr("id AS image_id", "0 AS k", "0D AS ix0", "0D AS iy0", "10D AS ix1", "10D AS iy1")
    one = images.filter("image_id = 7").unionAll(images.filter("image_id <> 7").withColumns({"ix0": F.lit(200.0), "ix1": F.lit(210.0)}))
    assert best_overlap(clips, images, "k").count() == 0  # of equal images none has most of the overlap
    assert {(r.image_id, r.overlap) for r in best_overlap(clips, one, "k").collect()} == {(7, 100.0)} and best_overlap(clips, one, "k").count() == n
    seen = best_overlap(clips, images, "k", 0.0, 0.0)
    assert seen.count() == n and {r.image_id for r in seen.collect()} == {0}
    assert n <= max(rows_of(seen)) <= 2 * n  # and not n * n


def rows_of(frame) -> list[int]:
    """How many rows each step of a plan gave."""
    frame.collect()
    out, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            todo.append(inner)
            continue
        metric = node.metrics().get("numOutputRows")
        out += [metric.get().value()] if metric.isDefined() else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_xinfo_attributes_are_matched_once_for_each_tag(spark):
    made = strip_xinfo(spark.createDataFrame([(1, '<section xinfo:a="1"><para xinfo:b="2" c>xinfo:d="3"<p>')], "doc_id long, text string"))
    assert made.first().text == '<section xinfo:a="1"><para c>xinfo:d="3"<p>'
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def written(frame) -> list[int]:
    """How many bytes each exchange between tasks wrote in a plan."""
    frame.collect()
    out, todo, seen = [], [frame._jdf.queryExecution().executedPlan()], set()
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            todo.append(inner)
            continue
        if name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            out.append(node.metrics().get("shuffleBytesWritten").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_checkers_do_not_deal_the_tags_again(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("structure_findings", "topic_findings", "fix_candidates"):
            assert sum(written(catalog.QUERIES[name](spark, SF))) < 500_000, name  # 1,500 texts with 24,000 tags
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_words_are_neither_broadcast_nor_rows(spark):
    seen = catalog.QUERIES["word_multiset_guard"](spark, SF)
    assert max(rows_of(seen)) <= 1000  # the documents, not their words
    lists = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, None)], "text_id long, words array<string>")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 1, 3), (5, 1, 9)], "pair_id long, old long, new long")
    lost = lost_of_lists(lists, pairs)
    assert dict(lost.collect()) == {1: 2, 2: 0, 3: 0, 4: 3, 5: 3} and "Broadcast" not in plan(lost)


def test_words_of_paragraphs_stay_where_their_text_is(spark):
    seen = catalog.QUERIES["styled_paragraphs"](spark, SF)
    exchanges = [n for n in seen._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in n]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]  # that of whole texts


def test_paired_tags_stay_where_their_text_is(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k, "<a><b/>x</a><c>") for k in range(50)], "doc_id long, text string")
        tags = cut(tag_stream(docs), "doc_id", 4)
        with met_by_text(spark):
            met = matched(tags).join(tags.select("doc_id", "start", "seq"), ["doc_id", "start"])
            assert "Exchange" not in plan(met) and met.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_findings_are_dealt_once(spark):
    columns = "doc_id long, line long, start long, message string, tag string, checker int"
    found = spark.createDataFrame([(k % 5, 1, k, f"m{k % 3}", None, k % 2) for k in range(40)], columns)
    once = dedup_findings(found, parts=4)
    assert plan(once).count("Exchange hashpartitioning") == 1 and sorted(once.collect()) == sorted(dedup_findings(found).collect())


def test_texts_are_made_once_for_repairs(spark):
    for name in ("fix_options", "fix_candidates"):
        assert "lineitem" not in plan(catalog.QUERIES[name](spark, SF)), name


def test_plain_tags_are_told_as_others(spark):
    text = "<a/></b/><C.d-e>x</C.d-e >< f ><\u00e9><g/ ><h i='1'/><j\u00e9><k //></ l><m\u00a0n><o_p></q.>"
    rows = tag_stream(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("seq").collect()
    names = [("a", "", 0, 1), ("b", "", 1, 0), ("c.d-e", "", 0, 0), ("c.d-e", "", 1, 0), ("f", "", 0, 0), ("g", "", 0, 1), ("h", " i='1'", 0, 1), ("j\u00e9", "", 0, 0), ("k", " /", 0, 1), ("l", "", 1, 0), ("m", "\u00a0n", 0, 0), ("o_p", "", 0, 0), ("q.", "", 1, 0)]
    assert [(r["name"], r["attrs"], int(r["is_close"]), int(r["is_self"])) for r in rows] == names


def test_fragments_are_made_and_cut_into_tags_once(spark):
    before = len(_KEPT)
    seen = plan(catalog.QUERIES["normalize_fragments"](spark, SF))
    made = [spark.table(name) for _, name in _KEPT[before:] if name]
    assert "orders" not in seen and [set(t.columns) for t in made] == [{"doc_id", "source", "text"}, {"doc_id", "start", "end", "name"}]
    assert made[1].filter("name not in ('ul', 'ol', 'itemizedlist', 'orderedlist', 'table', 'informaltable')").count() == 0
