"""Findings and repairs worked out once for each skeleton are those of every text."""

import random

import pyarrow as pa

from quill.operators import skeletons
from quill.operators.lineage import _KEPT, cut
from quill.operators.repairs import suggest_fixes, suggest_shared
from quill.operators.route import all_findings, dedup_findings, nested_once, shared_findings
from quill.operators.skeletons import bounds_of, in_texts, skeleton
from quill.operators.tags import tag_stream
from quill.plans import catalog

SF = "/root/testdata/sf0.001"
PIECES = [
    "<section>", "</section>", "<title>", "</title>", "<para>", "</para>", "<itemizedlist>", "</itemizedlist>", "<listitem>", "</listitem>", "<informaltable>", "<tbody>", "<tr>", '<td colspan="2">', "</td>", "</tr>", "</tbody>", "</informaltable>",
    "<imageobject/>", "<mediaobject>", "</mediaobject>", "<foo\nbar='x y'\nz>", "<!-- a > b --", "-->", "<!--", "<?x > y?>", "<?x", "?>", "x", " said here ", "café \U0001d518", "a\n b\n\nc", "\n", "  ", " ", " ", "\r", "\t.", "1 < 2", ">", "<", "&amp;", "> a\nb >", "end",
]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(4)
    return ["", "  ", "plain", "\n a\nb<", "-->", *["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(n)], None]


def rows(frame) -> list[str]:
    return sorted(str(r) for r in frame.collect())


def test_findings_and_repairs_of_odd_texts(spark, monkeypatch):
    texts = odd_texts(400)
    # Each text a second time with other words, so that skeletons are shared.
    again = [t and t.replace("said here", "wordsé and more words").replace("end", "e") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts + again)), "doc_id long, text string").repartition(4, "doc_id")
    tags = nested_once(tag_stream(docs), parts=4)
    plain = cut(dedup_findings(all_findings(docs, tags, parts=4)))
    shared, tags_of, found = shared_findings(docs, parts=4)
    assert shared.skeletons.count() < 0.6 * len(texts + again)
    found = cut(dedup_findings(found))
    places = [c for c in plain.columns if c.endswith("start") or c.endswith("end") or c == "first_sub"]
    expected = rows(plain.select(sorted(plain.columns)))
    assert len(expected) > 2000 and expected == rows(in_texts(shared, found, places, "doc_id").select(sorted(plain.columns)))
    monkeypatch.setattr(skeletons, "BROADCAST", -1)
    assert expected == rows(in_texts(shared, found, places, "doc_id").select(sorted(plain.columns)))
    expected = rows(suggest_fixes(docs, plain, tags, parts=4))
    assert len(expected) > 500 and expected == rows(suggest_shared(shared, found, tags_of)) == rows(suggest_shared(shared, found, tags_of, cut_up=False))


def test_places_at_brackets():
    texts = ["", "<a>x</a>", "é<b>ü>>", "", "plain", "<", ">", "<\U0001d518>", None]
    told = lambda t: [0, *[i + (c == ">") for i, c in enumerate(t) if c in "<>"], len(t)]
    for part in (slice(0, 9), slice(2, 9), slice(3, 5), slice(0, 0)):
        assert bounds_of(pa.array(texts, pa.string())[part]).to_pylist() == [told(t or "") for t in texts[part]]


def test_skeletons_keep_comments_and_lines(spark):
    made = {"<p>a b</p> c": "<p>x</p> x", "a\n b<p>": "x\n x<p>", "<p>a\n\n  b c\n</p>": "<p>x\n\n  x\n</p>", "<!-- a > b -->": "<!-- a > b -->", "<p a='1'\nb>": "<p a='1'\nb>", "<p>1 < 2</p>": "<p>x< 2</p>", "<?x > y?>z": "<?x > y?>x"}
    docs = spark.createDataFrame([(t,) for t in made], "text string")
    assert dict(docs.select("text", skeleton(docs.text)).collect()) == made


def test_checkers_read_each_skeleton_once(spark):
    for name in ("structure_findings", "fix_options", "check_route"):
        before = len(_KEPT)
        catalog.QUERIES[name](spark, SF)
        read = [spark.table(t).select("doc_id").distinct().count() for _, t in _KEPT[before:] if t and "plain_top" in spark.table(t).columns]
        assert read and max(read) < 800, name  # of 1,500 texts
