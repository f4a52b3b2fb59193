"""Markup operators against plain stack versions and worked examples."""

import random
import re

import pytest

from quill.operators.findings import dedup_findings, report_lines, summarize
from quill.operators.normalize import normalize
from quill.operators.repairs import keeps_words, splice, strip_xinfo, suggest_fixes
from quill.operators.trees import convert_lists, convert_tables
from quill.operators.sections import check_loose_text, check_media, check_placement, check_sections
from quill.operators.route import check
from quill.operators.structure import check_lists, check_outside_root, check_paragraphs, check_tables, nested
from quill.operators.tags import child_spans, matched, outer_spans, tag_stream, translate_inline, unbalanced_tags

TAG = re.compile(r"<\s*(/?)\s*([A-Za-z][\w.-]*)([^<>]*?)(/?)\s*>")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(5)
    parts = ["<a>", "</a>", "<b x='1'>", "</b>", "<a/>", "\n", "tëxt \U0001f600 ", "< / A >", "<!-- x -->", "<ul>", "</ul>", "<ol>", "</ol>", "<", ">"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(150)]


def test_tag_stream(spark, random_texts):
    got = {}
    for r in tag_stream(frame(spark, random_texts)).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.start, r.end, r.line, r.name, r.attrs, r.is_close, r.is_self, r.gap))
    for d, t in enumerate(random_texts):
        expected, last = [], 0
        for k, m in enumerate(TAG.finditer(t)):
            expected.append((k, m.start(), m.end(), t.count("\n", 0, m.start()) + 1, m[2].lower(), m[3], m[1] == "/", m[4] == "/" and m[1] != "/", t[last : m.start()]))
            last = m.end()
        assert sorted(got.get(d, [])) == expected


def test_unbalanced(spark, random_texts):
    got = {(r.doc_id, r.start, r.code) for r in unbalanced_tags(tag_stream(frame(spark, random_texts))).collect()}
    expected = set()
    for d, t in enumerate(random_texts):
        open_ = {}
        for m in TAG.finditer(t):
            name, close, self_ = m[2].lower(), m[1] == "/", m[4] == "/" and m[1] != "/"
            if self_:
                continue
            if not close:
                open_.setdefault(name, []).append(m.start())
            elif open_.get(name):
                open_[name].pop()
            else:
                expected.add((d, m.start(), "tag.stray_close"))
        expected |= {(d, s, "tag.unclosed") for starts in open_.values() for s in starts}
    assert got == expected


def test_outer_spans(spark, random_texts):
    got = {(r.doc_id, r.start, r.end) for r in outer_spans(tag_stream(frame(spark, random_texts)), ["ul", "ol"]).collect()}
    expected = set()
    for d, t in enumerate(random_texts):
        depth = start = 0
        for m in TAG.finditer(t):
            if m[2].lower() not in ("ul", "ol"):
                continue
            if m[1] != "/":
                start = m.start() if depth == 0 else start
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    expected.add((d, start, m.end()))
    assert got == expected


def test_inline(spark):
    got = translate_inline(frame(spark, ["<b>x</b> <STRONG a='1'>y</ strong> <i/>z<em>w</em> <body><br><b.c>"])).first()
    assert got.text == '<emphasis role="strong">x</emphasis> <emphasis role="strong">y</emphasis> z<emphasis>w</emphasis> <body><br><b.c>' and got.n_translated == 7


def codes(rows):
    return sorted((r.doc_id, r.start, r.code) for r in rows.collect())


def test_media(spark):
    texts = [
        '<mediaobject><imageobject><imagedata fileref="a"/></imageobject></mediaobject>',
        "<mediaobject></mediaobject><mediaobject><imageobject></imageobject></mediaobject>",
        '<imageobject><imagedata fileref="a"/></imageobject></mediaobject><mediaobject/>',
        "<mediaobject><imageobject><imagedata/></imageobject></mediaobject><mediaobject>",
    ]
    assert codes(check_media(tag_stream(frame(spark, texts)))) == [
        (1, 0, "media.no_imageobject"), (1, 27, "media.no_imagedata"),
        (2, 0, "media.outside"), (2, 13, "media.outside"), (2, 51, "media.stray_close"), (2, 65, "media.self_closed"),
        (3, 26, "media.no_fileref"),
    ]


def test_sections(spark):
    texts = [
        "<section><title>a</title><para>x</para></section>",
        "<section><para>x</para></section>",
        "<section><para>x</para><title>a</title></section>",
        "<section><title>a</title><title>b</title><section><title>c</title></section><para>late</para></section>",
        "<section><title>a</title>",
    ]
    assert codes(check_sections(tag_stream(frame(spark, texts)))) == [(1, 0, "section.no_title"), (2, 0, "section.title_not_first"), (3, 0, "section.titles"), (3, 76, "section.late_content")]


def test_placement_and_text(spark):
    texts = [
        "<table><tbody><tr><td><para>x</para></td></tr></tbody></table>",
        "<table><tr><td></td></tr></table>",
        "<itemizedlist>loose<listitem><para><para>x</para></para></listitem><para>y</para></itemizedlist>",
        "<table><tbody><tr>a<td></td>b</tr></tbody></table>",
    ]
    tags = tag_stream(frame(spark, texts))
    assert codes(check_placement(tags)) == [(1, 7, "table.misplaced_child"), (2, 35, "para.misplaced_child"), (2, 67, "list.misplaced_child")]
    assert codes(check_loose_text(tags)) == [(2, 19, "list.text_in_container"), (3, 19, "table.text_in_container"), (3, 29, "table.text_in_container")]


def test_report(spark):
    docs = frame(spark, ["<a>\n</b>\n", "fine", None])
    found = unbalanced_tags(tag_stream(docs))
    said = {r.doc_id: r.summary for r in summarize(found, docs).collect()}
    assert said == {0: "2 problems: 1 unclosed tag, 1 extra closing tag", 1: "No problems found.", 2: "No problems found."}
    from pyspark.sql import functions as F

    twice = found.withColumn("checker", F.lit(1)).unionAll(found.withColumn("checker", F.lit(2)))
    assert [(r.start, r.checker, r.place) for r in dedup_findings(twice).orderBy("place").collect()] == [(0, 1, 1), (4, 1, 2)]
    lines = {(r.doc_id, r.num): r.notes for r in report_lines(docs, found).collect()}
    marked = {(r.doc_id, r.num): r.html for r in report_lines(docs, found).collect()}
    assert marked[0, 1] == '<span class="bad">&lt;a&gt;</span>' and marked[1, 1] == "fine"
    by_tag = report_lines(frame(spark, ["x <b> & <b>"]), spark.createDataFrame([(0, 1, "b", "m"), (0, 9, None, "n")], "doc_id long, line long, tag string, message string")).first()
    assert (by_tag.html, by_tag.notes) == ('x <span class="bad">&lt;b&gt;</span> &amp; &lt;b&gt;'.replace("<b>", "&lt;b&gt;"), ["m", "n"])
    assert lines[0, 1] == ["<a> stays open"] and lines[0, 2] == ["</b> closes nothing"] and lines[0, 3] == [] and lines[2, 1] == []


def test_repairs(spark):
    docs = frame(spark, ["one\n  </para>\ntwo", "<para>a <emphasis>b</emphasis> c\n<para>d</para>", "<section>x<section>y</section>"])
    tags = tag_stream(docs)
    got = {(r.doc_id, r.label): r.new_text for r in suggest_fixes(docs, unbalanced_tags(tags), tags).collect()}
    assert got == {
        (0, "Delete the tag"): "one\ntwo",
        (1, "Close it before the next block"): "<para>a <emphasis>b</emphasis> c</para>\n<para>d</para>",
        (2, "Close it at the end"): "<section>x<section>y</section></section>",
        (2, "Close it before the next section"): "<section>x</section><section>y</section>",
    }


def test_lists(spark):
    texts = [
        "a <ul><li>x  y</li>\n<li><a href='#'>z</a> <i>i</i></li></ul> <ol><li>1</li></ol>",
        "<ul><li>a<ul><li>b</li></ul> c</li><li></li></ul>",
        "<ul><li><p>a</p><p>b</p></li></ul>",
        "<ul><li>a</ul>", "<ul>text</ul>", "<ul><li>a</li><ul><li>b</li></ul></ul>", "<ul><li><table></table></li></ul>",
    ]
    docs = frame(spark, texts)
    got = {(r.doc_id, r.start): r.xml for r in convert_lists(docs, outer_spans(tag_stream(docs), ["ul", "ol"])).collect()}
    assert got[0, 2] == "<itemizedlist><listitem><para>x y</para></listitem><listitem><para>z <emphasis>i</emphasis></para></listitem></itemizedlist>"
    assert got[0, texts[0].index("<ol>")] == "<orderedlist><listitem><para>1</para></listitem></orderedlist>"
    # An item's lists follow its paragraphs; a list between items falls to the one before.
    assert got[1, 0] == "<itemizedlist><listitem><para>a</para><para>c</para><itemizedlist><listitem><para>b</para></listitem></itemizedlist></listitem><listitem><para></para></listitem></itemizedlist>"
    assert got[2, 0] == "<itemizedlist><listitem><para>a</para><para>b</para></listitem></itemizedlist>"
    assert got[3, 0] == "<itemizedlist><listitem><para>a</para></listitem></itemizedlist>"
    assert got[4, 0] is None and got[6, 0] is None
    assert got[5, 0] == "<itemizedlist><listitem><para>a</para><itemizedlist><listitem><para>b</para></listitem></itemizedlist></listitem></itemizedlist>"


def converted(spark, convert, names, texts):
    docs = frame(spark, texts)
    return {r.doc_id: (r.xml, r.problem) for r in convert(docs, outer_spans(tag_stream(docs), names)).collect()}


def test_lists_as_trees(spark):
    item = lambda *inner: "<listitem>" + "".join(x if x.startswith("<") else f"<para>{x}</para>" for x in inner) + "</listitem>"
    bullets = lambda *items: f"<itemizedlist>{''.join(items)}</itemizedlist>"
    cases = {
        "<ul><ul><li>a</li></ul><li>b</li></ul>": bullets(item("", bullets(item("a"))), item("b")),
        "<ul><li>a</li><ul><li>a1</li></ul><ol><li>a2</li></ol><li>b</li></ul>": bullets(item("a", bullets(item("a1")), f"<orderedlist>{item('a2')}</orderedlist>"), item("b")),
        '<ol numeration="loweralpha"><li>x</li></ol>': f'<orderedlist numeration="loweralpha">{item("x")}</orderedlist>',
        '<ol numeration="odd"><li>x</li></ol>': f"<orderedlist>{item('x')}</orderedlist>",
        "<ul><li>b < c & d &amp; e</li></ul>": bullets(item("b &lt; c &amp; d &amp; e")),
        "<ul><li>one<li>two <b>x</b></ul>": bullets(item("one"), item('two <emphasis role="strong">x</emphasis>')),
        "<ul><li>a<br>b <span>c</span></li></ul>": bullets(item("a b c")),
        "<ul><li><p></p></li><li><p>p</p>rest<ul><li>n</li></ul>tail</li></ul>": bullets(item(""), item("p", "rest", "tail", bullets(item("n")))),
        "<ul><li>a <b>x<ul><li>y</li></ul>z</b></li></ul>": bullets(item("a x", "z", bullets(item("y")))),
        "<ul>stray<li>a</li>stray</ul>": bullets(item("a")),
    }
    deep = "<ul><li>x" * 40 + "</li></ul>" * 40
    got = converted(spark, convert_lists, ["ul", "ol"], [*cases, deep, "<ul></ul>", "<ul><li>see <table><tr><td>x</td></tr></table></li></ul>", "<ul><li><ol><li>a</ul></ol>", "<ul><li><b>x<ul><li>y</b></li></ul></li></ul>"])
    assert [got[k][0] for k in range(len(cases))] == list(cases.values())
    want = ""
    for _ in range(40):
        want = bullets(item("x", want) if want else item("x"))
    n = len(cases)
    assert got[n][0] == want
    assert got[n + 1] == (None, "a list has no items") and got[n + 2][0] is None and "<table>" in got[n + 2][1] and got[n + 3] == got[n + 4] == (None, "a list is not closed")


def test_tables_by_their_sections(spark):
    def table(head, *body, titles=""):
        row = lambda cells: "<tr>" + "".join(c if c.startswith("<") else f"<td><para>{c}</para></td>" for c in cells) + "</tr>"
        return f'{titles}<informaltable frame="box" rules="all">{f"<thead>{row(head)}</thead>" if head else ""}<tbody>{"".join(map(row, body)) or "<tr></tr>"}</tbody></informaltable>'

    th = lambda *texts: [f"<th><para>{t}</para></th>" for t in texts]
    cases = {
        "<table><thead><tr><td>H</td><th>I</th></tr></thead><tbody><tr><td>a</td><td>b</td></tr></tbody></table>": table(th("H", "I"), ["a", "b"]),
        "<table><tfoot><tr><td>f</td></tr></tfoot><tbody><tr><td>a</td></tr></tbody><tr><td>d</td></tr></table>": table(None, ["a"], ["f"], ["d"]),
        "<table><tr><th>A</th></tr><tr><th>B</th></tr></table>": table(th("A"), th("B")),
        "<table><tr><th>A</th></tr></table>": table(None, th("A")),
        "<table><tr><td> </td></tr><tr></tr></table>": table(None, [""]),
        "<TABLE><TR><TH>Head<TH>Other<TR><TD>first<TD>second</TABLE>": table(th("Head", "Other"), ["first", "second"]),
        "<table><tgroup cols='1'><tfoot><row><entry>f</entry></row></tfoot><thead><row><entry>H</entry></row></thead><tbody><row><entry>a<br/>b</entry></row></tbody></tgroup></table>": table(th("H"), ["a b"], ["f"]),
        "<table><caption>C <b>d</b></caption><tr><td colspan=2>AT&T &lt; 3</td></tr></table>": table(None, ['<td colspan="2"><para>AT&amp;T &lt; 3</para></td>'], titles="<para>C d</para>"),
        "<table><thead><tr><td>H</td></tr></thead></table>": table(th("H")),
        "<table><tr><td><ul><li>x</li><li>y</li></ul></td></tr></table>": table(None, ["x y"]),
    }
    got = converted(spark, convert_tables, ["table", "informaltable"], [*cases, "<table></table>", "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>", "<table><tgroup><tbody><row><entry namest='a'>x</entry></row></tbody></tgroup></table>"])
    assert [got[k][0] for k in range(len(cases))] == list(cases.values())
    assert [got[len(cases) + k] for k in range(3)] == [(None, "the table has no rows"), (None, "a table holds another"), (None, "its entries span columns or rows; convert it by hand")]


def test_check_knows_its_vocabulary_and_both_dialects(spark):
    cals = '<informaltable><tgroup cols="1"><tbody><row><entry>x</entry></row></tbody></tgroup></informaltable>'
    texts = [
        "<section><title>T</title><para>a<br>b</para><foo>x<bar></section>",
        f"<section><title>T</title><para>a</para>{cals}</section>",
        "<section><title>T</title><para>a</para>\n" + cals.replace("<entry>", "<entry namest='a'>") + "</section>",
        "<section><title>T</title>\n<ul><li>see <table><tr><td>x</td></tr></table></li></ul></section>",
    ]
    done = check(frame(spark, texts))
    found = {}
    for r in done.findings.collect():
        found.setdefault(r.doc_id, []).append((r.code, r.line))
    assert [c for c in found[0] if c[0].startswith("tag.")] == [] and 1 not in found
    assert ("dialect.table", 2) in found[2] and ("dialect.list", 2) in found[3]
    assert "<td><para>x</para></td>" in {r.doc_id: r.text for r in done.texts.collect()}[1]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    own = check(frame(spark, texts[:1]), vocabulary=spark.createDataFrame([("FOO",)], "name string"))
    assert [(r.tag, r.code) for r in own.findings.collect() if r.code.startswith("tag.")] == [("foo", "tag.unclosed")]


def test_normalize_edges(spark):
    got = {r.doc_id: (r.output, r.changed, r.diagnostic) for r in normalize(frame(spark, [None, " \n", "<table></table>", "<table><tr><td rowspan='2'>a</td></tr></table>x<p>y</p>"])).collect()}
    assert got[0] == ("", False, "Nothing to normalize.") and got[1] == (" \n", False, "Nothing to normalize.") and got[2][1:] == (False, "Nothing to change.")
    assert got[3] == ('<informaltable frame="box" rules="all"><tbody><tr><td rowspan="2"><para>a</para></td></tr></tbody></informaltable>x<para>y</para>', True, "Normalized 1 table(s) and 1 paragraph(s).")
    assert normalize(frame(spark, [None]).filter("false")).isEmpty()


def test_splice(spark):
    docs = frame(spark, ["abcdef", "xyz", None])
    edits = spark.createDataFrame([(0, 4, 6, "!"), (0, 1, 2, "--"), (0, 2, 2, "+")], "doc_id long, start long, end long, new string")
    assert [r.text for r in splice(docs, edits).orderBy("doc_id").collect()] == ["a--+cd!", "xyz", None]


def test_words_are_kept(spark):
    from pyspark.sql import functions as F

    cases = [(["a", "b", "a"], ["a", "x", "a", "b"], True), (["a", "a"], ["a", "b"], False), ([], ["a"], True), (["a"], [], False), ([], [], True)]
    rows = spark.createDataFrame([(i, o, n) for i, (o, n, _) in enumerate(cases)], "i long, o array<string>, n array<string>")
    assert [r.k for r in rows.orderBy("i").select(keeps_words(F.col("o"), F.col("n")).alias("k")).collect()] == [c[2] for c in cases]


def test_matched(spark, random_texts):
    got = {(r.doc_id, r.start): (r.p_start, r.p_end) for r in matched(tag_stream(frame(spark, random_texts))).collect()}
    expected = {}
    for d, t in enumerate(random_texts):
        open_ = {}
        for m in TAG.finditer(t):
            name, close, self_ = m[2].lower(), m[1] == "/", m[4] == "/" and m[1] != "/"
            if self_:
                expected[d, m.start()] = (m.end(), m.end())
            elif not close:
                expected[d, m.start()] = (None, None)
                open_.setdefault(name, []).append(m.start())
            elif open_.get(name):
                expected[d, open_[name].pop()] = (m.start(), m.end())
    assert got == expected


def test_child_spans(spark):
    text = "<section><section><section></section></section>x<section></section></section>"
    got = {r.start: (r.close_start, [tuple(c) for c in r.children]) for r in child_spans(tag_stream(frame(spark, [text])), "section").collect()}
    assert got == {0: (67, [(9, 47), (48, 67)]), 9: (37, [(18, 37)]), 18: (27, []), 48: (57, [])}


def test_lenient_stack(spark, random_texts):
    """What is open around each tag, against a plain stack."""
    got = {(r.doc_id, r.start): (r.top, r.closes) for r in nested(tag_stream(frame(spark, random_texts))).collect()}
    for d, t in enumerate(random_texts):
        stack = []
        for m in TAG.finditer(t):
            name, close, self_ = m[2].lower(), m[1] == "/", m[4] == "/" and m[1] != "/"
            top, closes = (stack[-1][0] if stack else None), None
            if close:
                k = max((i for i, (_, n) in enumerate(stack) if n == name), default=None)
                if k is not None:
                    closes = stack[k][0]
                    del stack[k:]
            elif not self_:
                stack.append((m.start(), name))
            assert got[d, m.start()] == (top, closes)


def test_structure_of_clean_texts(spark):
    texts = [
        '<table frame="box"><caption>Parts</caption><thead><tr><th><para>Part</para></th></tr></thead><tbody><tr><td><para>1</para></td></tr></tbody></table>',
        "<informaltable><tbody><tr><td><para>Steps:</para><orderedlist><listitem><para>one</para></listitem></orderedlist></td></tr></tbody></informaltable>",
        "<itemizedlist><listitem><mediaobject><imageobject/></mediaobject></listitem></itemizedlist>",
        "<orderedlist><listitem><itemizedlist><listitem><para>x</para></listitem></itemizedlist></listitem></orderedlist>",
        "<para>Use <guilabel>Home</guilabel> and <guibutton>OK</guibutton>, see <xref href='x'/> and <indexterm><primary>x</primary></indexterm>.</para>",
        "<table><tbody><tr><td rowspan='65535'><para>a</para></td><td><para>b</para></td></tr><tr><td><para>c</para></td></tr></tbody></table>",
    ]
    rows = nested(tag_stream(frame(spark, texts)))
    for check_one in (check_tables, check_lists, check_paragraphs):
        assert check_one(rows).isEmpty()
    sections = ['<?xml version="1.0"?><section><title>x</title></section><!-- end --> ', "no tags at all", " ", None, "<section/>"]
    docs = frame(spark, sections)
    assert codes(check_outside_root(tag_stream(docs), docs)) == [(1, 0, "section.outside_root")]


def test_route(spark):
    docs = frame(spark, ["<section>\r\n<title>t</title><ul><li>a</li></ul>\r\n<para>x</section>", None, ""])
    done = check(docs)
    summary = {r.doc_id: r.summary for r in done.summary.collect()}
    assert summary == {0: "1 problem: 1 unclosed tag", 1: "No problems found.", 2: "No problems found."}
    assert [r.new_text for r in done.fixes.collect()] == ["<section>\n<title>t</title><itemizedlist><listitem><para>a</para></listitem></itemizedlist>\n<para>x</para></section>"]
    lines = {(r.doc_id, r.num): (r.html, r.notes) for r in done.lines.collect()}
    assert lines[0, 3] == ('<span class="bad">&lt;para&gt;</span>x&lt;/section&gt;', ["<para> stays open"]) and lines[1, 1] == ("", [])


def test_xinfo(spark):
    texts = ['<a xinfo:x="1" b="2"><section xinfo:id="3"><section xinfo:id="4">', "<p xinfo:y='q'>", None, 'say xinfo:b="2" here <P  xinfo:b="2" c>', "</section><Section/><SECTION xinfo:a='1'>"]
    assert [r.text for r in strip_xinfo(frame(spark, texts)).orderBy("doc_id").collect()] == ['<a b="2"><section xinfo:id="3"><section>', "<p>", None, 'say xinfo:b="2" here <p c>', "</section><Section/><SECTION xinfo:a='1'>"]
