"""Conversions worked out once for each form of texts are those of every text."""

import random

from pyspark.sql import functions as F

from quill.operators import normalize as NO
from quill.operators import skeletons
from quill.operators.lineage import _KEPT
from quill.plans import catalog

PIECES = [
    "<ul>", "</ul>", "<ol numeration='loweralpha'>", "</ol>", "<li>", "</li>", "<table>", "</table>", "<tgroup cols='1'>", "</tgroup>", "<tbody>", "</tbody>", "<tfoot>", "</tfoot>", "<row>", "</row>", "<entry>", "</entry>", "<tr>", "</tr>", "<th>", "</th>", "<td colspan='2'>", "</td>",
    "<p>", "</p>", "<b>", "</b>", "<br/>", "<title>", "</title>", "word", " some words here ", "a\n\n b", "&", "&amp;", "& co;", "x&y z", "1 < 2", "a > b c >", "-->", "```", "```html\n", "<?xml a > b?>", "", "0 x", "  ", "été \U0001d518", "12;",
]


def rows(frame):
    return sorted(str(r) for r in frame.collect())


def test_fragments_of_odd_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \n", "no tags", "```\n<p>a</p>\n```", *["".join(rng.choices(PIECES, k=rng.randint(2, 14))) for _ in range(250)]]
    for open_, shut in (("<ul>", "</ul>"), ("<table>", "</table>")):
        inner = [f"<li>{x}</li>" if open_ == "<ul>" else f"<tr><td>{x}</td></tr>" for x in PIECES[-18:]]
        texts += [open_ + "".join(rng.choices(inner, k=rng.randint(1, 4))) + shut for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + [t and t.replace("word", "other") for t in texts])), "doc_id long, text string")
    shared = rows(NO.normalize(docs))
    monkeypatch.setattr(skeletons, "BROADCAST", -1)
    monkeypatch.setattr(NO, "form", lambda text: F.concat(F.lit(skeletons._END), text))  # every text as it is
    assert shared == rows(NO.normalize(docs)) and sum("changed=True" in r for r in shared) > 250


def test_forms_are_converted_once(spark):
    before = len(_KEPT)
    catalog.QUERIES["normalize_fragments"](spark, "/root/testdata/sf0.001")
    spans = next(spark.table(t) for _, t in _KEPT[before:] if t and "name" in spark.table(t).columns)
    assert 0 < spans.count() < 40  # of 1,500 texts
