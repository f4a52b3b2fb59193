"""Every catalogue query against its SQL, and the entry points without the corpus package."""

import html
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", catalog.SQL)
def test_query(spark, duck, name):
    expected, got = duck.sql(catalog.SQL[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_header_snap(spark):
    got = catalog.QUERIES["header_snap"](spark, SF).toPandas()
    assert got["snapped"].notna().all() and got["snapped"].isin(["STANDARD NO."]).any()


def test_page_refs_and_styles_beyond_the_prefix(spark, tmp_path):
    texts = ["word " * 40 + "(see page 7) end", " ".join(f"w{i}<" for i in range(60)), "a  b\n c", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    flagged = {r.doc_id: r.text for r in catalog.QUERIES["page_ref_flag_whole"](spark, str(tmp_path)).collect()}
    assert '<span class="page-ref-flag">(see page 7)</span> end' in flagged[0] and flagged[4] is None

    def styled(text):
        runs = []
        for i, w in enumerate(text.split(" ")):
            style = "strong" if i % 5 in (1, 2) else "it" if i % 7 == 3 else ""
            key = (i % 5 in (1, 2), i % 7 == 3)
            if not runs or runs[-1][0] != key:
                runs.append([key, style, ""])
            runs[-1][2] += html.escape(w + " ").replace("&#x27;", "&#39;")
        out = ""
        for _, style, t in runs:
            core = t.strip()
            tag = '<emphasis role="strong">' if style == "strong" else "<emphasis>"
            out += t if not style or not core else t[: len(t) - len(t.lstrip())] + tag + core + "</emphasis>" + t[len(t.rstrip()) :]
        return f"<para>{out.strip()}</para>"

    got = {r.doc_id: r.xml for r in catalog.QUERIES["styled_paragraphs_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: styled(t) for i, t in enumerate(texts) if t is not None} and "w59&lt;" in got[1]


def test_layout_of_whole_pages(spark, tmp_path):
    texts = ["\n".join(f"line {i}" for i in range(n)) for n in (1, 100, 3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cells = catalog.QUERIES["line_in_cell_join_whole"](spark, str(tmp_path)).groupBy("doc_id").sum("n").collect()
    assert dict(cells) == {0: 1, 1: 100, 2: 3}
    found = {(r.doc_id, r.line) for r in catalog.QUERIES["region_filter_whole"](spark, str(tmp_path)).collect()}
    assert found == {(1, i) for i in range(100) if i % 50 in range(10, 40) and i % 11 != 10}


def test_entry_without_the_corpus_package(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "quill").mkdir()
    for path in root.glob("quill/*"):
        if path.name != "llm":
            (tmp_path / "quill" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tag_stream' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
