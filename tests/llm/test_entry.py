"""The entry point where a library of the corpus package is missing."""

import subprocess
import sys
from pathlib import Path


def test_other_queries_stay(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for name in ("quill", "corpus_pipeline.py", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(root / name)
    (tmp_path / "zstandard.py").write_text("raise ImportError('hidden')")
    code = "import sys; sys.path.insert(0, ''); import __spark_entry__ as e; q = e.queries(); assert 'tag_stream' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
