"""The driver contract: names, keys, and that the core runs without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45


def test_core_without_llm(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import importlib.util as u; f = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if 'llm' in n or n == 'corpus_pipeline' else f(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())\n"
        "assert not any('llm' in m for m in sys.modules if m.startswith('specweave'))\n"
    )
    subprocess.run([sys.executable, "-c", code, str(ROOT)], check=True)
