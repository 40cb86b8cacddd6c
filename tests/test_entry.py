"""The registry: importable before a session exists, names with SQL are queries."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 40"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_queries_stay_without_the_training_data_part(tmp_path):
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['rasterforest.llm'] = None\n"
        "import __spark_entry__ as e; assert 'area_opening' in e.queries() and not any(n.startswith('op1') for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
