"""The driver's contract: names, SQL for known queries only, and a library that stands without the training-data part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_part():
    for p in (ROOT / "parchmint").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "parchmint.llm" not in p.read_text(), p


def test_entry_without_the_training_data_part(tmp_path):
    for p in ["__spark_entry__.py", *(q.relative_to(ROOT) for q in (ROOT / "parchmint").rglob("*.py"))]:
        if "llm" not in Path(p).parts:
            to = tmp_path / p
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text((ROOT / p).read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr
