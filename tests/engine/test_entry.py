import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_the_rest_works_without_the_training_data_subpackage(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    for p in [*ROOT.glob("*.py"), *(ROOT / "turnweave").rglob("*.py")]:
        to = copy / p.relative_to(ROOT)
        if "llm" not in to.parts and p.name != "corpus_pipeline.py":
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dialog_merge' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('fine')"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.strip() == "fine"


def test_the_rest_works_where_the_training_data_subpackage_lacks_a_library():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'dialog_merge' in q and not any(k.startswith('op') for k in q); e.oracle_sql(); print('fine')"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip() == "fine"


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
