"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/helixframe", tmp_path / "helixframe", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'cube_margins' in n and not any(k.startswith('op') or k == 'pipeline' for k in n), n; assert set(e.oracle_sql()) <= set(n); print(len(n))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 200


def test_the_library_imports_nothing_of_the_optional_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/helixframe"):
        if "llm" in folder.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "helixframe.llm" not in f.read(), n
