"""The driver's entry points, with the optional parts and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and callable(e.entry); print(len(q))"


def test_names_and_sql_agree():
    assert int(subprocess.run([sys.executable, "-c", SAY], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 30


def test_engine_stands_alone(tmp_path):
    shutil.copytree(ROOT / "kmerloom", tmp_path / "kmerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert int(subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout) > 30


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "kmerloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "kmerloom.llm" not in path.read_text()


def test_command_line(tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGTTGCAAGCTTACGATCGATTTAGC\n>b\nGATTACAGATTACA\n")
    run = lambda *a: subprocess.run([sys.executable, "-m", "kmerloom", *map(str, a)], cwd=ROOT, capture_output=True, text=True)
    built = run("build", "-i", tmp_path / "x.fa", "-k", 7, "-m", 4, "-o", tmp_path / "i", "--csv", tmp_path / "csv", "--verbose", "--check")
    assert len([x for x in (tmp_path / "csv").iterdir() if x.suffix == ".csv"]) == 1
    assert built.returncode == 0, built.stderr[-2000:]
    assert '"ok": true' in built.stdout
    asked = run("query", "-i", tmp_path / "i", "-q", tmp_path / "x.fa", "-o", tmp_path / "codes")
    assert asked.returncode == 0 and '"n_kmers": 29' in asked.stdout, asked.stdout + asked.stderr[-2000:]
    assert run("build", "-i", tmp_path / "x.fa", "-k", 7, "-m", 9).returncode == 3
    based = run("baseline", "-i", tmp_path / "x.fa", "-k", 7, "--method", "rank", "-o", tmp_path / "b", "--check", "--csv", tmp_path / "csv2")
    assert based.returncode == 0 and '"ok": true' in based.stdout, based.stderr[-2000:]
    found = run("baseline-query", "-i", tmp_path / "b" / "rank", "-q", tmp_path / "x.fa", "--csv", tmp_path / "csv3")
    assert found.returncode == 0 and '"n_kmers": 29' in found.stdout and any(x.suffix == ".csv" for x in (tmp_path / "csv3").iterdir()), found.stderr[-2000:]
    assert run("query", "-i", tmp_path / "none", "-q", tmp_path / "x.fa").returncode == 2
