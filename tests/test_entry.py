"""The driver contract, with and without the optional package."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_without_the_optional_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    for missing in ("corpus_pipeline", "trendloom.llm", "public_tokenizers"):
        subprocess.run([sys.executable, "-c", code.replace("corpus_pipeline", missing)], check=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=100)
