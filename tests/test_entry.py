"""The driver contract with and without the training-data operators."""

import subprocess
import sys

import pytest

ROOT = __file__.rsplit("/tests/", 1)[0]


def names_without(*absent):
    """Query names as a fresh process sees them when the modules are absent."""
    code = (
        f"import sys; sys.modules.update(dict.fromkeys({absent!r}))\n"
        "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    if done.returncode:
        raise ImportError(done.stderr)
    queries, oracles = done.stdout.splitlines()
    return set(queries.split()), set(oracles.split())


@pytest.mark.parametrize(
    "absent", [("corpus_pipeline", "peagelens.llm"), ("peagelens.llm",), ("corpus_pipeline",)]
)
def test_rest_stands_alone(absent):
    queries, oracles = names_without(*absent)
    assert "breakdowns_one_pass" in queries and oracles <= queries
    assert not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_other_missing_modules_are_errors():
    with pytest.raises(ImportError, match="pyarrow"):
        names_without("pyarrow")
