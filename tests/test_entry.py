"""The driver contract, with and without the subpackage of training-data operators."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _keys(prelude: str) -> list[str]:
    code = f"{prelude}\nimport __spark_entry__ as e\nprint('KEYS', *sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    return out.partition("KEYS ")[2].split()


def test_queries_without_the_subpackage():
    keys = _keys("import sys; sys.modules['basketry.llm'] = None")
    assert "customer_ranking" in keys and "pipeline" not in keys
    assert not any(re.match(r"op\d+_", k) for k in keys)


def test_every_oracle_has_a_query():
    for prelude in ("", "import sys; sys.modules['basketry.llm'] = None"):
        keys = _keys(prelude)
        queries, oracles = keys[: keys.index("|")], keys[keys.index("|") + 1:]
        assert set(oracles) <= set(queries) and len(queries) == len(set(queries))


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "basketry")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f)).read(), f
