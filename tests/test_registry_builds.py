"""Every registered query of the reference's own operators builds its plan, and no module defines a name twice."""

import ast
import os
from collections import Counter
from pathlib import Path

import pytest

from checks import load_all, registry

#: Streams and model fits run whole while they are set up; they have tests of their own.
RUN_AT_ONCE = ("st0", "m0", "a66")
ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
load_all()


def test_no_module_defines_a_name_twice():
    for path in [*ROOT.glob("*.py"), *ROOT.glob("seqtide/**/*.py"), *ROOT.glob("checks/*.py")]:
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef) and n.name != "_")
        assert not [n for n, k in names.items() if k > 1], path


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith(RUN_AT_ONCE)))
def test_query_builds_its_plan(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    frame = registry.QUERIES[name](spark, DATA)
    assert frame.columns and frame._jdf.queryExecution().executedPlan() is not None
