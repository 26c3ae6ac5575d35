"""Every core query with SQL gives the rows that the SQL gives."""

import pytest

from scholargraph.oracles import ORACLES
from scholargraph.queries import QUERIES
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['scholargraph.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()) and len(e.queries()) > 40"
    from tests.conftest import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
