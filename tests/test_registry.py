import subprocess
import sys

import pytest
from compare import check

import __spark_entry__
from quadrant.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_core_imports_without_llm():
    code = "import sys; sys.modules['quadrant.llm'] = None; import __spark_entry__ as e; assert 'gini' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
