import os
import subprocess
import sys

import pytest
from compare import duck_rows, spark_rows

from assayframe.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck, sf_dir):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(duck, SQL[name])


def test_entry_works_without_these_operators(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(["cp", "-r", f"{repo}/assayframe", f"{repo}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "assayframe" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
