import pytest
from conftest import SF, same

from quillgraph.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_imports_without_the_training_data_package():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillgraph.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
    )
    import conftest

    subprocess.run([sys.executable, "-c", code], cwd=conftest.ROOT, check=True, timeout=120)


def test_workers_need_no_installed_package(tmp_path):
    import os
    import subprocess
    import sys

    import conftest

    code = (
        f"import sys; sys.path.insert(0, {conftest.ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "for name in ('ret1_vector_search', 'udf1_chunk_documents', 'ret11_answers'):\n"
        f"    assert e.queries()[name](spark, {conftest.SF!r}).count() > 0\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
