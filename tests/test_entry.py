import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/fieldweave", tmp_path / "fieldweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and all(n[0] == 'q' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(f"{ROOT}/fieldweave", tmp_path / "fieldweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "fieldweave" / "llm").mkdir()
    (tmp_path / "fieldweave" / "llm" / "__init__.py").write_text("")
    (tmp_path / "fieldweave" / "llm" / "queries.py").write_text("import no_such_library\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "no_such_library" in done.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["q01_normalize", "q02_reject_reasons", "q03_conflicts", "q04_dedup_clean", "q06_components", "q08_leakage", "q13_encode", "q14_cosine_topk", "q16b_class_metrics", "q18_end_to_end_metrics", "q19_rerank_gate", "q23_split_validation"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    own = entry.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in ("part", "customer", "embeddings", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(want.columns)
    ordered = [d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (own, want)]
    assert ordered[0].equals(ordered[1])
