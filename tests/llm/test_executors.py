"""Operators where only the driver has the package on its path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def away(batches):
    try:
        import quern
        raise RuntimeError("workers see the package")
    except ModuleNotFoundError:
        yield from batches

assert spark.range(2).mapInArrow(away, "id long").count() == 2
from quern.llm import queries
import corpus_pipeline
docs = [(i, f"word{i} " + "some words of a text " * 15 + "token = abcdefgh12", "en", "s", 9) for i in range(6)]
spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet("sf/documents.parquet")
spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet("sf/embeddings.parquet")
spark.createDataFrame([(i, "u", "html" * 40) for i in range(3)], "page_id long, url string, html string").write.parquet("sf/pages.parquet")
for name, query in (queries.queries() | corpus_pipeline.queries()).items():
    rows = query(spark, "sf").count()
    assert rows > 0 or name == "pipeline", name
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in run.stdout, run.stderr[-4000:]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quern.llm import common

    unset = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session)
