from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from tidemark.session import materialize, scratch_path, scratch_scope

ROOT = Path(__file__).resolve().parents[1]


def test_intermediate_tables_go_with_their_scope(spark):
    with scratch_scope(spark):
        table = materialize(spark.range(10))
        assert table.count() == 10
        (path,) = {os.path.dirname(f) for f in table.inputFiles()}
        with scratch_scope(spark):
            inner = scratch_path(spark, "inner")
            spark.range(1).write.parquet(inner)
        assert os.path.exists(path.removeprefix("file://")) and not os.path.exists(inner.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_the_state_store_does_not_read_before_each_write(spark):
    store = "spark.sql.streaming.stateStore.rocksdb"
    assert (spark.conf.get(f"{store}.trackTotalNumberOfRows"), spark.conf.get(f"{store}.changelogCheckpointing.enabled")) == ("false", "true")


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
from tidemark.catalog import QUERIES
rows = sum(QUERIES[name](spark, "/root/testdata/sf0.001").count() for name in ("a7_bootstrap_exact", "g2_own_size_probe"))
spark.stop()
print("rows", rows)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from another folder, the package only on the driver's path; afterwards the shared folder is empty."""
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=str(ROOT), shared=str(shared))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 6
    assert not any(shared.rglob("*.parquet"))
