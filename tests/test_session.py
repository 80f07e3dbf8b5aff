"""The shared scratch folder: for each kind of master, set or unset."""

import os
import subprocess
import sys

import pytest

from qoeflow import session
from qoeflow.llm.common import materialise

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CLUSTER = "spark://nowhere:7077"

UNSET = """
import sys
sys.path.insert(0, {root!r})
from qoeflow import session
from qoeflow.llm.common import materialise
from qoeflow.operators.ordinals import ordinal_within
spark = session.build_session("local[2]", 2, extra={{"spark.sql.warehouse.dir": "warehouse"}})
assert spark.conf.get("spark.checkpoint.dir", None) is None
spark.sparkContext.master = {master!r}
df = spark.range(5)
print("ROWS", session.write_once(df, "x").count(), materialise(df, "y").count(), ordinal_within(df, [], ["id"]).count())
print("DIR", session.shared_dir(spark) == session.shared_dir(spark), session.shared_dir(spark))
"""


@pytest.mark.parametrize("master, place", [("local[2]", "qoeflow-ckpt-"), (CLUSTER, "/warehouse/_qoeflow")])
def test_unset_folder(tmp_path, master, place):
    """Spark 4 refuses to set ``spark.checkpoint.dir`` in a running session; a
    cluster's warehouse is shared."""
    conf = tmp_path / "conf"
    conf.mkdir()                                              # no spark-defaults.conf
    p = subprocess.run([sys.executable, "-c", UNSET.format(root=ROOT, master=master)], cwd=tmp_path,
                       env={**os.environ, "SPARK_CONF_DIR": str(conf)}, capture_output=True, text=True, timeout=300)
    assert "ROWS 5 5 5" in p.stdout, p.stderr[-2000:]
    assert "DIR True" in p.stdout and place in p.stdout


def on_cluster(spark, monkeypatch, folder):
    """The session says it has a cluster's master and ``folder`` as ``spark.checkpoint.dir``."""
    get = type(spark.conf).get
    monkeypatch.setattr(spark.sparkContext, "master", CLUSTER)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: (
        folder if key == "spark.checkpoint.dir" else get(self, key, *default)))


@pytest.mark.parametrize("scheme", ["file:", "file://", ""])
def test_shared_mount_on_a_cluster(spark, monkeypatch, tmp_path, scheme):
    """A folder of the local file system that all see is used, whatever its name."""
    folder = f"{scheme}{tmp_path}"
    on_cluster(spark, monkeypatch, folder)
    assert session.shared_dir(spark) == folder
    assert session.scratch_path(spark, "x").startswith(f"{folder}/qoeflow/x-")
    df = spark.range(5)
    assert session.write_once(df, "x").count() == 5
    assert materialise(df, "y").count() == 5
    tried = [x for x in os.listdir(tmp_path / "qoeflow") if x.startswith("seen-")]
    assert len(tried) == 1                                    # once a session


def test_folder_of_one_machine_is_an_error(spark, monkeypatch, tmp_path):
    """Rows that other machines wrote are not there: an error, not a smaller table."""
    on_cluster(spark, monkeypatch, f"file://{tmp_path}")
    frame = type(spark.range(1))
    whole = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: whole(df.limit(1))))     # what one of the machines wrote
    with pytest.raises(RuntimeError, match="one machine"):
        session.write_once(spark.range(5), "x")
