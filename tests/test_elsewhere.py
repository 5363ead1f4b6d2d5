"""Jobs must run when the workers cannot import the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from shardflow.session import local_session
spark = local_session(4, "elsewhere", **{{"spark.checkpoint.dir": {scratch!r}}})
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""
# The queries with Python on the workers.
NAMES = (
    "copy_images decode_images read_tar_shards write_tar_labelled write_columns tolerant_map udf_map udaf_collate "
    "shard_bytes to_tensor resize_tensor tensor_then_resize stream_callback"
).split()


def test_queries_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=repo, scratch=str(tmp_path / "scratch"), names=NAMES)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert set(counts) == set(NAMES) and all(int(n) > 0 for n in counts.values())
