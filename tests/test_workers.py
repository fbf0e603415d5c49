"""Python workers must find the package wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from popweave.session import local_session
spark = local_session(2)
print("ROWS", __spark_entry__.queries()["ring_overlay"](spark, "/root/testdata/sf0.001").count())
"""


def test_overlay_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    import os

    env |= {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "SPARK", "PYSPARK")) or k in ("PATH",)}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS" in done.stdout, done.stderr[-2000:]
