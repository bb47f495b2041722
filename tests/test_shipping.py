"""The package reaches the Python workers when the program starts elsewhere."""

import subprocess
import sys
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import sys
sys.path.insert(0, {zip!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", {folder!r}).getOrCreate())
spark.sparkContext.addPyFile({zip!r})
from panelfx.operators import regress
df = spark.range(200).selectExpr(*[f"double(hash(id, {{k}}) % 97) as x{{k}}" for k in range(10)], "double(hash(id, 77) % 50) as y")
print("rank", regress.ols(df, "y", [f"x{{k}}" for k in range(10)]).rank)
"""


def test_zipped_package_from_another_folder(tmp_path):
    path = tmp_path / "panelfx.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (ROOT / "panelfx").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    import os
    env |= {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "LD_LIBRARY_PATH")}
    done = subprocess.run([sys.executable, "-c", CODE.format(zip=str(path), folder=str(tmp_path / "wh"))], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=240)
    assert "rank 11" in done.stdout, done.stderr[-2000:]
