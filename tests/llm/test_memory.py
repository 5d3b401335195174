import os
import subprocess
import sys
from pathlib import Path

import pyspark

EXECUTOR = """
import os, re, time, psutil
from pyspark.sql import SparkSession
import corpus_pipeline

settings = {"spark.master": "local-cluster[1,2,1500]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "shared", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=settings).getOrCreate()


def used():
    own = [p for p in psutil.process_iter() if "CoarseGrainedExecutorBackend" in (line := " ".join(p.cmdline())) and f":{spark.conf.get('spark.driver.port')} " in line]
    return sum(int(x) for p in own for x in re.findall(r"\\nPss_Anon:\\s+(\\d+)", open(f"/proc/{p.pid}/smaps_rollup").read())) / 1024


for _ in range(2):
    spark.range(0, 1_500_000, 1, 4).selectExpr("repeat(cast(id as string), 20) as text").repartition(4, "text").sortWithinPartitions("text").write.format("noop").mode("overwrite").save()
before = used()
docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
stages = dict(corpus_pipeline.STAGES)
stages["BPE encoding and decoding"](spark, docs, "")
time.sleep(1)
print("MB", before, used())
os._exit(0)
"""


def test_executors_give_heap_back(tmp_path):
    """What the jobs before a stage left in an executor's heap goes back to the system when the stage begins."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"PYTHONPATH": os.getcwd(), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", EXECUTOR], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    said = [x for x in run.stdout.splitlines() if x.startswith("MB ")]
    assert said, run.stderr[-2000:]
    before, after = map(float, said[0].split()[1:])
    assert after < 0.7 * before, (before, after)
