"""Operators whose Python runs on executors that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {home!r})                       # the driver alone
import public_tokenizers as P
from pyspark.sql import functions as F
from newsops.session import local_session
from newsops.llm import bpe, fingerprint, langid, linededup, manifest, mixing, neardup, quality, resample, wrappers

spark = local_session("2", 2)
def missing(x):
    try:
        import newsops
    except ImportError:
        return True
    return False
assert all(spark.sparkContext.parallelize([1, 2], 2).map(missing).collect()), "the workers can import the package"
rows = [(i, "one two three four five six seven eight nine " * (i + 1) + "été", "en" if i % 2 else "fr", "s", 9) for i in range(12)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.example.com/"), "doc_id").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"))
for frame in (
    bpe.digest(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), fingerprint.edited_fingerprints(docs), langid.identify(docs),
    linededup.drop_lines(docs), mixing.mix(docs), neardup.drop_near_duplicates(docs), quality.verdicts(quality.figures(docs)),
    resample.resample(docs, docs), manifest.verified(manifest.manifest(docs)), wrappers.extract(pages),
):
    frame.collect()
print("all ran")
"""


def test_workers_need_not_have_the_package(tmp_path):
    home = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != Path(home)]
    if path:
        env["PYTHONPATH"] = os.pathsep.join(path)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(home=home)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
