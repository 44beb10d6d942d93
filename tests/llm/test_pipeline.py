import os
import random
import subprocess
import sys

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as components


def documents(spark):
    rng = random.Random(9)
    words = {"en": "the of and that with this from have were their which would there about".split(),
             "de": "der die und nicht auch sich mit eine für über zwischen wäre schließlich".split()}
    def text(lang, n):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(20, 120)), lang, f"s{k % 3}", 0) for k in range(120) for lang in (rng.choice(["en", "de"]),)]
    item = "z" + " z".join(text("en", 30).split())
    rows += [(200 + k, rows[k][1], *rows[k][2:]) for k in range(5)] + [(5, rows[5][1], *rows[5][2:])]
    rows += [(300, text("en", 50) + " " + item, "en", None, 0), (400, "12 34 -- 56", "en", "s1", 0), (401, None, "en", "s1", 0), (402, "", None, "s1", 0)]
    return rows, item, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_plain_versions(spark, tmp_path):
    rows, item, df = documents(spark)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append(sorted(r.doc_id for r in docs.collect()))
        if number < 4:
            assert docs.columns == df.columns
    known = [r for r in rows if r[0] < 400]
    assert kept[0] == sorted(r[0] for r in known)
    first = {c for _, _, c in components([r[:2] for r in known])}
    assert kept[1] == sorted(first) and not set(range(200, 205)) & first
    assert kept[2] == sorted(first - {300}) == kept[3] == kept[4]
    assert sorted(docs.columns) == sorted(["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def test_empty_table(spark, tmp_path):
    _, item, df = documents(spark)
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_and_empty_parts(spark, tmp_path):
    """Columns named like those that the stages make stay as they are."""
    rows, item, df = documents(spark)
    clash = df.selectExpr("*", "doc_id AS _leak", "'a' AS row", "1 AS slot", "2 AS block", "'k' AS _kept", "3 AS _rows", "4 AS place")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.columns == clash.columns
    assert docs.where("NOT doc_id <=> _leak").count() == 0 and 0 < docs.count() < len(rows)


WORKERS = """
import sys
import psutil
from tidewatch.session import build_session
import corpus_pipeline
spark = build_session("workers", cores=2)
corpus_pipeline.run(spark, sys.argv[1]).collect()
jvm = [p for p in psutil.Process().children(recursive=True) if "java" in p.name()]
print("daemons", sum("pyspark.daemon" in " ".join(c.cmdline()) for p in jvm for c in p.children()))
"""


def test_one_pool_of_python_workers(spark, tmp_path):
    """No stage makes Python rows on the driver, which would start a second pool of workers beside that of the Arrow tasks."""
    pytest.importorskip("psutil")
    _, item, df = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    done = subprocess.run([sys.executable, "-c", WORKERS, str(tmp_path)], capture_output=True, text=True, timeout=600, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert "daemons 1" in done.stdout, done.stderr[-2000:]
