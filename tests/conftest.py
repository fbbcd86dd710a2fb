import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="wordloom-test-ckpt-", dir="/tmp")
    s = (SparkSession.builder.master("local[*]").appName("wordloom-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.checkpoint.dir", ckpt)
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="wordloom-test-", dir="/tmp")


SUMMARIES = {  # four blocks: url, sentences with labels, highlights, entities
    "a.summary": "http://news.example.com/a\n\n"
                 "@entity0 said the @entity1 opened on Monday .\t\t\t1\nIt was n't raining\t\t\t0\n\n"
                 "the *bridge* opened\ncrowds came\n\n@entity0:Mayor Ann Lee\n@entity1:Long Bridge",
    "b.summary": "http://news.example.com/b\n\nTwo boats , 3 crews .\t\t\t2\n\nboats raced\n\n@entity2:Port",
}


@pytest.fixture()
def summaries(tmpdir_path):
    folder = os.path.join(tmpdir_path, "summaries")
    os.makedirs(folder)
    for name, text in SUMMARIES.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return folder


def tiny_docs(spark):
    """F8: d0 'cat dog cat', d1 'dog fish', d2 'cat bird bird dog', d3 'fish'."""
    return spark.createDataFrame(
        [(0, "cat dog cat"), (1, "dog fish"), (2, "cat bird bird dog"), (3, "fish")],
        "doc_id long, text string")
