"""The streaming memories give what a batch over all rows gives, also when rows come in several runs."""

import pytest
from pyspark.sql import functions as F

from quillrank.operators import store
from quillrank.streaming import memories

SCHEMA = "url string, vote int, query string, intent string, ts timestamp, score double"


def rows(part):
    return [(f"u{i % 5}", 1 if i % 3 else -1, ["A b", "a B ", "c"][i % 3], f"i{i}", i + 100 * part, i / 10) for i in range(40)]


@pytest.fixture
def landed(spark, tmp_path):
    def land(part):
        df = spark.createDataFrame(rows(part), "url string, vote int, query string, intent string, at long, score double")
        df.select("url", "vote", "query", "intent", F.timestamp_seconds("at").alias("ts"), "score").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

    return land


BUILD = {
    "votes": memories.vote_sums,
    "means": lambda df: memories.domain_means(df, "url", "score", "ts"),
    "log": memories.query_log,
}


@pytest.mark.parametrize("name", BUILD)
def test_streams_equal_batches(spark, tmp_path, landed, name):
    where = str(tmp_path / "in")
    for part in range(2):  # the second run goes on from the first one's state
        landed(part)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(where)
        memories.run_available(BUILD[name](stream), str(tmp_path / "out"))
    got = memories.latest_state(spark, str(tmp_path / "out"))
    want = BUILD[name](spark.read.schema(SCHEMA).parquet(where))
    order = [c for c in want.columns if c != "total"]
    plain = lambda df: sorted((tuple(r[c] for c in order), round(r["total"], 9) if "total" in r else 0) for r in df.collect())
    assert plain(got) == plain(want)


def test_log_equals_the_store(spark, tmp_path, landed):
    landed(0)
    log = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    batch = {r["query_hash"]: (r["query"], r["intent"], r["search_count"]) for r in store.query_memory(log).collect()}
    assert {r["key"]: (r["query"], r["intent"], r["n"]) for r in memories.query_log(log).collect()} == batch
