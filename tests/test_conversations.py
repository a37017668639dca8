import random

import pytest

from voc.operators.dashboard import last_messages
from voc.streaming.conversations import STORE, last_messages_stream, latest

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture
def state_store(spark):
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.shuffle.partitions": "2",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def messages(n=260, seed=0):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, "", f"text {c} {t}"])) for c in range(25) for t in range(rng.randint(1, 18))]
    rng.shuffle(rows)     # turns come out of order
    return rows


@pytest.mark.parametrize("splits,k", [([40], 5), ([3, 90, 150], 5), ([120], 1)])
def test_any_split_equals_the_batch_also_after_a_restart(spark, tmp_path, state_store, splits, k):
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = messages()
    for low, high in zip([0, *splits], [*splits, len(rows)]):
        extra = [(None, 1, "user", "x"), (1, None, "user", "y")]
        spark.createDataFrame(rows[low:high] + extra, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = last_messages_stream(spark.readStream.schema(SCHEMA).parquet(source), k)
        # each start goes on from the checkpoint
        query = (
            stream.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("append").parquet(sink)).start()
        )
        query.awaitTermination()
    got = latest(spark.read.parquet(sink)).select("conv_id", "turn", "role", "text", "back")
    want = last_messages(spark.createDataFrame(rows, SCHEMA), k).select("conv_id", "turn", "role", "text", "back")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
