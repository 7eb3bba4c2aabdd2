import os

import pytest

from tidemark.sources.rolling import RollingSource
from tidemark.streaming.run import shared_folder


def parts(path):
    return {f: open(f"{path}/{f}").read().splitlines() for f in sorted(os.listdir(path)) if not f.startswith((".", "_"))}


def test_parts_roll_by_rows_and_bytes(spark, tmp_path):
    spark.dataSource.register(RollingSource)
    rows = spark.range(25, numPartitions=2).selectExpr("lpad(id, 4, '0') AS value")
    path = str(tmp_path / "rows")
    rows.write.format("rolling").options(path=path, prefix="log", suffix=".txt", maxrows=5).mode("append").save()
    found = parts(path)
    assert all(f.startswith("log-") and f.endswith(".txt") for f in found) and [len(x) for x in found.values()] == [5, 5, 2, 5, 5, 3]
    assert sorted(sum(found.values(), [])) == [f"{i:04}" for i in range(25)] and os.listdir(f"{path}/_pending") == []
    rows.limit(3).write.format("rolling").options(path=path).mode("append").save()
    assert len(parts(path)) == 7
    rows.write.format("rolling").options(path=path, maxbytes=20).mode("overwrite").save()
    assert [len(x) for x in parts(path).values()] == [4, 4, 4, 4, 4, 4, 1]
    with pytest.raises(Exception, match="one text column"):
        spark.range(3).write.format("rolling").options(path=path).mode("append").save()


def test_a_batch_that_runs_again_leaves_the_same_files(spark, tmp_path):
    spark.dataSource.register(RollingSource)
    base, path = shared_folder(spark), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("value string").parquet(f"{base}/in")
        stream.writeStream.format("rolling").options(path=path, maxrows=4, suffix=".txt").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    for n in (10, 6):
        spark.range(n).coalesce(1).selectExpr("concat('r', id) AS value").write.mode("append").parquet(f"{base}/in")
        run()
    first = parts(path)
    assert [len(x) for x in first.values()] == [4, 4, 2, 4, 2] and all(f.startswith("part-00000") for f in first)
    local = base.removeprefix("file:")
    os.remove(f"{local}/state/commits/1")  # as if the query had died before it noted the second batch
    if os.path.exists(f"{local}/state/commits/.1.crc"):
        os.remove(f"{local}/state/commits/.1.crc")
    run()
    assert parts(path) == first and os.listdir(f"{path}/_pending") == []
