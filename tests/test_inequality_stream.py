from datetime import datetime, timedelta

from tidemark.plans import streams


def test_inequality_join_keeps_a_row_of_state_for_an_orders_lines(spark, monkeypatch, tmp_path):
    """Lines without key, order or date, and dates on the very bound; a batch's lines of an order are one row of state."""
    day = lambda n: datetime(2020, 1, 1) + timedelta(days=n)
    orders = [(1, day(0)), (2, day(5)), (3, None), (4, day(0)), (None, day(0))]
    rows = [(1, 1, day(60)), (1, 2, day(61)), (1, 3, day(60) + timedelta(microseconds=1)), (1, 4, None), (2, 1, day(66)), (2, 1, day(66)), (3, 1, day(90)), (9, 1, day(90)), (None, 1, day(90))]
    rows += [(4, n, day(n)) for n in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    put = []

    def ran(df):
        q = df.writeStream.format("memory").queryName("inequality").trigger(availableNow=True).start()
        q.awaitTermination()
        put.extend(op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"])
        return spark.table("inequality")

    monkeypatch.setattr(streams, "finish", ran)
    got = sorted(tuple(r) for r in streams.x_inequality_stream(spark, str(tmp_path)).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (2, 1)]
    assert sum(put) <= len(orders) + len({k for k, _, _ in rows})
