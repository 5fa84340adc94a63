import datetime as dt

from ledgerloom.schema import RECORD
from ledgerloom.streaming import ingest


def test_stream_drops_repeats_and_matches(spark, tmp_path):
    day = dt.date(2026, 3, 14)
    rows = [(1, "Jumbo", -850, "EUR", day, None, None, True, 1), (1, "JUMBO *", -850, "EUR", day, None, None, True, 1), (1, "Jumbo", -851, "EUR", day, None, None, False, 2)]
    spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(str(tmp_path / "in"))
    records = ingest.stream_of_records(spark, str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    assert run(ingest.new_records(records), "fresh").count() == 2
    again = ingest.stream_of_records(spark, str(tmp_path / "in"))
    assert run(ingest.pending_matches(records.where("pending"), again.where("not pending")), "matched").count() == 2
