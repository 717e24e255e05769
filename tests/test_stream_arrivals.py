"""Documents that arrive after the start count, rows behind the watermark do not."""

from datetime import datetime

import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq

from scriptorium.sources.fixture import read_table
from scriptorium.streaming import arrivals as SA
from scriptorium.streaming import streams as ST

from tables import SF_SMALL


def test_errors_in_the_row_equal_the_line_table(spark):
    errors, chars = SA.text_errors("text")
    rows = {r["doc_id"]: (r["e"], r["c"]) for r in read_table(spark, SF_SMALL, "documents").select("doc_id", errors.alias("e"), chars.alias("c")).collect()}
    for r in ST.document_errors(spark, SF_SMALL).collect():
        assert rows.pop(r["page_id"]) == (r["errors"], r["chars"])
    assert set(rows.values()) <= {(0, 0)}


def test_moving_documents_late_rows_and_restart(spark, tmp_path):
    folder, out = tmp_path / "tables", str(tmp_path / "out")
    folder.mkdir()
    documents, events = pq.read_table(f"{SF_SMALL}/documents.parquet"), pq.read_table(f"{SF_SMALL}/events.parquet")

    def put_documents(name, *ids):
        pq.write_table(documents.filter(pa.compute.is_in(documents["doc_id"], pa.array(ids, pa.int64()))), folder / name)

    def put_events(name, *rows):
        t = events.slice(0, len(rows))
        for column, values in (("user_id", [r[0] for r in rows]), ("ts", [datetime.fromisoformat(r[1]) for r in rows])):
            field = t.schema.field(column)
            t = t.set_column(t.schema.get_field_index(column), field, pa.array(values).cast(field.type))
        pq.write_table(t, folder / name)

    def counts():
        totals = SA.window_totals(spark, SA.stream_arrivals_cer(spark, str(folder), out)).collect()
        return {r["window_start"][:10]: r["events"] for r in totals}

    put_documents("documents.parquet", 2, 3)                       # of January 3 and 4
    put_events("events.parquet", (2, "2024-01-04 10:00:00"), (3, "2024-01-03 10:00:00"),   # the second is before its document
               (5, "2024-01-08 10:00:00"), (2, "2024-01-10 00:00:00"))                      # a document to come; a day too late
    assert counts() == {"2024-01-04": 1}
    # The watermark is at January 3, 23:00, an hour behind the documents.
    put_documents("documents-2.parquet", 5)
    put_events("events-2.parquet", (3, "2024-01-05 09:00:00"), (2, "2024-01-03 12:00:00"))  # the second is behind it
    assert counts() == {"2024-01-04": 1, "2024-01-05": 1, "2024-01-08": 1}
    assert counts() == {"2024-01-04": 1, "2024-01-05": 1, "2024-01-08": 1}


def test_documents_without_text(spark):
    errors, chars = SA.text_errors("text")
    rows = spark.createDataFrame([(None,), ("",), ("um um",)], "text string").select(errors.alias("e"), chars.alias("c")).collect()
    assert [tuple(r) for r in rows[:2]] == [(0, 0), (0, 0)] and rows[2]["c"] == 5
