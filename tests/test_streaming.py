import os
import tempfile

from sitelake.operators.extract import selectors_frame
from sitelake.streaming.pages_stream import stream_fields


def test_stream_fields_available_now(spark):
    root = tempfile.mkdtemp(prefix="sitelake-stream-")
    landing, sink = os.path.join(root, "landing"), os.path.join(root, "sink")
    spark.createDataFrame([(1, "http://a.com/1", "<h1>A</h1>"), (2, "http://b.com/2", "<h1>B</h1><p>x</p>")],
                          "page_id long, url string, html string").write.parquet(landing)
    q = stream_fields(spark, landing, selectors_frame(spark, {"title": "h1", "para": "p"}), sink,
                      checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    rows = sorted((r.page_id, r.title, r.para, r.url) for r in spark.read.parquet(sink).collect())
    assert rows == [(1, "A", "", "http://a.com/1"), (2, "B", "x", "http://b.com/2")]
