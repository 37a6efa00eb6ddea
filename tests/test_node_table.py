from pyspark.sql import functions as F

from sitelake.operators.shred import shred
from sitelake.sources.nodes import load_node_table, save_node_table


def test_bucketed_node_table_joins_without_shuffle(spark, pages_df):
    pages = pages_df([(f"http://a.com/{i}", f"<div><p>{i}</p><a href='/x{i}'>x</a></div>") for i in range(20)])
    save_node_table(shred(pages, persist=False), "nodes_test", buckets=4)
    n = load_node_table(spark, "nodes_test")
    els = n.filter(F.col("kind") == "element").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_el"))
    docs = n.filter(F.col("kind") == "document").select("page_id", "url")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = docs.join(els, "page_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 20 and all(r.n_el == 3 for r in j.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan, plan
