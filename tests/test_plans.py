"""What the plans must look like to hold at scale."""

from pyspark.sql import functions as F

from pagelake.operators import actions as A
from pagelake.operators import cache as C
from pagelake.operators import html as H
from pagelake.plans import derived as D
from pagelake.plans import extract as X
from pagelake.sources import tables as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(text, exchanges):
    assert text.count("Exchange hashpartitioning") == exchanges, text
    assert "Cartesian" not in text and "NestedLoop" not in text and "PythonUDF" not in text and "EvalPython" not in text


def test_actions_take_one_exchange(spark, sf):
    text = plan(A.top_actions(D.pages(spark, sf)))
    check(text, 1)
    assert "WindowGroupLimit" in text


def test_markdown_and_actions_take_one_exchange(spark, sf):
    check(plan(X.extract(D.pages(spark, sf).withColumn("base", F.col("url")), ["url"], with_template=True)), 1)


def test_responses_take_one_exchange_per_snapshot(spark, sf):
    """Static and rendered pages are exchanged once each; the join reuses both."""
    r = D.renders(spark, sf)
    text = plan(X.responses(D.fetches(spark, sf), S.table(spark, sf, "pages").select(
        "page_id", "url", F.col("url").alias("final_url"), "html", F.lit(1.0).alias("elapsed_ms"))))
    check(text, 2)
    assert r.count() > 0


def test_rendered_pages_of_many_are_extracted_in_a_stage_of_their_own(spark, sf, monkeypatch):
    """One task held the sorts of both extractions, twice the memory of either."""
    few = D.fetches(spark, sf).where("page_id < 60")

    def answers(fetches):
        return X.responses(fetches, S.table(spark, sf, "pages").select(
            "page_id", "url", F.col("url").alias("final_url"), "html", F.lit(1.0).alias("elapsed_ms")))

    seen = lambda: sorted(answers(few).select("page_id", "markdown", F.to_json("actions"), "meta.extraction_path", F.to_json("error")).collect())
    small = seen()
    monkeypatch.setattr(H, "page_partitions", lambda pages, *size: 2 * spark.sparkContext.defaultParallelism)
    check(plan(answers(D.fetches(spark, sf))), 3)
    assert seen() == small and {r.extraction_path for r in small} == {"static", "render"}


def test_bucketed_pages_need_no_exchange(spark, sf):
    p = S.bucket_pages(D.pages(spark, sf), "pages_bucketed_test", 8)
    try:
        check(plan(H.nodes(p, partitions=0)), 0)
        a = H.nodes(p, partitions=0).groupBy("kind", "side").count().collect()
        b = H.nodes(D.pages(spark, sf)).groupBy("kind", "side").count().collect()
        assert sorted(a) == sorted(b)
    finally:
        spark.sql("DROP TABLE pages_bucketed_test")


def test_only_needed_columns_are_read(spark, sf):
    text = plan(H.tokens(D.pages(spark, sf)).groupBy("kind").count())
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_counts_are_combined_before_the_exchange(spark, sf):
    text = plan(C.rate_flags(D.requests(spark, sf), 3))
    assert text.count("HashAggregate") == 2 and text.index("partial_count") > text.index("Exchange")
