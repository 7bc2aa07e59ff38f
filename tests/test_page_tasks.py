"""Tasks of the page job follow the bytes of HTML; few selectors don't move elements."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.operators import tokens
from pagemill.operators.selectors import match_selectors
from pagemill.operators.tokens import by_page, html_tokens, token_attrs
from pagemill.plans.corpus import convert_content
from pagemill.plans.refresh import missing_pages
from pagemill.streaming.jobs import due_pages

PAGES = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    html = "<html><body><main>" + "<p class='a b'>Some words of a page</p>" * 30 + "</main></body></html>"
    return spark.createDataFrame([(i, f"https://example.com/{i}", None if i == 7 else html) for i in range(40)], PAGES)


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df, key):
    """Partitions of the exchanges by `key` that were asked for by number."""
    return [int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(df))]


def test_tasks_follow_the_bytes_of_html(spark, pages, monkeypatch):
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    for tasks in (20, 60):
        monkeypatch.setattr(tokens, "TASK_BYTES", -(-size // tasks))
        assert dealt(by_page(pages), "page_id") == [tasks]
    assert dealt(by_page(pages, partitions=5), "page_id") == [5]
    assert len(dealt(by_page(spark.createDataFrame([], PAGES)), "page_id")) == 1


def test_tasks_do_not_follow_a_join_before(pages, sorted_joins):
    live = pages.limit(0).select(F.lit("none").alias("cache_key"))
    assert dealt(by_page(missing_pages(pages, live, Settings())), "page_id")
    due = due_pages(pages.withColumn("captured_at", F.lit("2024-01-10").cast("timestamp")), None, Settings())
    assert dealt(due, "cache_key")


def test_contents_are_dealt_as_told(pages):
    contents = pages.select("page_id", "html", *(F.lit("").alias(c) for c in ("title", "canonical_url", "description")))
    assert dealt(convert_content(contents, Settings(), 33), "page_id") == [33]


def test_few_selectors_do_not_move_elements(spark, pages):
    rows = token_attrs(html_tokens(pages, co_located=True)).where("attrs is not null")
    got = match_selectors(rows, [".a", "p", ".missing"])
    assert "SortMergeJoin" not in plan(got) and "hashpartitioning" not in plan(got)
    assert got.groupBy("rank").count().orderBy("rank").collect() == [(0, 39 * 30), (1, 39 * 30)]
