"""Sources and sinks: page snapshots, requests, fixtures, stored results, responses, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import urls

FETCHES = (
    "page_id bigint, url string, final_url string, html string, status_code int, elapsed_ms double, "
    "headers map<string,string>, transport string, timeout_ms int"
)
PARAM = "struct<type:string,label:string,required:boolean,options:array<string>>"
RESPONSE = (
    "markdown string, actions array<struct<type:string,label:string,target:string,method:string,"
    f"parameters:map<string,{PARAM}>,description:string>>, "
    "meta struct<url:string,final_url:string,fetched_at:timestamp,extraction_path:string,strategy:string,"
    "truncated:boolean,cached:boolean,cached_at:timestamp,tokens:map<string,int>,timings_ms:map<string,double>>, "
    "error struct<code:string,message:string,recoverable:boolean>"
)
EXPECTATIONS = (
    "struct<expect_no_error:boolean,"
    "markdown:struct<min_tokens:int,must_contain:array<string>,must_not_contain:array<string>,has_code_fence:boolean>,"
    "meta:struct<strategy:string>,"
    "actions:struct<min_count:int,max_count:int,must_include_names:array<string>,"
    "must_not_include_names:array<string>,must_include_effect:string>>"
)
FIXTURE = (
    f"id string, name string, url string, snapshot string, render string, actions string, e2e boolean, expectations {EXPECTATIONS}"
)
RESULT = (
    "run_at string, total int, passed int, failed int, skipped int, results array<struct<id:string,name:string,"
    "url:string,category:string,status:string,skipped_reason:string,extraction_path:string,action_count:int,"
    "markdown_length:int,failures:array<string>,snapshot:string,title:string,error:string>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given parquet table; timestamps without zone are read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def bucket_pages(pages: DataFrame, name: str, buckets: int) -> DataFrame:
    """Store pages as a table bucketed by page, so that later extractions need no exchange."""
    pages.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(name)
    return pages.sparkSession.table(name)


def load_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Logged fetches with their snapshots; a missing status means 200."""
    df = spark.read.schema(FETCHES).parquet(path)
    return df.withColumns(
        {
            "status_code": F.coalesce("status_code", F.lit(200)),
            "final_url": F.coalesce("final_url", "url"),
            "timeout_ms": F.coalesce("timeout_ms", F.lit(30000)),
        }
    )


def request_problems() -> Column:
    """Reasons a request is refused; empty for a valid one."""
    ttl, wait = F.col("cache_ttl"), F.col("timeout_ms")
    checks = [
        ("url", ~F.coalesce(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))),
        ("render", ~F.col("render").isin("auto", "always", "never")),
        ("actions", ~F.col("actions").isin("none", "fast", "verified")),
        ("max_tokens", F.coalesce(F.col("max_tokens") < 100, F.lit(False))),
        ("cache_ttl", ttl < 0),
        ("timeout_ms", ~wait.between(1000, 60000)),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda r: r.isNotNull())


REQUEST_DEFAULTS = {
    "render": "auto", "actions": "fast", "include_actions": True, "use_cache": True, "cache_ttl": 3600, "timeout_ms": 30000,
}


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with defaults filled in and their array of ``problems``."""
    for name, value in REQUEST_DEFAULTS.items():
        have = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(have, F.lit(value)))
    for name, kind in (("max_tokens", "int"), ("selector_hint", "string"), ("js_wait_selector", "string")):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests.withColumn("problems", request_problems())


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejects with their reasons."""
    r = checked_requests(requests)
    return r.where(F.size("problems") == 0).drop("problems"), r.where(F.size("problems") > 0)


def with_fixture_defaults(fixtures: DataFrame, render: str = "auto", actions: str = "fast") -> DataFrame:
    """Fixtures as requests: defaults merged, cache off, a longer limit when a page must be rendered."""
    f = fixtures.withColumns(
        {"render": F.coalesce("render", F.lit(render)), "actions": F.coalesce("actions", F.lit(actions))}
    )
    return f.withColumns(
        {
            "include_actions": F.col("actions") != "none",
            "use_cache": F.lit(False),
            "timeout_ms": F.when(F.col("render") == "always", 45000).otherwise(30000),
        }
    )


def load_fixtures(spark: SparkSession, path: str, render: str = "auto", actions: str = "fast") -> DataFrame:
    return with_fixture_defaults(spark.read.schema(FIXTURE).json(path), render, actions)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a stored corpus run, one row per fixture."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).select("run_at", F.inline("results"))


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses; ``id`` is the file name without its ending."""
    df = spark.read.schema(RESPONSE).option("multiLine", True).json(path)
    return df.withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def response_json(responses: DataFrame, *keep: str) -> DataFrame:
    """One JSON text per response; null fields are written out."""
    parts = [c for c in ("markdown", "actions", "meta", "error") if c in responses.columns]
    return responses.select("page_id", *keep, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def write_responses(responses: DataFrame, path: str, fmt: str = "parquet", spread: int = 32) -> None:
    """Write responses as parquet or as JSON texts, one folder per host.

    Rows go to (host, page bucket) writers, so a host with a third of all pages is written by
    ``spread`` tasks and small hosts make few files.
    """
    out = responses.withColumn("host", urls.netloc(F.col("meta.url"))).repartition(
        "host", F.pmod(F.xxhash64("page_id"), F.lit(spread))
    )
    if fmt == "json":
        out = response_json(out, "host").select("host", F.col("json").alias("value"))
        out.write.mode("overwrite").partitionBy("host").text(path)
    else:
        out.write.mode("overwrite").partitionBy("host").parquet(path)


def history_rows(responses: DataFrame, created_at: Column, options_hash: Column) -> DataFrame:
    """Rows of the immutable extraction history; a page extracted again gets a new row."""
    ident = F.concat_ws("|", "meta.url", options_hash, created_at.cast("string"))
    return responses.select(
        F.concat(F.lit("ext_"), F.left(F.sha2(ident, 256), F.lit(16))).alias("id"),
        F.col("meta.url").alias("url"),
        F.col("meta.final_url").alias("final_url"),
        options_hash.alias("options_hash"),
        "markdown",
        F.to_json("meta", {"ignoreNullFields": "false"}).alias("meta_json"),
        F.col("meta.strategy").alias("strategy"),
        created_at.alias("created_at"),
        F.to_date(created_at).alias("created_on"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("created_on").parquet(path)
