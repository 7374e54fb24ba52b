"""Observed edges from telemetry payloads: service maps, spans, logs, browser events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.urls import first_label, host_of

MOST_ROWS = 1000
_EDGE = "from_service string, to_service string, env string, capability string"


def capabilities(bodies: DataFrame) -> DataFrame:
    """``env, apm, logs, traces, rum``; without a payload an environment has none."""
    c = F.from_json("body", "struct<apm:boolean,logs:boolean,traces:boolean,rum:boolean>")
    return bodies.select("env", *[F.coalesce(c.getField(n), F.lit(False)).alias(n) for n in ("apm", "logs", "traces", "rum")])


def _data(bodies: DataFrame, row: str, most: int) -> DataFrame:
    """Rows of a payload in file order, cut at ``most``, with ``truncated``."""
    data = F.from_json("body", f"struct<data:array<{row}>>").getField("data")
    return bodies.select("env", (F.size(data) > most).alias("truncated"), F.explode(F.slice(data, 1, most)).alias("d"))


def _edges(rows: DataFrame, capability: str, to) -> DataFrame:  # noqa: ANN001
    out = rows.select(F.col("d.attributes.service").alias("from_service"), to.alias("to_service"), "env", F.lit(capability).alias("capability"), "truncated")
    return out.filter((F.coalesce("from_service", F.lit("")) != "") & (F.coalesce("to_service", F.lit("")) != ""))


def _filled(c):  # noqa: ANN001, ANN202
    return F.nullif(F.trim(c), F.lit(""))


def service_map(bodies: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Service maps; edges of another environment than the payload's are left out."""
    rows = _data(bodies, "struct<from_service:string,to_service:string,env:string>", most)
    rows = rows.filter(F.col("d.env").isNull() | (F.col("d.env") == F.col("env")))
    return rows.select("d.from_service", "d.to_service", "env", F.lit("apm").alias("capability"), "truncated")


def span_edges(bodies: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Client spans; the callee is the peer service, else the host called."""
    rows = _data(bodies, "struct<attributes:struct<service:string,span_kind:string,peer_service:string,out_host:string,env:string>>", most)
    a = "d.attributes."
    return _edges(rows.filter(F.col(a + "span_kind") == "client"), "traces", F.coalesce(_filled(F.col(a + "peer_service")), _filled(F.col(a + "out_host"))))


def log_edges(bodies: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Log events; inner keys hold dots, so they are read as a map."""
    rows = _data(bodies, "struct<attributes:struct<service:string,attributes:map<string,string>,message:string,timestamp:string>>", most)
    get = lambda k: F.try_element_at(F.col("d.attributes.attributes"), F.lit(k))
    return _edges(rows, "logs", F.coalesce(_filled(get("peer.service")), first_label(host_of(get("http.url"))), _filled(get("out.host"))))


def browser_edges(bodies: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    rows = _data(bodies, "struct<attributes:struct<service:string,resource:struct<url:string>,type:string>>", most)
    return _edges(rows, "rum", first_label(host_of(F.col("d.attributes.resource.url"))))


def sampled(edges: DataFrame) -> DataFrame:
    """Equal observations counted: adds ``sample_count``."""
    return edges.groupBy("from_service", "to_service", "env", "capability").agg(F.count(F.lit(1)).alias("sample_count"))


def no_edges(spark: SparkSession) -> DataFrame:
    """A source without a service catalogue or deploy events."""
    return spark.createDataFrame([], _EDGE)
