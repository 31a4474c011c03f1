"""Writers: kept spans, id lists, JSON lines, tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def kept_spans(spans: DataFrame, kept: DataFrame, path: str, rank: bool = False) -> tuple[int, int]:
    """Write the spans of the kept traces as CSV; spans there were and spans kept, counted as they pass. With rank, kept has
    a place."""
    seen, written = Observation("seen"), Observation("written")
    one = F.count(F.lit(1)).alias("n")
    out = spans.observe(seen, one).join(kept.select("trace_id", *(["place"] if rank else [])).distinct(), "trace_id", "inner" if rank else "left_semi")
    if rank:  # the range shuffle samples its input, so the order is made before the rows are counted
        out = out.repartitionByRange("place").sortWithinPartitions("place", "start_ns")
    out.observe(written, one).write.mode("overwrite").csv(path, header=True)
    return (spans.count() if rank else seen.get["n"]), written.get["n"]


def trace_csv(spans: DataFrame, path: str) -> None:
    """Spans as a table of traces: first start, duration, span count, whether any failed, services in order joined by |."""
    rows = spans.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), ((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("duration_ms"), F.count("*").alias("span_count"), F.max(F.col("failed").cast("int")).alias("has_error"), F.array_join(F.array_sort(F.collect_set("service")), "|").alias("services"))
    rows.write.mode("overwrite").csv(path, header=True)


def report(tables: dict[str, DataFrame], path: str, title: str) -> None:
    """Several small results as one markdown text, written through Spark."""
    text = f"# {title}\n\n" + "\n".join(markdown(rows, name) for name, rows in tables.items())
    next(iter(tables.values())).sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def id_list(kept: DataFrame, path: str) -> None:
    """Ids in order, one on a line; sorted over partitions, so the files in name order are the list."""
    kept.select("trace_id").distinct().orderBy("trace_id").write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def table(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)


def ranking_json(rankings: DataFrame, path: str, method: str) -> None:
    """A line for each scenario: method, scenario_id, ranked_candidates."""
    one = F.struct(F.col("candidate").alias("candidate_id"), "rank", "score")
    rows = rankings.groupBy(F.col("sid").alias("scenario_id")).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("x")))).alias("l"))
    rows.select(F.lit(method).alias("method"), "scenario_id", F.transform("l", lambda s: s["x"]).alias("ranked_candidates")).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a markdown table; larger ones belong in files."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(rows.columns), line(["---"] * len(rows.columns)), *map(line, found)]) + "\n"
