"""The audit trail: building, emitting, reading, filtering, joining and verifying event rows. No raw text is in any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.signing import verify_json

#: Characters of a deny reason; a longer one ends in "...".
REASON_CHARS = 500


def truncate_reason(reason: Column) -> Column:
    return F.when(F.length(reason) > REASON_CHARS, F.concat(F.substring(reason, 1, REASON_CHARS - 3), F.lit("..."))).otherwise(reason)


def events_from_verdicts(verdicts: DataFrame, boundary: str, id_col: str, ts: Column) -> DataFrame:
    """One event for each verdict row: boundary, decision, counts; event_id follows from the row, so a retry makes the same event."""
    return verdicts.select(
        F.sha2(F.concat_ws(":", F.lit(boundary), F.col(id_col).cast("string")), 256).alias("event_id"),
        ts.alias("timestamp"),
        F.lit(boundary).alias("boundary"),
        F.col("status").alias("decision"),
        "finding_count",
        "max_severity",
    )


def consolidated_events(events: DataFrame, risk: DataFrame, threshold: float) -> DataFrame:
    """events (of outputs) and, for turns of risk threshold or more that aren't blocked yet, a second event each that says so."""
    more = events.join(risk.filter(F.col("turn_risk") >= threshold).select("event_id"), "event_id", "left_semi").filter("decision != 'block'")
    more = more.withColumn("decision", F.lit("block")).withColumn("signal_source", F.lit("consolidated"))
    return events.withColumn("signal_source", F.lit(None).cast("string")).unionByName(more)


def emit(events: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> list[str]:
    """Send events to every sink; returns the names of sinks that failed. If all fail, the last error is raised."""
    failed, last = [], None
    for sink in sinks:
        try:
            sink(events)
        except Exception as e:  # noqa: BLE001 - one bad sink must not keep the others from the events
            failed.append(getattr(sink, "__name__", str(sink)))
            last = e
    if last is not None and len(failed) == len(sinks):
        raise last
    return failed


def json_sink(path: str, max_bytes: int = 100_000_000, keep: int | None = 11) -> Callable[[DataFrame], None]:
    """A sink of JSON lines in files of about max_bytes, of which the newest keep stay (None: all of them).

    A file's share of the lines is told by the mean length of the batch's lines, so a batch is split before it is written.
    """

    def write(events: DataFrame) -> None:
        mean = events.select(F.avg(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
        if mean is None:
            return
        events.write.mode("append").option("maxRecordsPerFile", max(1, int(max_bytes / (mean + 1)))).json(path)
        if keep is None:
            return
        folder = events.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(events.sparkSession._jsc.hadoopConfiguration())
        files = sorted((s.getModificationTime(), s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        for _, _, old in files[: max(0, len(files) - keep)]:
            fs.delete(old, False)

    return write


def read_log(lines: DataFrame, schema: str) -> DataFrame:
    """lines (line_no, raw) parsed; bad says that a line is no JSON object."""
    parsed = lines.withColumn("e", F.from_json("raw", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("line_no", "e.*", (F.col("e._corrupt_record").isNotNull() | F.col("e").isNull()).alias("bad")).drop("_corrupt_record")


def tail(events: DataFrame, n: int = 20, boundary: str | None = None, decision: str | None = None, order: str = "line_no") -> DataFrame:
    """Of the last n lines, in the order of the log, those that pass the filters; 0 for none. Lines that don't parse take their place in n."""
    last = events.orderBy(F.col(order).desc()).limit(n)
    for name, value in (("boundary", boundary), ("decision", decision)):
        if value is not None:
            last = last.filter(F.col(name) == value)
    return last.orderBy(order)


#: What is put before a reason that a rule of arguments or of irreversible tools gave.
_REASON_TAGS = [("  [argument_violation]", r"argument rule violation"), ("  [irreversibility_blocked]", r"(?is)^(?=.*irreversible)(?=.*approv)")]


def line_format(timestamp: Column, boundary: Column, decision: Column, agent: Column, reason: Column, tool: Column | None = None, severity: Column | None = None, n_findings: Column | None = None, signals: Column | None = None, transforms: Column | None = None, duration_ms: Column | None = None) -> Column:
    """One printed line of an event: when, decision, boundary, agent, and what else is known of it.

    After the tool: findings and their worst severity, the reason with its tag, [session_escalation] where the signals say
    so, [deobfuscated: ...] where views were made, and the duration.
    """
    none = F.lit("")
    padded = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(c))))
    given = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text).otherwise(none)
    tag = F.coalesce(*[F.when(F.regexp_like(reason, F.lit(p)), t) for t, p in _REASON_TAGS], none)
    escaped = F.replace(reason, F.lit("\\"), F.lit("\\\\"))
    quoted = F.when(reason.contains("'") & ~reason.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    more = [
        given(n_findings > 0, F.concat(F.lit("  findings="), n_findings.cast("string"), F.lit(" max="), severity)) if severity is not None and n_findings is not None else none,
        given(reason != "", F.concat(tag, F.when(tag == "", "  reason=").otherwise(" reason="), quoted)),
        given(F.array_contains(signals, "session_escalation"), F.lit("  [session_escalation]")) if signals is not None else none,
        given(F.size(transforms) > 0, F.concat(F.lit("  [deobfuscated: "), F.array_join(transforms, ","), F.lit("]"))) if transforms is not None else none,
        given(duration_ms.isNotNull(), F.concat(F.lit(" +"), duration_ms.cast("string"), F.lit("ms"))) if duration_ms is not None else none,
    ]
    head = F.concat(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("  "), padded(decision, 7), F.lit("  "), padded(boundary, 16), F.lit("  "), padded(agent, 35), F.lit("  "))
    return F.rtrim(F.concat(head, F.coalesce(tool, none) if tool is not None else none, *more))


def verify(lines: DataFrame, secret: str) -> DataFrame:
    """(class, n): how many log lines are ok, mismatched, unsigned or malformed; blank lines don't count."""
    return lines.filter(F.trim("raw") != "").select(verify_json(F.col("raw"), secret).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def failures(lines: DataFrame, secret: str, n: int = 20) -> DataFrame:
    """The first n lines that aren't ok: line_no and class."""
    return lines.filter(F.trim("raw") != "").select("line_no", verify_json(F.col("raw"), secret).alias("class")).filter("class != 'ok'").orderBy("line_no").limit(n)


def join_network(gate: DataFrame, network: DataFrame) -> DataFrame:
    """Gate events with the network events that their tokens led to."""
    return gate.join(network, "token_id")


def json_strings(values: Column) -> Column:
    """An array of strings as JSON text: ", " between, beyond ASCII and control characters as \\u escapes."""

    def escaped(value: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
        for c, e in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            plain = F.replace(plain, F.lit(c), F.lit("\\" + e))
        # a UTF-16 code unit at a time, as JSON has it
        units = F.regexp_extract_all(F.hex(F.encode(plain, "UTF-16BE")), F.lit("(....)"), 1)
        text = lambda u: F.when((u >= "0020") & (u <= "007E"), F.chr(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        return F.when(F.regexp_like(plain, F.lit(r"[^\x20-\x7E]")), F.array_join(F.transform(units, text), "")).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), escaped(v), F.lit('"'))), ", "), F.lit("]"))


def list_digest(values: Column) -> Column:
    """SHA-256 of the sorted values as a JSON list: what an attestation pins a rule or source list to."""
    return F.sha2(json_strings(F.array_sort(values)), 256)


def latest_by(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
