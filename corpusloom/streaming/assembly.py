"""Model streams to history as one stream: frames to events, reasoning apart from text, call fragments to calls, turns with their calls
and tool rows, usage and rates. Two stateful operators are chained; the watermark of the first is carried to the second.

The first holds a session's events until the watermark has passed them and gives them out in order of time and number, so a log may
come shuffled over micro-batches; it also joins call fragments. The second keeps one open turn a session and closes it at a tool
result, an end, or after idle event time. Events later than the watermark are dropped. The batch twins use windows and give the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import TOOL_CALLS
from .turns import assemble_messages, assemble_tool_calls, reasoning_of, sse_events

#: session_id, seq and ts order a session's events; a fragment has idx, call_id, tool and data (a piece of arguments), a done has its usage.
EVENT = "session_id long, seq long, ts timestamp, event string, data string, idx long, call_id string, tool string, tokens_in long, tokens_out long"
ROW = "session_id long, seq long, ts timestamp, kind string, text string, thinking string, calls string, tool_call_id string, tokens_in long, tokens_out long, rate double"
ENDS = ("done", "error")
#: A frame may hold several events: they get numbers of their own in this order.
PLACES = 64
FRAME = """session_id long, seq long, ts timestamp, error string, done boolean, usage struct<input:long,output:long>, call_id string, content string,
 delta struct<content:string,reasoning_content:string,reasoning:string,tool_calls:array<struct<index:long,id:string,function:struct<name:string,arguments:string>>>>"""


def frame_events(frames: DataFrame) -> DataFrame:
    """Events (EVENT) of frames (value, as sse_events reads them), whose data is JSON (FRAME). A frame named tool_result has call_id and content."""
    read = sse_events(frames).select("event", F.from_json("data", FRAME).alias("f")).filter("f.session_id IS NOT NULL AND f.seq IS NOT NULL AND f.ts IS NOT NULL")
    none = lambda t: F.lit(None).cast(t)

    def one(event: str, at, data=None, idx=None, call_id=None, tool=None, tokens_in=None, tokens_out=None):
        given = {"data": data, "idx": idx, "call_id": call_id, "tool": tool, "tokens_in": tokens_in, "tokens_out": tokens_out}
        kinds = {"data": "string", "idx": "long", "call_id": "string", "tool": "string", "tokens_in": "long", "tokens_out": "long"}
        return F.struct(F.lit(event).alias("event"), (F.lit(at) if isinstance(at, int) else at).cast("long").alias("at"), *[(none(kinds[k]) if v is None else v.cast(kinds[k])).alias(k) for k, v in given.items()])

    f = lambda name: F.col(f"f.{name}")
    thinking, text = reasoning_of(f("delta.reasoning_content"), f("delta.reasoning")), F.nullif(f("delta.content"), F.lit(""))
    result = F.when(F.col("event") == "tool_result", one("tool_result", 0, F.coalesce(f("content"), F.lit("")), call_id=f("call_id")))
    pieces = F.transform(F.coalesce(f("delta.tool_calls"), F.array()), lambda c, i: one("fragment", i + 3, c["function"]["arguments"], F.coalesce(c["index"], i.cast("long")), c["id"], c["function"]["name"]))
    end = F.when(f("done"), one("done", PLACES - 1, tokens_in=f("usage.input"), tokens_out=f("usage.output"))).when(f("error").isNotNull(), one("error", PLACES - 1, f("error")))
    events = F.array_compact(F.concat(F.array(result, F.when(thinking.isNotNull(), one("thinking", 1, thinking)), F.when(text.isNotNull(), one("delta", 2, text))), pieces, F.array(end)))
    rows = read.select(f("session_id").alias("session_id"), f("seq").alias("n"), f("ts").alias("ts"), F.explode_outer(events).alias("e")).filter("e IS NOT NULL")
    return rows.select("session_id", (F.col("n") * PLACES + F.least(F.col("e.at"), F.lit(PLACES - 1))).alias("seq"), "ts", "e.event", "e.data", "e.idx", "e.call_id", "e.tool", "e.tokens_in", "e.tokens_out")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class InOrder(StatefulProcessor):
    """Events of a session in order, once the watermark has passed them, with fragments joined to calls.

    State: waiting events by time and number, and the open calls by index. A call is given out before the next event that is no
    fragment, delta or thinking, in order of first appearance, with that event's time; calls without id or name drop out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, seq long", "event string, data string, idx long, call_id string, tool string, tokens_in long, tokens_out long")
        self.calls = handle.getMapState("calls", "idx long", "id string, name string, args string, first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        due = set()
        for part in rows:
            for x in part.itertuples(index=False):
                us = int(x.ts.value // 1000)
                self.waiting.updateValue((us, int(x.seq)), (x.event, x.data, whole(x.idx), x.call_id, x.tool, whole(x.tokens_in), whole(x.tokens_out)))
                due.add(us // 1000)
        for ms in due:
            self.handle.registerTimer(ms)
        yield pd.DataFrame([], columns=_names(EVENT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed goes at the first timer; the later ones of this batch find nothing.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] // 1000 <= passed) if self.waiting.exists() else []
        out: list[tuple] = []
        for (us, seq), (event, data, idx, call_id, tool, tokens_in, tokens_out) in ready:
            self.waiting.removeKey((us, seq))
            ts = pd.Timestamp(us, unit="us")
            if event == "fragment":
                at = (idx if idx is not None else 0,)
                known = self.calls.getValue(at) if self.calls.containsKey(at) else ("", "", "", seq)
                self.calls.updateValue(at, (call_id or known[0], tool or known[1], known[2] + (data or ""), known[3]))
                continue
            if event not in ("delta", "thinking") and self.calls.exists():
                for name, tool_, args, first in sorted((v for _, v in self.calls.iterator()), key=lambda v: v[3]):
                    if name and tool_:
                        out.append((key[0], first, ts, "tool_call", json.dumps({"call_id": name, "tool": tool_, "input": {"raw": args}}), None, None, None, None, None))
                self.calls.clear()
            out.append((key[0], seq, ts, event, data, None, call_id, None, tokens_in, tokens_out))
        yield pd.DataFrame(out, columns=_names(EVENT)).astype({"tokens_in": "Int64", "tokens_out": "Int64", "idx": "Int64"})

    def close(self) -> None:
        pass


class RunAssembler(StatefulProcessor):
    """Rows (ROW) of a session's events in order: assistant turns with their calls, tool rows, and at each end a row of the run with usage and rate.

    State: the open turn's text and thinking, its calls by number, and the run's first token and last assistant row."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "text string, thinking string, seq long")
        self.calls = handle.getMapState("calls", "seq long", "id string, name string, args string")
        self.run = handle.getValueState("run", "first_us long, assistant long")

    def _closed(self, key, ts: pd.Timestamp) -> list[tuple]:
        text, thinking, seq = self.turn.get() if self.turn.exists() else ("", "", -1)
        calls = [{"id": i, "name": n, "args": a} for _, (i, n, a) in sorted(self.calls.iterator())] if self.calls.exists() else []
        self.turn.clear()
        self.calls.clear()
        if not (text or thinking or calls):
            return []
        first, _ = self.run.get() if self.run.exists() else (None, None)
        self.run.update((first, seq))
        return [(key[0], seq, ts, "assistant", text, thinking, json.dumps(calls), None, None, None, None)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        last = 0
        for x in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            text, thinking, seq = self.turn.get() if self.turn.exists() else ("", "", -1)
            us, last = int(x.ts.value // 1000), max(last, int(x.ts.value // 1_000_000))
            if x.event in ("delta", "thinking"):
                first, assistant = self.run.get() if self.run.exists() else (None, None)
                self.run.update((us if first is None else first, assistant))
                more = x.data or ""
                self.turn.update((text + more, thinking, x.seq) if x.event == "delta" else (text, thinking + more, x.seq))
            elif x.event == "tool_call":
                call = json.loads(x.data)
                self.calls.updateValue((int(x.seq),), (call["call_id"], call["tool"], call["input"]["raw"]))
                self.turn.update((text, thinking, max(seq, x.seq)))
            elif x.event == "tool_result" and x.call_id:
                out += self._closed(key, x.ts)
                out.append((key[0], x.seq, x.ts, "tool", x.data or "", "", "[]", x.call_id, None, None, None))
            elif x.event in ENDS:
                out += self._closed(key, x.ts)
                first, assistant = self.run.get() if self.run.exists() else (None, None)
                tokens_in, tokens_out = (None if pd.isna(v) else int(v) for v in (x.tokens_in, x.tokens_out))
                timed = x.event == "done" and first is not None and us > first and (tokens_out or 0) > 0
                out.append((key[0], assistant, x.ts, "run", x.event, "", "[]", None, tokens_in, tokens_out, tokens_out * 1e6 / (us - first) if timed else None))
                self.run.clear()
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=_names(ROW)).astype({"seq": "Int64", "tokens_in": "Int64", "tokens_out": "Int64", "rate": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._closed(key, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")))

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, late: str = "10 seconds", idle_ms: int | None = None) -> DataFrame:
    """Rows (ROW) of a stream of events (EVENT), in append mode; needs the RocksDB state store. idle_ms: event time after which an open turn is closed."""
    ordered = events.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(InOrder(), EVENT, "append", "eventTime", eventTimeColumnName="ts")
    return ordered.groupBy("session_id").transformWithStateInPandas(RunAssembler(idle_ms), ROW, "append", "eventTime")


def joined_calls(events: DataFrame) -> DataFrame:
    """Batch: events with fragments joined to tool_call events, as InOrder gives them out."""
    of_session = Window.partitionBy("session_id").orderBy("ts", "seq")
    flush = ~F.col("event").isin("fragment", "delta", "thinking")
    rows = events.withColumn("part", F.coalesce(F.sum(F.when(flush, 1).otherwise(0)).over(of_session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = rows.filter("event = 'fragment'").select(F.struct("session_id", "part").alias("stream"), F.coalesce("idx", F.lit(0)).alias("idx"), "seq", F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("data").alias("args"))
    flushed = rows.filter(flush).select("session_id", "part")  # calls of a part that nothing ends are still open
    calls = assemble_tool_calls(pieces).select("stream.session_id", "stream.part", F.col("first_seq").alias("seq"), F.to_json(F.struct(F.col("id").alias("call_id"), F.col("name").alias("tool"), F.struct(F.col("args").alias("raw")).alias("input"))).alias("data"))
    calls = calls.join(flushed, ["session_id", "part"]).select("session_id", "seq", F.lit("tool_call").alias("event"), "data")
    return rows.filter("event <> 'fragment'").drop("part").unionByName(calls, allowMissingColumns=True)


def run_usage(events: DataFrame) -> DataFrame:
    """Batch: session_id, run_no, closed_by, tokens_in, tokens_out, rate and assistant (the number of the run's last assistant row) of every ended run."""
    before = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = events.withColumn("run_no", F.coalesce(F.sum(F.when(F.col("event").isin(*ENDS), 1).otherwise(0)).over(before), F.lit(0)))
    token, end = F.col("event").isin("delta", "thinking"), F.col("event").isin(*ENDS)
    first, last = F.min(F.when(token, F.unix_micros("ts"))), F.max(F.when(end, F.unix_micros("ts")))
    sums = runs.groupBy("session_id", "run_no").agg(first.alias("first"), last.alias("last"), F.max(F.when(end, F.col("event"))).alias("closed_by"), F.max(F.when(end, F.col("tokens_in"))).alias("tokens_in"), F.max(F.when(end, F.col("tokens_out"))).alias("tokens_out"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    timed = (F.col("closed_by") == "done") & (F.col("last") > F.col("first")) & (F.col("tokens_out") > 0)
    return sums.filter("closed_by IS NOT NULL").withColumn("rate", F.when(timed, F.col("tokens_out") * 1e6 / (F.col("last") - F.col("first"))))


def assemble_batch(events: DataFrame) -> DataFrame:
    """The rows of assemble_stream (ROW but ts, calls as an array) of a whole log."""
    joined = joined_calls(events)
    result = F.to_json(F.struct("call_id", F.coalesce("data", F.lit("")).alias("content")))
    shaped = joined.withColumn("data", F.when(F.col("event") == "tool_result", result).otherwise(F.col("data")))
    found = assemble_messages(shaped.select("session_id", "seq", "event", "data"), ENDS)
    messages = found.filter("closed").select("session_id", "seq", F.col("role").alias("kind"), "text", "thinking", F.col("tool_calls").alias("calls"), "tool_call_id")
    runs = run_usage(events)
    turns = messages.filter("kind = 'assistant'").select(F.col("session_id").alias("s"), F.col("seq").alias("at"))
    last = runs.join(turns, (F.col("session_id") == F.col("s")) & (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")), "left").groupBy("session_id", "run_no", "closed_by", "tokens_in", "tokens_out", "rate").agg(F.max("at").alias("seq"))
    ended = last.select("session_id", "seq", F.lit("run").alias("kind"), F.col("closed_by").alias("text"), F.lit("").alias("thinking"), F.array().cast(TOOL_CALLS).alias("calls"), F.lit(None).cast("string").alias("tool_call_id"), "tokens_in", "tokens_out", "rate")
    return messages.unionByName(ended, allowMissingColumns=True)


def write_rows(rows: DataFrame, target: str, checkpoint: str):
    """Appends the rows of assemble_stream under target, one folder a kind and batch; a batch that runs again writes the same folders."""

    def batch(part: DataFrame, number: int) -> None:
        part.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(target)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
