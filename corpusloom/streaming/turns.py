"""Event streams: turns from deltas, calls from fragments, token rates, and the same over Structured Streaming.

Batch forms use windows; streaming forms keep one open turn a session as state, closed by a boundary or by an idle timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType

from ..functions.text import TOOL_CALLS

BOUNDARIES = ("tool_result", "done", "error")


def _ordered(piece: Column) -> Column:
    return F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("seq", piece.alias("piece")))), lambda x: x["piece"]))


def assemble_turns(events: DataFrame) -> DataFrame:
    """session_id, turn_no, text, thinking, last_seq, closed_by. events: session_id, seq, event, data. A tool result or an end closes the turn before it."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("turn_no", F.coalesce(F.sum(F.when(F.col("event").isin(*BOUNDARIES), 1).otherwise(0)).over(before), F.lit(0)))
    text, thinking = F.when(F.col("event") == "delta", F.col("data")), F.when(F.col("event") == "thinking", F.col("data"))
    turns = rows.groupBy("session_id", "turn_no").agg(_ordered(text).alias("text"), _ordered(thinking).alias("thinking"), F.max("seq").alias("last_seq"), F.max(F.when(F.col("event").isin(*BOUNDARIES), F.col("event"))).alias("closed_by"))
    return turns.filter((F.col("text") != "") | (F.col("thinking") != ""))


CALL = "struct<call_id:string,tool:string,input:struct<raw:string>>"
RESULT = "struct<call_id:string,content:string>"


def assemble_messages(events: DataFrame, ends: tuple[str, ...] = ()) -> DataFrame:
    """session_id, seq, role, text, thinking, tool_calls, tool_call_id, closed: what a run leaves in the history.

    events: session_id, seq, event, data; data is the text of a delta or thinking event, and JSON of a tool_call (call_id, tool, input.raw)
    or tool_result (call_id, content). A result closes the assistant turn before it and is a row of its own; calls without id or
    name and results without id are ignored; a turn without text, thinking and calls is no row. Events in ends close a turn too; closed: whether anything has."""
    result, call = F.from_json("data", RESULT), F.from_json("data", CALL)
    rows = events.withColumn("result", F.when(F.col("event") == "tool_result", result)).withColumn("call", F.when(F.col("event") == "tool_call", call))
    results = F.coalesce(F.col("result.call_id"), F.lit("")) != ""
    closes = results | F.col("event").isin(*ends) if ends else results
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turn_no", F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(before), F.lit(0)))
    named = (F.coalesce("call.call_id", F.lit("")) != "") & (F.coalesce("call.tool", F.lit("")) != "")
    calls = F.collect_list(F.when(named, F.struct("seq", F.col("call.call_id").alias("id"), F.col("call.tool").alias("name"), F.coalesce("call.input.raw", F.lit("")).alias("args"))))
    text, thinking = F.when(F.col("event") == "delta", F.col("data")), F.when(F.col("event") == "thinking", F.col("data"))
    after = Window.partitionBy("session_id").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("closed", F.max(closes).over(after))
    pieces = rows.filter(F.col("event").isin("delta", "thinking") | named)
    turns = pieces.groupBy("session_id", "turn_no").agg(_ordered(text).alias("text"), _ordered(thinking).alias("thinking"), F.sort_array(calls).alias("calls"), F.max("seq").alias("seq"), F.max("closed").alias("closed"))
    turns = turns.filter((F.col("text") != "") | (F.col("thinking") != "") | (F.size("calls") > 0))
    assistant = turns.select("session_id", "seq", F.lit("assistant").alias("role"), "text", "thinking", F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["args"].alias("args"))).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), "closed")
    tool = rows.filter(results).select("session_id", "seq", F.lit("tool").alias("role"), F.coalesce("result.content", F.lit("")).alias("text"), F.lit("").alias("thinking"), F.array().cast(TOOL_CALLS).alias("tool_calls"), F.col("result.call_id").alias("tool_call_id"), "closed")
    return assistant.unionByName(tool)


def token_rate(events: DataFrame, window_ms: int = 1500) -> DataFrame:
    """events (session_id, seq, ts, tokens) with rate: tokens a second in the window that ends at each event."""
    trailing = Window.partitionBy("session_id").orderBy(F.unix_micros("ts")).rangeBetween(-1000 * window_ms + 1, 0)
    return events.withColumn("rate", F.round(F.sum("tokens").over(trailing) / (window_ms / 1000), 6))


def generation_rate(events: DataFrame) -> DataFrame:
    """session_id and rate: output tokens that the last end's usage tells (tokens_out) a second, from the first token to that end, where both are positive."""
    first = F.min(F.when(F.col("event").isin("delta", "thinking"), F.unix_micros("ts")))
    last = F.max_by(F.struct(F.unix_micros("ts").alias("us"), F.col("tokens_out").cast("long").alias("tokens")), F.when(F.col("event") == "done", F.col("seq")))
    rows = events.groupBy("session_id").agg(first.alias("first"), last.alias("last"))
    tokens, us = F.col("last.tokens"), F.col("last.us") - F.col("first")
    return rows.select("session_id", F.round(F.when((tokens > 0) & (us > 0), tokens * 1e6 / us), 9).alias("rate"))


def reasoning_of(preferred: Column, other: Column) -> Column:
    """The first of two reasoning fields that isn't empty."""
    return F.coalesce(F.nullif(preferred, F.lit("")), F.nullif(other, F.lit("")))


def nonblank_turns(turns: DataFrame) -> DataFrame:
    """turns with text, and incomplete: whether an error or nothing closed them."""
    return turns.filter("text <> ''").withColumn("incomplete", F.coalesce("closed_by", F.lit("error")) == "error")


def live_text(events: DataFrame) -> DataFrame:
    """Each session's shown text: deltas in order, leading blanks dropped."""
    shown = events.filter("event = 'delta' AND data <> ''")
    return shown.groupBy("session_id").agg(F.ltrim(_ordered(F.col("data"))).alias("text"))


def assemble_tool_calls(fragments: DataFrame) -> DataFrame:
    """stream, idx, id, name, args, first_seq: the last id and name that aren't empty, arguments joined in order. Calls without id or name drop out."""
    given = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    calls = fragments.groupBy("stream", "idx").agg(given("id").alias("id"), given("name").alias("name"), _ordered(F.coalesce("args", F.lit(""))).alias("args"), F.min("seq").alias("first_seq"))
    return calls.filter(F.col("id").isNotNull() & F.col("name").isNotNull())


def sse_events(frames: DataFrame) -> DataFrame:
    """event and data of frames (value: one frame of event: and data: lines). Frames with blank, [DONE] or unreadable data drop out."""
    event = F.regexp_extract("value", r"(?m)^event:[ ]?(.*)$", 1)
    data = F.concat_ws("\n", F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^data:[ ]?(.*)$"), F.lit(1)), lambda x: x))
    read = frames.select(F.when(event == "", "message").otherwise(F.btrim(event)).alias("event"), F.btrim(data).alias("data"))
    return read.filter((F.col("data") != "") & (F.col("data") != "[DONE]") & F.try_parse_json("data").isNotNull())


def read_sse_frames(spark, path: str, files_per_batch: int = 1000, crlf: bool = False) -> DataFrame:
    """The frames (value) of logs under a path as they come in. With crlf lines may end with CR, LF or both, and each file is read as a whole."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if not crlf:
        return reader.text(path, lineSep="\n\n")
    return reader.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n\n+")).alias("value"))


def read_sse(spark, path: str, crlf: bool = False) -> DataFrame:
    return sse_events(read_sse_frames(spark, path, crlf=crlf))


def token_rate_stream(events: DataFrame, late: str = "5 seconds") -> DataFrame:
    """Tokens a second in sliding windows of 1.5 s, every 250 ms; events later than the watermark are dropped. events: session_id, ts, tokens."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", "1500 milliseconds", "250 milliseconds")
    return rows.groupBy("session_id", window.alias("w")).agg(F.sum("tokens").alias("tokens")).select("session_id", F.col("w.end").alias("at"), F.round(F.col("tokens") / 1.5, 6).alias("rate"))


def session_status_stream(events: DataFrame) -> DataFrame:
    """The last event of each session; for update mode."""
    return events.groupBy("session_id").agg(F.max_by("event", "seq").alias("status"), F.max("seq").alias("seq"))


TURN = "session_id long, turn_no long, text string, thinking string, last_seq long, closed_by string"


class TurnAssembler(StatefulProcessor):
    """One open turn a session. A micro-batch's events are taken in order of seq; an idle session's turn is closed by a timer."""

    def __init__(self, idle_ms: int | None = 60_000):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "turn_no long, text string, thinking string, last_seq long")

    def _closed(self, key, state, by: str | None) -> list[tuple]:
        turn_no, text, thinking, last = state
        return [(key[0], turn_no, text, thinking, last, by)] if text or thinking else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else (0, "", "", -1)
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            turn_no, text, thinking, _ = state
            if row.event in BOUNDARIES:
                out += self._closed(key, (turn_no, text, thinking, row.seq), row.event)
                state = (turn_no + 1, "", "", row.seq)
            else:
                state = (turn_no, text + (row.data if row.event == "delta" else ""), thinking + (row.data if row.event == "thinking" else ""), row.seq)
        self.open.update(tuple(state))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._closed(key, self.open.get(), None) if self.open.exists() else []
        self.open.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")])

    def close(self) -> None:
        pass


def assemble_turns_stream(events: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """As assemble_turns, for a stream; needs the RocksDB state store. Without idle_ms, as in a backfill, only boundaries close a turn."""
    return events.groupBy("session_id").transformWithStateInPandas(TurnAssembler(idle_ms), TURN, "append", "none" if idle_ms is None else "processingTime")


CALLS = "stream long, idx long, id string, name string, args string, first_seq long"


class CallAssembler(StatefulProcessor):
    """The calls of one stream that are open; a row of an end (done true) gives them out in order of first appearance."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "idx long", "id string, name string, args string, first_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if row.done:
                calls = sorted(((k[0], *v) for k, v in self.open.iterator()), key=lambda c: c[4])
                out += [(key[0], *c) for c in calls if c[1] and c[2]]
                self.open.clear()
                continue
            at = (int(row.idx),)
            known = self.open.getValue(at) if self.open.containsKey(at) else ("", "", "", int(row.seq))
            self.open.updateValue(at, (row.id or known[0], row.name or known[1], known[2] + (row.args or ""), known[3]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")])

    def close(self) -> None:
        pass


def assemble_tool_calls_stream(fragments: DataFrame) -> DataFrame:
    """As assemble_tool_calls, for a stream whose fragments have a column done: a row with it true ends its stream."""
    return fragments.groupBy("stream").transformWithStateInPandas(CallAssembler(), CALLS, "append", "none")


def replay(board: dict[int, list], used: set[int], log: pd.DataFrame) -> None:
    """The log's rows in order of seq, applied to a board of id: [status, blockers]."""
    for x in log.sort_values("seq").itertuples(index=False):
        number = int(x.id)
        if x.op == "create" and number not in used:
            used.add(number)
            board[number] = ["pending", [] if x.blocked_by is None else [int(b) for b in x.blocked_by]]
        elif x.op == "delete":
            board.pop(number, None)
        elif x.op == "update" and number in board:
            blocked = any(board.get(b, [""])[0] != "completed" for b in board[number][1])
            if x.status == "in_progress":
                if blocked:
                    continue
                for other in board.values():
                    if other[0] == "in_progress":
                        other[0] = "pending"
            board[number][0] = x.status


class TaskReplay(StatefulProcessor):
    """A session's board and the numbers that it has used: a batch of log rows gives the rows whose status changed (a deleted one with none)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", "id long", "status string, blocked_by array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: [v[0], list(v[1] or [])] for k, v in self.tasks.iterator()}
        board = {k: [s, b] for k, (s, b) in known.items() if s}
        used = set(known)
        replay(board, used, pd.concat(list(rows)))
        out = []
        for number in sorted(used):
            now = board.get(number, [None, []])
            if number not in known or known[number][0] != (now[0] or ""):
                # A deleted task stays as an empty one, so its number isn't used again.
                self.tasks.updateValue((number,), (now[0] or "", now[1]))
                out.append((key[0], number, now[0]))
        yield pd.DataFrame(out, columns=["session_id", "id", "status"])

    def close(self) -> None:
        pass


def replay_tasks_stream(log: DataFrame) -> DataFrame:
    """As replay_tasks, for a stream: session_id, id and status of what a batch changed."""
    return log.groupBy("session_id").transformWithStateInPandas(TaskReplay(), "session_id long, id long, status string", "update", "none")


def replay_tasks(log: DataFrame) -> DataFrame:
    """session_id, id, status after a log (session_id, seq, op, id, status, blocked_by): one task in progress a session, a blocked start is refused, ids aren't used again."""

    def play(part: pd.DataFrame) -> pd.DataFrame:
        board: dict[int, list] = {}
        replay(board, set(), part)
        session = part["session_id"].iloc[0]
        return pd.DataFrame([(session, i, s) for i, (s, _) in sorted(board.items())], columns=["session_id", "id", "status"])

    return log.groupBy("session_id").applyInPandas(play, "session_id long, id long, status string")


class FirstSeen(StatefulProcessor):
    """The first document of each base and content hash, unless the hash is that of a stored one: stored rows of a batch come before its documents."""

    def __init__(self, columns: list[str], flag: str, keep_ms: int | None = None):
        self.columns, self.flag, self.keep_ms = columns, flag, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        first = None
        for part in rows:
            known = known or bool(part[self.flag].any())
            new = part[~part[self.flag].astype(bool)].sort_values(["created_at"], kind="stable").head(1)
            if len(new) and (first is None or new["created_at"].iloc[0] < first["created_at"].iloc[0]):
                first = new
        self.seen.update((True,))
        yield pd.DataFrame([], columns=self.columns) if known or first is None else first[self.columns]

    def close(self) -> None:
        pass


def dedupe_stream(docs: DataFrame, late: str = "1 hour", stored: DataFrame | None = None, additions: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """A stream's documents (kb_id, content_hash, created_at, ...) without those whose base and hash came before.

    Without additions: within the watermark on created_at, and without those that stand in stored (kb_id, content_hash) as it is when the
    query starts. additions is a stream of the stored table, with what it held and what is added to it: its hashes and those of the
    documents are kept as one flag each, for good or for keep_ms, so a copy of what is stored later is dropped too; needs the RocksDB
    state store."""
    keys = ["kb_id", "content_hash"]
    if stored is not None:
        docs = docs.join(stored.select(*keys).distinct(), keys, "left_anti").select(docs.columns)
    if additions is None:
        return docs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(keys)
    flag = "stored"
    while flag in docs.columns:
        flag += "x"
    # Numbers are zero in stored rows: pandas would turn longs beside nulls into doubles.
    filler = [F.lit(0).cast(f.dataType).alias(f.name) for f in docs.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
    rows = docs.withColumn(flag, F.lit(False)).unionByName(additions.select(*keys, *filler, F.lit(True).alias(flag)), allowMissingColumns=True)
    return rows.groupBy(*keys).transformWithStateInPandas(FirstSeen(docs.columns, flag, keep_ms), docs.schema, "append", "none" if keep_ms is None else "processingTime")
