"""Conversation histories: token sums, pruning of old tool output, the cut between head and tail, rewriting.

messages: session_id, seq, role, text, and for the cut has_calls. All of it is windows over one session in order of seq. Where
sessions may be longer than a task should hold, pruning and cutting take block_rows: running sums are then made in two steps, within
blocks of so many numbers of seq and over a session's blocks, so one session is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOOL_CALLS, TRIM_HEAD, TRIM_MARK, est_message_tokens, est_tokens, trim_tool_output
from ..staging import staged

WINDOW = 200_000
RESERVE, BUFFER, PROTECTED, MIN_GAIN, KEPT_RESULTS = 8000, 2000, 40_000, 8000, 6


def session_window(*keys: str):
    return Window.partitionBy(*(keys or ("session_id",))).orderBy("seq")


def message_tokens(messages: DataFrame) -> Column:
    """A message's tokens: its text, and the arguments of its calls and its pictures where messages has these columns."""
    has = lambda name, kind: F.col(name) if name in messages.columns else F.array().cast(kind)
    return est_message_tokens(F.col("text"), has("tool_calls", TOOL_CALLS), has("images", "array<string>"))


def history_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.sum(message_tokens(messages)).cast("long").alias("tokens"), F.count("*").alias("n_messages"))


def window_usage(totals: DataFrame, window: Column | int = WINDOW, percent: int = 60) -> DataFrame:
    """totals with the share of the model's window, and whether compaction is due."""
    size = window if isinstance(window, Column) else F.lit(window)
    size = F.when(size > 0, size).otherwise(WINDOW)
    return totals.withColumn("usage", F.round(F.col("tokens") / size, 6)).withColumn("due", F.col("tokens") * 100 >= size * percent)


def blocked(messages: DataFrame, block_rows: int) -> DataFrame:
    return messages.withColumn("_block", F.floor(F.col("seq") / block_rows))


def running(rows: DataFrame, out: str, value: Column, falling: bool = False, own: bool = False, highest: bool = False) -> DataFrame:
    """rows (session_id, _block, seq, ...) with out: the sum of value over the rows before (falling: after) each row in its session, or the highest; own: with the row itself.

    Blocks are summed up first, then a session's blocks are run over, and then the rows within each block; nulls count for nothing."""
    fold = F.max if highest else F.sum
    rows = rows.withColumn(out, value)
    order = lambda c: F.col(c).desc() if falling else F.col(c)
    sums = rows.groupBy("session_id", "_block").agg(fold(out).alias("_sum"))
    earlier = Window.partitionBy("session_id").orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("session_id", "_block", fold("_sum").over(earlier).alias("_base"))
    inner = fold(out).over(Window.partitionBy("session_id", "_block").orderBy(order("seq")).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    both = F.greatest(F.col("_base"), inner) if highest else F.when(F.col("_base").isNotNull() | inner.isNotNull(), F.coalesce("_base", F.lit(0)) + F.coalesce(inner, F.lit(0)))
    joined = rows.join(base, (rows["session_id"] == base["session_id"]) & rows["_block"].eqNullSafe(base["_block"])).drop(base["session_id"], base["_block"])
    return staged(joined.withColumn(out, both).drop("_base"), "running")


def prune_long_history(messages: DataFrame, window: int, reserve: int, buffer: int, protected: int, min_gain: int, kept: int, head: int, mark: str, block_rows: int) -> DataFrame:
    """prune_history by running sums in two steps. Only what decides is carried through them; texts are joined at the end by (session_id, seq)."""
    trimmed = trim_tool_output(F.col("text"), head, mark)
    tool = F.col("role") == "tool"
    slim = blocked(messages.select("session_id", "seq", tool.alias("_tool"), message_tokens(messages).alias("_t"), est_tokens(trimmed).alias("_short")), block_rows)
    rows = running(staged(slim, "tokens"), "_from_end", F.when(F.col("_tool"), 1), falling=True, own=True)
    rows = running(rows.withColumn("_candidate", F.col("_tool") & (F.col("_from_end") > kept)), "_later", F.when(F.col("_candidate"), F.col("_t")), falling=True)
    rows = rows.withColumn("_cuttable", F.col("_candidate") & (F.coalesce("_later", F.lit(0)) >= protected)).withColumn("_gain", F.when(F.col("_cuttable"), F.col("_t") - F.col("_short")))
    rows = running(rows, "_prefix", F.col("_gain"), own=True)
    rows = running(rows, "_reached", F.when(F.col("_cuttable"), F.col("_prefix")), highest=True)
    totals = rows.groupBy("session_id").agg(F.sum("_t").alias("_total"))
    goal = F.col("_total") - F.lit(window - reserve - buffer)
    open_ = F.lit(window > 0) & (goal > 0) & F.col("_cuttable") & (F.col("_reached").isNull() | (F.col("_reached") < goal))
    cut = staged(rows.join(totals, "session_id").filter(open_).select("session_id", "seq", "_gain"), "cut")
    enough = cut.groupBy("session_id").agg(F.sum("_gain").alias("_all")).filter(F.col("_all") >= min_gain).select("session_id")
    chosen = cut.join(enough, "session_id").select("session_id", "seq", F.lit(True).alias("pruned"))
    found = messages.join(chosen, ["session_id", "seq"], "left").withColumn("pruned", F.coalesce("pruned", F.lit(False)))
    return found.withColumn("new_text", F.when(F.col("pruned"), trimmed).otherwise(F.col("text")))


def prune_history(messages: DataFrame, window: int, reserve: int = RESERVE, buffer: int = BUFFER, protected: int = PROTECTED, min_gain: int = MIN_GAIN, kept: int = KEPT_RESULTS, head: int = TRIM_HEAD, mark: str = TRIM_MARK, block_rows: int | None = None) -> DataFrame:
    """messages with new_text and pruned: the oldest tool results cut to a head until the session fits its budget.

    The newest `kept` results, and the newest `protected` tokens of the rest, are never cut; a session whose gain stays under
    min_gain is left as it was. Rows and other roles never change."""
    if block_rows is not None:
        return prune_long_history(messages, window, reserve, buffer, protected, min_gain, kept, head, mark, block_rows)
    usable = window - reserve - buffer
    of = Window.partitionBy("session_id")
    tool = F.col("role") == "tool"
    rows = messages.withColumn("_t", message_tokens(messages)).withColumn("_total", F.sum("_t").over(of)).withColumn("_tool", tool)
    newest = Window.partitionBy("session_id", "_tool").orderBy(F.col("seq").desc())
    rows = rows.withColumn("_candidate", tool & (F.row_number().over(newest) > kept))
    after = Window.partitionBy("session_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    later = F.coalesce(F.sum(F.when(F.col("_candidate"), F.col("_t"))).over(after), F.lit(0))
    trimmed = trim_tool_output(F.col("text"), head, mark)  # a result has no calls and no pictures
    rows = rows.withColumn("_cuttable", F.col("_candidate") & (later >= protected)).withColumn("_gain", F.when(F.col("_cuttable"), F.col("_t") - est_tokens(trimmed)))
    rows = rows.withColumn("_prefix", F.sum("_gain").over(upto))
    reached = F.max(F.when(F.col("_cuttable"), F.col("_prefix"))).over(before)
    goal = F.col("_total") - F.lit(usable)
    open_ = F.lit(window > 0) & (goal > 0) & F.col("_cuttable") & (reached.isNull() | (reached < goal))
    rows = rows.withColumn("_cut", open_)
    gain = F.sum(F.when(F.col("_cut"), F.col("_gain"))).over(of)
    done = F.col("_cut") & (F.coalesce(gain, F.lit(0)) >= min_gain)
    return rows.withColumn("pruned", done).withColumn("new_text", F.when(done, trimmed).otherwise(F.col("text"))).drop("_t", "_total", "_tool", "_candidate", "_cuttable", "_gain", "_prefix", "_cut")


def split_head_tail(messages: DataFrame, keep: int, block_rows: int | None = None) -> DataFrame:
    """session_id, n and head_end: rows before head_end may be summarised. No call is cut from its result; head_end = n is no cut."""
    of = Window.partitionBy("session_id").orderBy("seq")
    down = Window.partitionBy("session_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    safe = ~((F.col("role") == "tool") | ((F.col("role") == "assistant") & F.col("has_calls")))
    if block_rows is None:
        rows = messages.withColumn("_i", F.row_number().over(of) - 1).withColumn("_suffix", F.sum(message_tokens(messages)).over(down)).withColumn("_safe", safe)
    else:
        slim = staged(blocked(messages.select("session_id", "seq", message_tokens(messages).alias("_t"), safe.alias("_safe")), block_rows), "tokens")
        rows = running(running(slim, "_i", F.lit(1)).withColumn("_i", F.coalesce("_i", F.lit(0))), "_suffix", F.col("_t"), falling=True, own=True)
    # The crossing row is the last whose suffix is over the budget; suffix sums fall, so rows up to it are those over it.
    over = F.col("_suffix") > keep
    cut = F.max(F.when(over & F.col("_safe") & (F.col("_i") >= 1), F.col("_i")))
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), cut.alias("_cut")).select("session_id", "n", F.coalesce("_cut", "n").cast("long").alias("head_end"))


def compact_prefix(messages: DataFrame, cuts: DataFrame, summaries: DataFrame) -> DataFrame:
    """messages with the rows before head_end replaced by one row of role summary; sessions without a cut or a summary stay as they are."""
    of = Window.partitionBy("session_id").orderBy("seq")
    known = cuts.filter((F.col("head_end") < F.col("n")) & (F.col("head_end") > 0)).join(summaries.filter(F.col("summary").isNotNull()), "session_id")
    rows = messages.withColumn("_i", F.row_number().over(of) - 1).join(known.select("session_id", "head_end", "summary"), "session_id", "left")
    tail = rows.filter(F.col("head_end").isNull() | (F.col("_i") >= F.col("head_end")))
    made = tail.filter(F.col("_i") == F.col("head_end")).select("session_id", (F.col("seq") - 0.5).alias("seq"), F.lit("summary").alias("role"), F.col("summary").alias("text"))
    out = tail.select("session_id", F.col("seq").cast("double").alias("seq"), "role", "text").unionByName(made)
    return out.select("session_id", (F.row_number().over(of) - 1).cast("long").alias("seq"), "role", "text")


def compact_stats(messages: DataFrame, cuts: DataFrame, summaries: DataFrame, window: int = WINDOW) -> DataFrame:
    """session_id, removed (rows), tokens_before, tokens_after (the summary's own are not counted) and usage_after of the sessions that compact_prefix shortens."""
    known = cuts.filter((F.col("head_end") < F.col("n")) & (F.col("head_end") > 0)).join(summaries.filter(F.col("summary").isNotNull()).select("session_id"), "session_id").select("session_id", "head_end")
    rows = messages.withColumn("_t", message_tokens(messages)).withColumn("_i", F.row_number().over(session_window()) - 1).join(known, "session_id")
    head = F.col("_i") < F.col("head_end")
    sums = rows.groupBy("session_id").agg(F.count_if(head).alias("removed"), F.sum("_t").cast("long").alias("tokens_before"), F.sum(F.when(~head, F.col("_t")).otherwise(0)).cast("long").alias("tokens_after"))
    return sums.withColumn("usage_after", F.round(F.col("tokens_after") / window, 6))


def truncate_after(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Without the rows of a session later than its cut (session_id, cut_seq)."""
    return messages.join(cuts, "session_id", "left").filter(F.col("cut_seq").isNull() | (F.col("seq") <= F.col("cut_seq"))).drop("cut_seq")


def edit_and_truncate(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """One user turn of a session rewritten (session_id, edit_seq, new_text), and later rows dropped; an edit of another role is ignored."""
    valid = edits.join(messages.filter("role = 'user'").select("session_id", F.col("seq").alias("edit_seq")), ["session_id", "edit_seq"], "left_semi")
    rows = messages.join(valid, "session_id", "left").filter(F.col("edit_seq").isNull() | (F.col("seq") <= F.col("edit_seq")))
    return rows.withColumn("text", F.when(F.col("seq") == F.col("edit_seq"), F.col("new_text")).otherwise(F.col("text"))).drop("edit_seq", "new_text")


def role_projection(messages: DataFrame, vision: bool = False) -> DataFrame:
    """messages as a model gets them: summaries as system rows, pictures only for a model that sees them."""
    shown = messages.withColumn("role", F.when(F.col("role") == "summary", "system").otherwise(F.col("role")))
    return shown if vision or "images" not in shown.columns else shown.withColumn("images", F.array().cast("array<string>"))


def merge_system(messages: DataFrame, block: str) -> DataFrame:
    """block before the text of each session's first system row, or as a new first row where there is none."""
    of = Window.partitionBy("session_id", "role").orderBy("seq")
    first = (F.col("role") == "system") & (F.row_number().over(of) == 1)
    rows = messages.withColumn("_first", first)
    merged = rows.withColumn("text", F.when(F.col("_first"), F.concat(F.lit(block + "\n\n"), F.col("text"))).otherwise(F.col("text")))
    bare = rows.groupBy("session_id").agg(F.max("_first").alias("any"), F.min("seq").alias("seq")).filter("NOT any")
    return merged.drop("_first").select("session_id", "seq", "role", "text").unionByName(bare.select("session_id", (F.col("seq") - 1).alias("seq"), F.lit("system").alias("role"), F.lit(block).alias("text")))


def last_user_text(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'user'").groupBy("session_id").agg(F.max_by("text", "seq").alias("text"))


def tool_budget(calls: DataFrame, limit: int = 50) -> DataFrame:
    """calls (session_id, turn, n_calls) with allowed: a turn's calls run if fewer than limit ran before; 0 is no limit."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("calls_before", F.coalesce(F.sum("n_calls").over(before), F.lit(0))).withColumn("allowed", (F.lit(limit) == 0) | (F.col("calls_before") < limit))


def checkpoint_marks(rows: DataFrame, every: int = 20) -> DataFrame:
    return rows.withColumn("iteration", F.row_number().over(session_window())).withColumn("checkpoint", F.col("iteration") % every == 0)


def usage_rollup(turns: DataFrame) -> DataFrame:
    """Token sums of a run, attached to its last assistant turn."""
    last = Window.partitionBy("session_id", "role").orderBy(F.col("seq").desc())
    total = Window.partitionBy("session_id")
    at_last = (F.col("role") == "assistant") & (F.row_number().over(last) == 1)
    sums = turns.withColumn("_in", F.sum("tokens_in").over(total)).withColumn("_out", F.sum("tokens_out").over(total)).withColumn("_last", at_last)
    return sums.withColumn("run_in", F.when(F.col("_last"), F.col("_in"))).withColumn("run_out", F.when(F.col("_last"), F.col("_out"))).drop("_in", "_out", "_last")


def pair_tool_results(messages: DataFrame) -> DataFrame:
    """Display rows: each call beside its latest result, results without a call and other rows as themselves.

    messages: session_id, seq, role, text, tool_calls (array of id, name, args), tool_call_id."""
    calls = messages.select("session_id", "seq", F.posexplode("tool_calls").alias("call_no", "call")).select("session_id", "seq", "call_no", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.args").alias("args"))
    results = messages.filter("role = 'tool'").groupBy("session_id", F.col("tool_call_id").alias("call_id")).agg(F.max_by("text", "seq").alias("result"))
    paired = calls.join(results, ["session_id", "call_id"], "left").select("session_id", "seq", "call_no", F.lit("call").alias("kind"), "call_id", "name", F.col("args").alias("text"), "result")
    known = calls.select("session_id", F.col("call_id").alias("tool_call_id")).distinct()
    plain = messages.join(known, ["session_id", "tool_call_id"], "left_anti")
    plain = plain.select("session_id", "seq", F.lit(-1).alias("call_no"), F.col("role").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), "text", F.lit(None).cast("string").alias("result"))
    return plain.unionByName(paired)


def orphan_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    return calls.join(results, ["session_id", "call_id"], "left_anti")


#: Fixed value: what stands between a call and its result in a tool row's text.
RESULT_MARK = "\n─────────\n"


def export_transcript(messages: DataFrame, title: str = "Conversation", thinking: bool = False, tools: bool = False, mark: str = RESULT_MARK) -> DataFrame:
    """One Markdown text a session: system, summary and warning rows left out, blank assistant turns too; thinking and tool rows only where asked for, as details."""
    detail = lambda summary, body: F.concat(F.lit("<details>\n<summary>"), summary, F.lit("</summary>\n\n"), body, F.lit("\n\n</details>"))
    shown = messages.filter(~F.col("role").isin("system", "summary", "warning")).filter((F.col("role") != "assistant") | (F.btrim("text") != ""))
    if not tools:
        shown = shown.filter("role <> 'tool'")
    thought = F.lit("")
    if thinking and "thinking" in messages.columns:
        blank = F.coalesce(F.btrim("thinking"), F.lit("")) == ""
        thought = F.when(blank, "").otherwise(F.concat(detail(F.lit("Thinking"), F.btrim("thinking")), F.lit("\n\n")))
    at = F.locate(mark, F.col("text"))
    call = F.when(at > 0, F.expr("text").substr(F.lit(1), at - 1)).otherwise(F.col("text"))
    result = F.when(at > 0, F.concat(F.lit("\n\n--- result ---\n"), F.btrim(F.col("text").substr(at + len(mark), F.length("text"))))).otherwise("")
    summary = F.concat(F.lit("Tool call: "), F.left(F.btrim(F.regexp_replace(call, r"\s+", " ")), F.lit(80)))
    body = F.concat(F.lit("```\n"), F.btrim(call), result, F.lit("\n```"))
    user = F.concat(F.lit("## User\n\n"), F.coalesce("text", F.lit("")))
    piece = F.when(F.col("role") == "user", user).when(F.col("role") == "tool", detail(summary, body)).otherwise(F.concat(F.lit("## Assistant\n\n"), thought, F.btrim("text")))
    joined = F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("seq", piece.alias("piece")))), lambda x: x["piece"]))
    return shown.groupBy("session_id").agg(F.concat(F.lit(f"# {title}\n\n"), joined).alias("transcript"))
