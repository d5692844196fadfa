"""Column functions over text: counts, windows, titles, parsing of model answers. All of them are built-in expressions.

Lengths are in code points. Null text gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of characters that are not wide: a text without wide ones is one match, not one for each character.
WIDE = "[^　-鿿豈-﫿＀-￯]+"
#: Characters stripped from a title's edges, from a sub-query's start and edges, and the mark of trimmed output.
TITLE_EDGE = "\"'`.,;:!?.,、；；：：!？?「」『』《》【】（）()“”‘’"
NUMBERING = "0123456789.-、)）. "
QUOTES = "\"'“”‘’"
TRIM_HEAD, TRIM_MARK = 1500, "\n...[已省略部分工具输出]..."


def est_tokens(text: Column) -> Column:
    """Wide (CJK, full-width) characters count one each, others a quarter each, rounded down."""
    wide = F.length(F.regexp_replace(text, WIDE, ""))
    return (wide + F.floor((F.length(text) - wide) / 4)).cast("long")


def est_tokens_float(text: Column) -> Column:
    """As est_tokens, without the rounding."""
    wide = F.length(F.regexp_replace(text, WIDE, ""))
    return wide + (F.length(text) - wide) / 4


def est_message_tokens(content: Column, tool_calls: Column, images: Column) -> Column:
    """Content, the arguments of its calls, and a token for each 750 bytes of image addresses."""
    calls = F.aggregate(F.coalesce(tool_calls, F.array()), F.lit(0).cast("long"), lambda total, c: total + F.coalesce(est_tokens(c["args"]), F.lit(0)))
    size = F.aggregate(F.coalesce(images, F.array()), F.lit(0).cast("long"), lambda total, u: total + F.coalesce(F.octet_length(u), F.lit(0)))
    return F.coalesce(est_tokens(content), F.lit(0)) + calls + F.floor(size / 750)


def fixed_windows(text: Column, size: int) -> Column:
    """Windows of size characters that do not overlap."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def stable_display_id(message_id: Column, call_id: Column) -> Column:
    return F.left(F.sha1(F.concat(message_id, F.lit(":"), call_id).cast("binary")), F.lit(16))


def sanitize_title(text: Column, limit: int = 20) -> Column:
    """Without surrounding quotes and marks, white space and line breaks collapsed, cut to limit."""
    bare = F.btrim(F.btrim(text, F.lit(" \t\r\n")), F.lit(TITLE_EDGE))
    return F.left(F.btrim(F.regexp_replace(bare, r"\s+", " ")), F.lit(limit))


def fallback_title(text: Column, limit: int = 20) -> Column:
    """The first line of a message as its title."""
    return sanitize_title(F.get(F.split(F.btrim(text, F.lit(" \t\r\n")), "[\n\r]"), F.lit(0)), limit)


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def trim_tool_output(text: Column, head: int = TRIM_HEAD, mark: str = TRIM_MARK) -> Column:
    return truncate(text, head, mark)


def parse_qa_lines(answer: Column) -> Column:
    """question and answer of each line with a bar, split at the first; blank sides drop the line."""
    lines = F.transform(F.split(answer, "\n"), lambda line: F.when(F.locate("|", line) > 0, F.struct(F.btrim(F.substring_index(line, "|", 1)).alias("question"), F.btrim(F.substring(line, F.locate("|", line) + 1, F.length(line))).alias("answer"))))
    return F.filter(lines, lambda p: p.isNotNull() & (p["question"] != "") & (p["answer"] != ""))


def parse_subqueries(answer: Column, query: Column, most: int = 2) -> Column:
    """The first lines of a model's answer that are new queries: numbering and quotes stripped, short and repeated ones dropped."""
    bare = F.transform(F.split(answer, "\n"), lambda line: F.btrim(F.btrim(F.ltrim(F.btrim(line, F.lit(" \t\r")), F.lit(NUMBERING)), F.lit(QUOTES))))
    new = F.filter(bare, lambda s: (F.length(s) >= 2) & (s != query))
    return F.slice(F.array_distinct(new), 1, most)


TOOL_CALLS = "array<struct<id:string,name:string,args:string>>"


def parse_tool_calls(text: Column) -> Column:
    """Calls of a JSON list; an empty array where it can't be read."""
    return F.coalesce(F.from_json(text, TOOL_CALLS), F.array().cast(TOOL_CALLS))


def parse_images(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def display_tool_args(args: Column) -> Column:
    """Top-level keys in order, nested values as text; what is no JSON object stays as it is."""
    read = F.from_json(args, "map<string,string>")
    parts = F.transform(F.array_sort(F.map_keys(read)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(": "), F.to_json(F.array(F.element_at(read, k))).substr(F.lit(2), F.length(F.to_json(F.array(F.element_at(read, k)))) - 2)))
    return F.when(F.try_parse_json(args).isNull() | ~F.btrim(args).startswith("{"), args).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", parts), F.lit("}")))


def repair_tool_args(args: Column, schema: str) -> Column:
    """JSON whose strings hold raw control characters."""
    return F.from_json(args, schema, {"allowUnquotedControlChars": "true"})


def command_family(command: Column) -> Column:
    """The first two words; null where there are fewer."""
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, 1, 2)))


def path_escapes(relative: Column) -> Column:
    """Whether a relative path leaves its root on the way."""
    steps = F.transform(F.filter(F.split(relative, "/"), lambda s: ~s.isin("", ".")), lambda s: F.when(s == "..", -1).otherwise(1))
    lowest = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.least(a["low"], a["at"] + s).alias("low")))
    return relative.startswith("/") | (lowest["low"] < 0)


def read_lines(text: Column, offset: int, limit: int) -> Column:
    """Lines from the offset-th on, numbered from 1; an offset of 0 or beyond the text is ignored, as is a limit of 0."""
    lines = F.split(text, "\n")
    start = F.when((F.lit(offset) > 0) & (F.lit(offset) <= F.size(lines)), F.lit(offset)).otherwise(1)
    return F.transform(F.slice(lines, start, F.lit(limit) if limit > 0 else F.size(lines)), lambda line, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("\t"), line))


def clean_options(options: Column) -> Column:
    """Trimmed, without blanks and repetitions."""
    return F.array_distinct(F.filter(F.transform(options, lambda o: F.btrim(o)), lambda o: o != ""))


def options_valid(options: Column) -> Column:
    return F.size(options).between(2, 4) & (F.size(clean_options(options)) >= 2)


def index_name(kb_id: Column, prefix: str = "vec_") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(kb_id), "[^a-z0-9]", "_"))


def short_time(ts: Column, today: str) -> Column:
    at = F.try_to_timestamp(ts.cast("string"))
    return F.when(at.isNull(), "").when(F.to_date(at) == F.lit(today).cast("date"), F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "MM-dd HH:mm"))


def subtask_result(text: Column, limit: int = 8000, empty: str = "(no output)") -> Column:
    return truncate(F.coalesce(F.nullif(F.btrim(text), F.lit("")), F.lit(empty)), limit)


def normalize_fragments(text: Column) -> Column:
    """Lines of a paragraph joined: with a space only between two ASCII letters; blank runs collapsed, empty lines dropped."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n")

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
        return F.aggregate(lines, F.lit(""), lambda done, x: F.when(done == "", x).otherwise(F.concat(done, F.when(F.right(done, F.lit(1)).rlike("[A-Za-z]") & F.left(x, F.lit(1)).rlike("[A-Za-z]"), " ").otherwise(""), x)))

    return F.concat_ws("\n\n", F.filter(F.transform(F.split(unix, "\n\n"), paragraph), lambda p: p != ""))


def table_cell(cell: Column) -> Column:
    return F.btrim(F.replace(F.regexp_replace(F.coalesce(cell, F.lit("")), "[\r\n]", " "), F.lit("|"), F.lit("\\|")))


def sniff_mime(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").otherwise("image/png")


def route_parser(mime: Column, filename: Column) -> Column:
    """docx, xlsx, pdf, md or txt. Office and PDF endings in any case, the others as written."""
    low = F.lower(filename)
    return (
        F.when(mime.contains("wordprocessingml") | low.endswith(".docx"), "docx")
        .when(mime.contains("spreadsheetml") | low.endswith(".xlsx"), "xlsx")
        .when((mime == "application/pdf") | low.endswith(".pdf"), "pdf")
        .when((mime == "text/markdown") | filename.endswith(".md"), "md")
        .otherwise("txt")
    )
