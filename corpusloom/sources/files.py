"""File sources: text corpora, office documents, trees, snippets, headed notes. All read through Spark's binaryFile source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import path_escapes, sniff_mime, table_cell

#: Folders that no listing enters, and languages by file ending.
EXCLUDED = (".git", "node_modules", "dist", "build", "target", "vendor", ".next", ".idea", ".vscode")
LANGUAGES = {
    "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "vue": "vue",
    "py": "python", "java": "java", "kt": "kotlin", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sh": "bash", "bash": "bash", "zsh": "bash", "sql": "sql",
    "html": "html", "css": "css", "scss": "scss", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "xml": "xml", "md": "markdown", "svelte": "svelte", "lua": "lua", "proto": "proto", "gradle": "groovy", "dockerfile": "dockerfile",
}
MAX_FILES, MAX_BYTES, PROBE = 2000, 262_144, 1024


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes replacement marks, so one odd file fails no job."""
    return F.make_valid_utf8(content.cast("string"))


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path).select("path", "modificationTime", text_of(F.col("content")).alias("text"))


def docx_rows(content: bytes) -> tuple[str, list[dict], str | None]:
    """Text in document order with tables as Markdown and NUL-wrapped image marks; the images; an error for an empty document."""
    import io
    import zipfile
    from xml.etree import ElementTree

    word, drawing = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    related = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    images: list[dict] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{word}body")
            names = z.namelist()
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in names else {}

            def inline(element) -> str:
                out = []
                for node in element.iter():
                    if node.tag == f"{word}t":
                        out.append(node.text or "")
                    elif node.tag in (f"{word}tab", f"{word}br"):
                        out.append("\t" if node.tag.endswith("tab") else "\n")
                    elif node.tag == f"{drawing}blip" and (target := rels.get(node.get(f"{related}embed"))) and f"word/{target}" in names:
                        out.append(f"\0IMG:{len(images)}\0")
                        images.append({"idx": len(images), "data": z.read(f"word/{target}")})
                return "".join(out)

            lines = []
            for child in body if body is not None else ():
                if child.tag == f"{word}p":
                    lines.append(inline(child))
                elif child.tag == f"{word}tbl":
                    lines.append(markdown_rows([[inline(c) for c in row.iter(f"{word}tc")] for row in child.iter(f"{word}tr")]))
            text = "\n".join(line for line in lines if line.strip())
    except Exception as e:  # a broken file is a row with an error, not a lost job
        return "", [], f"{type(e).__name__}: {e}"
    return text, images, None if text or images else "no text and no images"


def markdown_rows(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    clean = [[c.replace("\r", " ").replace("\n", " ").replace("|", "\\|").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def extract_docx(files: DataFrame) -> DataFrame:
    """path, text, images, error of each document (files: path, content)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [docx_rows(c) for c in p["content"]]
            yield pd.DataFrame({"path": p["path"], "text": [r[0] for r in rows], "images": [r[1] for r in rows], "error": [r[2] for r in rows]})

    found = files.select("path", "content").mapInPandas(read, "path string, text string, images array<struct<idx:int,data:binary>>, error string")
    return found.withColumn("images", F.transform("images", lambda i: F.struct(i["idx"].alias("idx"), i["data"].alias("data"), sniff_mime(i["data"]).alias("mime"))))


def extract_xlsx(files: DataFrame) -> DataFrame:
    """path, sheet, sheet_no, row_no, cells of each row that isn't empty, and error; a file that can't be read is one row with its error."""

    def sheets(content: bytes):
        import io
        import zipfile
        from xml.etree import ElementTree

        main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        related = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for no, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")):
                target = rels[sheet.get(f"{related}id")].lstrip("/").removeprefix("xl/")
                for row_no, row in enumerate(ElementTree.fromstring(z.read(f"xl/{target}")).iter(f"{main}row")):
                    cells: list[str] = []
                    for cell in row.iter(f"{main}c"):
                        at = 0
                        for letter in (x for x in cell.get("r", "") if x.isalpha()):
                            at = at * 26 + ord(letter) - 64
                        cells += [""] * (at - 1 - len(cells))
                        value, inline = cell.find(f"{main}v"), cell.find(f"{main}is")
                        text = "".join(t.text or "" for t in inline.iter(f"{main}t")) if inline is not None else (value.text or "") if value is not None else ""
                        cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
                    if any(c.strip() for c in cells):
                        yield sheet.get("name"), no, row_no, cells

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    out += [(path, *row, None) for row in list(sheets(content))]
                except Exception as e:  # a broken file is a row with an error, not a lost job
                    out.append((path, None, 0, 0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sheet", "sheet_no", "row_no", "cells", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, sheet_no int, row_no int, cells array<string>, error string")


def markdown_table(rows: DataFrame) -> DataFrame:
    """path and text: each sheet as a Markdown table, with its name as a heading where there are several."""
    rows = rows.filter("error IS NULL") if "error" in rows.columns else rows
    of_sheet, of_path = Window.partitionBy("path", "sheet_no"), Window.partitionBy("path")
    wide = rows.withColumn("width", F.max(F.size("cells")).over(of_sheet)).withColumn("first", F.min("row_no").over(of_sheet)).withColumn("sheets", F.max("sheet_no").over(of_path) - F.min("sheet_no").over(of_path) + 1)
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: table_cell(F.get("cells", i)))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cells), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width")))
    head = F.when(F.col("sheets") > 1, F.concat(F.lit("# "), F.col("sheet"), F.lit("\n\n"))).otherwise("")
    shown = wide.withColumn("line", F.when(F.col("row_no") == F.col("first"), F.concat(head, line, rule)).otherwise(line))
    tables = shown.groupBy("path", "sheet_no").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"])).alias("table"))
    return tables.groupBy("path").agg(F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "table"))), lambda x: x["table"])).alias("text"))


def fill_placeholders(texts: DataFrame, described: DataFrame) -> DataFrame:
    """texts (doc_id, text) with image marks replaced by their description blocks, or nothing. described: doc_id, idx, description."""
    parts = F.split("text", "\0")
    pieces = texts.select("doc_id", F.posexplode(parts).alias("pos", "piece")).withColumn("idx", F.when(F.col("piece").rlike(r"^IMG:\d+$"), F.substring("piece", 5, 12).cast("int")))
    joined = pieces.join(described, ["doc_id", "idx"], "left")
    blank = F.coalesce(F.col("description"), F.lit("")) == ""
    shown = F.when(F.col("idx").isNull(), F.col("piece")).when(blank, "").otherwise(F.concat(F.lit("\n[image: "), F.col("description"), F.lit("]\n")))
    return joined.groupBy("doc_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", shown.alias("shown")))), lambda x: x["shown"])).alias("text"))


def is_binary(content: Column) -> Column:
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, PROBE)), "(..)", "$1 ")) > 0


def scan_tree(files: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """Paths and lengths of text files outside the excluded folders, in order; the limit is the feature of a listing."""
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED)))
    return files.filter(~inside & ~is_binary(F.col("content"))).select("path", "length").orderBy("path").limit(limit)


def readable_size(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).when(size < 1 << 20, F.concat(F.format_number(size / 1024, 1), F.lit("KB"))).otherwise(F.concat(F.format_number(size / (1 << 20), 1), F.lit("MB")))


def file_snippets(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """path, language, size, binary and a snippet capped at limit bytes with a mark."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    binary = is_binary(F.col("content"))
    # A character that the limit cuts is left out.
    head = text_of(F.substring("content", 1, limit))
    cut = F.concat(F.when(F.col("length") > limit, F.regexp_replace(head, "\ufffd+$", "")).otherwise(head), F.when(F.col("length") > limit, "\n… [truncated]").otherwise(""))
    return files.select("path", F.coalesce(F.element_at(names, ending), F.lit("")).alias("language"), readable_size(F.col("length")).alias("size"), binary.alias("binary"), F.when(~binary, cut).alias("snippet"))


def attachment_block(requests: DataFrame, snippets: DataFrame, root: str, limit: int = MAX_FILES) -> DataFrame:
    """One text for requests (no, path below root): a header and a snippet for each file, a list of its files for each folder; paths that
    escape or aren't there are noted. The requests are one turn's, so one text is their result."""
    below = F.expr("path").substr(F.locate(root.rstrip("/") + "/", F.col("path")) + len(root.rstrip("/")) + 1, F.length("path"))
    files = snippets.filter(F.contains("path", F.lit(root.rstrip("/") + "/"))).withColumn("rel", below).drop("path")
    parts = F.split("rel", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    asked = requests.withColumn("rel", F.regexp_replace(F.regexp_replace("path", r"^(\./)+|/+$", ""), r"^\.$", ""))
    listed = asked.join(files.select(F.explode(above).alias("rel"), F.col("rel").alias("file")), "rel").groupBy("no").agg(F.array_join(F.slice(F.sort_array(F.collect_list("file")), 1, limit), "\n").alias("files"))
    joined = asked.join(files, "rel", "left").join(listed, "no", "left")
    text = F.when(F.col("binary"), "[binary file]").otherwise(F.concat(F.lit("```"), F.col("language"), F.lit("\n"), F.col("snippet"), F.lit("\n```")))
    body = F.when(path_escapes(F.col("path")), "[path is outside the folder]").when(F.col("binary").isNotNull(), text).when(F.col("files").isNotNull(), F.col("files")).otherwise("[not found]")
    piece = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), body)
    return joined.agg(F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("no", piece.alias("piece")))), lambda x: x["piece"])).alias("block"))


HEAD = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z"


def frontmatter(texts: DataFrame) -> DataFrame:
    """texts with fields (a map of the header's lines) and body; those without a header drop out."""
    lines = F.filter(F.split(F.regexp_extract("text", HEAD, 1), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.btrim(F.substring(x, F.locate(":", x) + 1, F.length(x)))
    bare = lambda v: F.when(v.rlike('^".*"$'), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r'\\(["\\])', "$1")).when(v.rlike("^'.*'$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    entries = F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), bare(value(x)).alias("v")))
    last = F.filter(entries, lambda e: e["k"] != "")
    fields = F.aggregate(last, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return texts.filter(F.col("text").rlike(HEAD)).withColumn("fields", fields).withColumn("body", F.regexp_extract("text", HEAD, 2))


def frontmatter_catalog(files: DataFrame) -> DataFrame:
    """name, description, type, body, updated_at of notes with a valid header and name, newest first."""
    texts = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select("path", "modificationTime", text_of(F.col("content")).alias("text"))
    field = lambda k: F.element_at("fields", F.lit(k))
    found = frontmatter(texts).select(field("name").alias("name"), field("description").alias("description"), field("type").alias("type"), "body", F.col("modificationTime").alias("updated_at"))
    return found.filter(F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length("name") <= 64)).orderBy(F.col("updated_at").desc(), "name")


def skill_catalog(roots: list[tuple[str, DataFrame]], disabled: DataFrame) -> DataFrame:
    """id (source:folder), name, description, source, enabled of each SKILL.md; of equal ids the first root's stays."""
    out = None
    for no, (source, files) in enumerate(roots):
        texts = files.filter(F.endswith("path", F.lit("/SKILL.md"))).select("path", text_of(F.col("content")).alias("text"))
        folder = F.element_at(F.split("path", "/"), -2)
        rows = frontmatter(texts).select(F.concat(F.lit(source + ":"), folder).alias("id"), F.coalesce(F.element_at("fields", F.lit("name")), folder).alias("name"), F.element_at("fields", F.lit("description")).alias("description"), F.lit(source).alias("source"), F.lit(no).alias("_no"), "path")
        out = rows if out is None else out.unionByName(rows)
    first = out.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_no", "path"))).filter("_n = 1").drop("_n", "_no")
    return first.join(disabled.select("id", F.lit(True).alias("_off")), "id", "left").withColumn("enabled", F.col("_off").isNull()).drop("_off").orderBy("source", "name")


def append_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)
