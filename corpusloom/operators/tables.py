"""Corpus status, dedup by content, caches, keyed updates and other maintenance of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("ready", "processing", "failed", "duplicate", "paused")


def docs_per_kb(kbs: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of every status, and 0 for a base without any."""
    return kbs.join(docs.groupBy("kb_id").agg(F.count("*").alias("n")), "kb_id", "left").select("kb_id", F.coalesce("n", F.lit(0)).alias("doc_count"))


def status_summary(docs: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return docs.groupBy("kb_id").agg(*counts, F.count_if(~F.col("status").isin(*STATUSES)).alias("other"))


def ingest_progress(docs: DataFrame) -> DataFrame:
    done, total = F.sum("chunk_done"), F.sum("chunk_total")
    return docs.groupBy("kb_id").agg(done.alias("done"), total.alias("total"), F.round(F.when(total > 0, done * 100.0 / total).otherwise(0.0), 6).alias("percent"))


def find_duplicates(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """docs (kb_id, doc_id, content_hash, status, created) with duplicate_of: the first ready document of the same base and hash, if that is another one.

    existing: the stored documents with the same columns; theirs come before any of docs."""
    columns = ["kb_id", "doc_id", "content_hash", "status", "created"]
    pool = docs.select(*columns, F.lit(1).alias("age"))
    pool = pool if existing is None else pool.unionByName(existing.select(*columns, F.lit(0).alias("age")))
    ready = pool.filter("status = 'ready'").groupBy("kb_id", "content_hash").agg(F.min(F.struct("age", "created", "doc_id")).alias("first"))
    joined = docs.join(ready, ["kb_id", "content_hash"], "left")
    return joined.withColumn("duplicate_of", F.when(F.col("first.doc_id") != F.col("doc_id"), F.col("first.doc_id"))).drop("first")


def processing_docs(docs: DataFrame) -> DataFrame:
    """What to resume: documents in processing, or failed where the raw file is missing."""
    missing = F.coalesce(F.col("raw_path"), F.lit("")) == ""
    return docs.filter("status = 'processing'").withColumn("status", F.when(missing, "failed").otherwise(F.col("status"))).withColumn("error", F.when(missing, "raw file is missing"))


def ordered_listing(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """rows with their place (from 1) in the listing of their key; chunks are listed with a limit, other things whole."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def text_filter(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term in one of the columns, in any case; a blank term keeps all."""
    if not term.strip():
        return rows
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(term.strip())))
    return rows.filter(test)


def usable_cache(cache: DataFrame) -> DataFrame:
    return cache.filter(F.size("embedding") > 0)


def cache_hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.filter("coalesce(model, '') <> ''").join(usable_cache(cache), ["model", "text_hash"], "left_semi")


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """An empty model is never cached; entries without a vector are misses."""
    known = usable_cache(cache).filter("model <> ''").select("model", "text_hash")
    return wanted.join(known, ["model", "text_hash"], "left_anti")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """existing and those of new whose key it hasn't; the first of equal new keys in the given order."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def upsert(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: order ranks the winner first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def exclude(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """parents without the gone keys, and each child table (name: rows, its foreign key) without theirs."""
    out = {"parents": exclude(parents, gone, [key])}
    for name, (rows, foreign) in children.items():
        out[name] = rows.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")
    return out


def delete_provider(tables: dict[str, tuple[DataFrame, list[str]]], providers: DataFrame, value, key: str = "provider_id") -> dict[str, DataFrame]:
    """providers without the one, and each table (name: rows, its columns that refer to providers) with those references cleared."""
    out = {name: null_out(rows, columns, value) for name, (rows, columns) in tables.items()}
    return out | {"providers": providers.filter(F.col(key) != value)}


def null_out(rows: DataFrame, columns: list[str], value) -> DataFrame:
    """References to value cleared."""
    return rows.withColumns({c: F.when(F.col(c) == value, None).otherwise(F.col(c)) for c in columns})


def set_exclusive_default(rows: DataFrame, chosen, kind: str, key: str = "provider_id") -> DataFrame:
    return rows.withColumn("is_default", F.when(F.col("kind") == kind, F.col(key) == chosen).otherwise(F.col("is_default")))


def default_by_kind(rows: DataFrame, key: str = "provider_id") -> DataFrame:
    """One flagged row of each kind; a blank kind is chat."""
    kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("chat"))
    flagged = rows.withColumn("kind", kind).filter("is_default")
    return flagged.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(key))).filter("_n = 1").drop("_n")


def resolve_provider(bases: DataFrame, providers: DataFrame, kind: str = "embed") -> DataFrame:
    """kb_id and provider_id: the base's own provider where it has a model, else the default of that kind."""
    own = providers.filter(F.coalesce(F.col("model"), F.lit("")) != "").select(F.col("provider_id").alias("_own"))
    fallback = default_by_kind(providers).filter(F.col("kind") == kind).select(F.col("provider_id").alias("_default"), F.lit(1).alias("_one"))
    # One row at most.
    joined = bases.join(own, F.col("provider_id") == F.col("_own"), "left").withColumn("_one", F.lit(1)).join(F.broadcast(fallback), "_one", "left")
    return joined.select("kb_id", F.coalesce("_own", "_default").alias("provider_id"))


def resolve_chat_provider(requests: DataFrame, sessions: DataFrame, providers: DataFrame) -> DataFrame:
    """requests (request_id, session_id, override) with provider_id: the request's own provider, else its session's, else the default for chats; one that isn't there counts as none."""
    known = providers.select("provider_id")
    fallback = default_by_kind(providers).filter("kind = 'chat'").select(F.col("provider_id").alias("_default"), F.lit(1).alias("_one"))
    asked = requests.join(sessions.select("session_id", F.col("provider_id").alias("_session")), "session_id", "left")
    for column in ("override", "_session"):
        asked = asked.join(known.withColumnRenamed("provider_id", f"_known_{column}"), F.col(column) == F.col(f"_known_{column}"), "left")
    asked = asked.withColumn("_one", F.lit(1)).join(F.broadcast(fallback), "_one", "left")
    return asked.select("request_id", "session_id", F.coalesce("_known_override", "_known__session", "_default").alias("provider_id"))


def add_missing_columns(rows: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns of spec (name: type, default) that rows hasn't got."""
    return rows.withColumns({c: F.lit(v).cast(t) for c, (t, v) in spec.items() if c not in rows.columns})


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, nulls_clear: bool = False) -> DataFrame:
    """Values of updates (each key once) over those of rows; a null keeps the old value, or clears it with nulls_clear."""
    changed = [c for c in updates.columns if c != key]
    renamed = updates.select(key, F.struct(*changed).alias("_new")) if changed else updates.select(key)
    joined = rows.join(renamed, key, "left")
    given = lambda c: F.col("_new").isNotNull() if nulls_clear else F.col(f"_new.{c}").isNotNull()
    return joined.withColumns({c: F.when(given(c), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in changed}).drop("_new")


def source_rollup(rows: DataFrame, column: str = "source") -> DataFrame:
    """Counts of each source and of all."""
    return rows.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col(column)).alias(column), "n")


def grep(texts: DataFrame, pattern: str, key: str = "path") -> DataFrame:
    """key, line number from 1 and line, of each line that holds the pattern."""
    lines = texts.select(key, F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return lines.filter(F.contains("line", F.lit(pattern))).select(key, (F.col("at") + 1).alias("line_no"), "line")


def match_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls (call_id, tool, key, args) with the first rule that fits: same tool, and equal key or, for rules without one, a pattern that args holds."""
    fits = (F.col("match_key") == F.col("key")) | ((F.coalesce(F.col("match_key"), F.lit("")) == "") & ((F.coalesce(F.col("pattern"), F.lit("")) == "") | F.contains("args", "pattern")))
    joined = calls.join(rules, "tool").filter(fits)
    return joined.groupBy("call_id").agg(F.min("rule_seq").alias("rule_seq"))


def outside_whitelist(calls: DataFrame, allowed: DataFrame) -> DataFrame:
    return calls.join(allowed, ["role", "tool"], "left_anti")


#: Tools that change files, and parts of the names of tools that read pictures.
WRITING_TOOLS = ("file_write", "file_edit")
PICTURE_TOOLS = ("screenshot", "ocr", "extract_text", "image_to_text", "describe_image")


def hidden_tools(tools: DataFrame) -> DataFrame:
    """tools (tool, plan_mode, vision, has_images) with hidden: plan mode shows none that writes, a model that sees the turn's pictures none that reads them."""
    reads = F.lit(False)
    for part in PICTURE_TOOLS:
        reads = reads | F.contains(F.lower("tool"), F.lit(part))
    return tools.withColumn("hidden", (F.col("plan_mode") & F.col("tool").isin(*WRITING_TOOLS)) | (F.col("vision") & F.col("has_images") & reads))


def unblocked_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks whose blockers are all completed; a blocker that isn't there counts as not completed."""
    edges = tasks.select("session_id", "id", F.explode("blocked_by").alias("blocker"))
    state = tasks.select("session_id", F.col("id").alias("blocker"), F.col("status").alias("blocker_status"))
    blocked = edges.join(state, ["session_id", "blocker"], "left").filter(~F.col("blocker_status").eqNullSafe(F.lit("completed")))
    return tasks.join(blocked.select("session_id", "id").distinct(), ["session_id", "id"], "left_anti")


def task_board(tasks: DataFrame) -> DataFrame:
    """Of each session the totals by status and one text of its tasks, running ones first."""
    order = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1).otherwise(2)
    line = F.concat(F.lit("["), F.when(F.col("status") == "completed", "x").when(F.col("status") == "in_progress", ">").otherwise(" "), F.lit("] #"), F.col("id").cast("string"), F.lit(" "), F.col("subject"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "completed")]
    return tasks.groupBy("session_id").agg(*counts, F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "id", line.alias("line")))), lambda x: x["line"])).alias("board"))


def list_level(paths: DataFrame, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """name and is_dir of what lies directly in a folder; folders come first."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = paths.filter(F.startswith("path", F.lit(prefix))).select(F.expr(f"substring(path, {len(prefix) + 1})").alias("rest"))
    level = rest.select(F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("is_dir")).distinct()
    return level.filter(~(F.col("is_dir") & F.col("name").isin(*excluded)) & (F.col("name") != "")).orderBy(F.col("is_dir").desc(), "name")


def catalog_index(entries: DataFrame, header: str, footer: str = "") -> DataFrame:
    """One text with a line for each entry (name, description); empty without entries."""
    lines = entries.agg(F.sort_array(F.collect_list(F.struct("name", "description"))).alias("all"))
    body = F.concat_ws("\n", F.transform("all", lambda e: F.concat(F.lit("- "), e["name"], F.lit(": "), e["description"])))
    return lines.select(F.when(F.size("all") == 0, "").otherwise(F.concat(F.lit(header + "\n"), body, F.lit("\n" + footer if footer else ""))).alias("index"))


def layered_rules(sections: DataFrame) -> DataFrame:
    """One text of the enabled sections that aren't blank, by priority."""
    kept = sections.filter("enabled").filter(F.btrim("body") != "")
    return kept.agg(F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("priority", F.btrim("body").alias("body")))), lambda s: s["body"])).alias("rules"))


def validate_rules(rules: DataFrame, most: int = 65_536) -> DataFrame:
    """rules (content: bytes) with reason: null for texts of at most so many bytes that are UTF-8."""
    return rules.withColumn("reason", F.when(F.octet_length("content") > most, "size").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding"))


def merge_unique(a: Column, b: Column) -> Column:
    """The ids of a, then those of b that a hasn't got, each once."""
    return F.array_union(a, b)


def grouped(rows: DataFrame, key: str, item: str, first: str | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """rows with group_no and place: groups in order (first comes first, blank keys last, others by name), items by id within a group.

    known: the keys that count; rows of others drop out. Rows stay rows, so a group may be of any size."""
    kept = rows.filter(F.col(key).isin(*known)) if known else rows
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    rank = F.when(F.col(key).eqNullSafe(F.lit(first)) & ~blank, 0).when(~blank, 1).otherwise(2)
    keys = kept.select(F.col(key).alias("_key"), rank.alias("_rank")).distinct().withColumn("group_no", F.row_number().over(Window.orderBy("_rank", "_key")))
    numbered = kept.join(keys, F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "_rank")
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("group_no").orderBy(item)))


def menu_filter(entries: DataFrame, term: str, skills: bool = False) -> DataFrame:
    """Entries whose name holds the term in any case; the menu of skills leaves global ones out."""
    found = text_filter(entries, term, ["name"])
    return found.filter("source <> 'global'") if skills else found


def validate_entries(entries: DataFrame) -> DataFrame:
    """entries (name, type, description, body) with reason: null for valid ones."""
    reason = (
        F.when(~F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") | (F.length("name") > 64), "name")
        .when(~F.col("type").isin("user", "feedback", "project", "reference"), "type")
        .when(F.length("description") > 200, "description")
        .when(F.octet_length("body") > 8192, "body")
    )
    return entries.withColumn("reason", reason)
