"""Raw records to session records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_ms
from ..functions.text import basename, none_if_empty, preview, truncate, word_pattern
from .graph import written
from ..schema import MIN_PROJECT_NAME, PROJECT_DENYLIST, PROJECT_KEYWORDS, UNTITLED


def project_patterns(names: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(id, pattern) of the projects whose names are specific enough, in their order."""
    kept = [(i, n.strip()) for i, n in names if n and len(n.strip()) >= MIN_PROJECT_NAME and n.strip().lower() not in PROJECT_DENYLIST]
    return [(n, word_pattern(n)) for _, n in kept]


def match_project(title: Column, summary: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first project whose name stands in the title; if none, in the summary."""
    tries = [(c, name, p) for c in (title, summary) for name, p in patterns]
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for c, name, p in tries]) if tries else F.lit(None).cast("string")


def _word_tokens(c: Column) -> Column:
    """Runs of ASCII word characters, and every other character but white space, in lower case. A name that stands between word boundaries of a text has its tokens in a row there."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+|[^a-z0-9_\s]"), 0)


def _pattern_of(name: Column) -> Column:
    """word_pattern() of a column."""
    word = "[A-Za-z0-9_]"
    lead = F.when(name.rlike(f"^{word}"), f"(?<!{word})").otherwise(f"(?<={word})")
    tail = F.when(name.rlike(f"{word}$"), f"(?!{word})").otherwise(f"(?={word})")
    literal = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit("(?iu)"), lead, literal, tail)


def match_projects(sessions: DataFrame, projects: DataFrame, title: str = "title", summary: str = "summary") -> DataFrame:
    """Sessions with ``project``: the first of ``projects`` (name, pos) by pos whose name stands in the title; if none, in the summary.

    What match_project() says for a list at hand, for any number of names: names are joined with the token runs of texts
    of their lengths, and the pairs found are held against the name itself. Each distinct text is looked at once.
    """
    name = F.btrim("name", F.lit(" \t\n\r\f\x0b\u00a0"))
    kept = projects.select(name.alias("name"), "pos").where((F.char_length("name") >= MIN_PROJECT_NAME) & ~F.lower("name").isin(*PROJECT_DENYLIST))
    named = kept.groupBy("name").agg(F.min("pos").alias("pos")).select("name", "pos", _pattern_of(F.col("name")).alias("pattern"), _word_tokens(F.col("name")).alias("t"))
    named = written(named.select("name", "pos", "pattern", F.size("t").alias("n"), F.array_join("t", " ").alias("run")))
    lengths = sorted(r["n"] for r in named.select("n").distinct().collect())  # lengths, not names
    texts = sessions.select(F.col(title).alias("text")).unionByName(sessions.select(F.col(summary).alias("text"))).where("text <> ''").distinct()
    t = F.col("t")
    runs = F.flatten(F.transform(F.filter(F.array(*map(F.lit, lengths or [1])), lambda n: n <= F.size(t)), lambda n: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))))
    found = texts.withColumn("t", _word_tokens(F.col("text"))).select("text", F.explode(F.array_distinct(runs)).alias("run")).join(named, "run").where(F.expr("text rlike pattern"))
    best = found.groupBy("text").agg(F.min_by("name", "pos").alias("name"))
    by = lambda column, out: best.select(F.col("text").alias(column), F.col("name").alias(out))
    df = sessions.join(by(title, "_t"), title, "left").join(by(summary, "_s"), summary, "left")
    return df.withColumn("project", F.coalesce("_t", "_s")).drop("_t", "_s")


def infer_project(project: Column, cwd: Column, title: Column, keywords=PROJECT_KEYWORDS) -> Column:
    """struct(id, inference_source): the field, else the directory's name, else a keyword of the title."""
    of = lambda c, how: F.when(c.isNotNull(), F.struct(c.alias("id"), F.lit(how).alias("inference_source")))
    word = F.coalesce(*[F.when(title.rlike(rf"(?iu)(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), F.lit(i)) for i, p in keywords]) if keywords else F.lit(None).cast("string")
    return F.coalesce(of(none_if_empty(project), "project_field"), of(basename(cwd), "cwd_basename"), of(word, "title_keyword"))


def overlay_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Semantic labels (id, label): '~' labels become the topic, others the project where there is none."""
    df = sessions.join(labels.select("id", "label"), "id", "left")
    emergent = F.startswith(F.col("label"), F.lit("~"))
    empty = F.coalesce("project", F.lit("")) == ""
    return df.withColumn("topic", F.when(emergent, F.col("label")).otherwise(F.col("topic"))).withColumn("project", F.when(empty & ~emergent, F.coalesce("label", "project")).otherwise(F.col("project"))).drop("label")


def turn_counts(messages: DataFrame, key: str = "id") -> DataFrame:
    """Messages (key, pos, sender, text): turns by sender, and the first human text by both rules: the first that isn't empty, and that of the first human message alone."""
    human, text = F.col("sender") == "human", none_if_empty(F.col("text"))
    return messages.groupBy(key).agg(
        F.count_if(human).alias("user_turns"), F.count_if(F.col("sender") == "assistant").alias("assistant_turns"),
        F.min_by(F.when(human, text), F.when(human & text.isNotNull(), F.col("pos"))).alias("first_human_text"), F.min_by(F.when(human, text), F.when(human, F.col("pos"))).alias("first_message_text"),
    )


def title_cascade(ai_title: Column, last_prompt: Column, first_text: Column) -> tuple[Column, Column]:
    """(title, title_source); the last two are squeezed and cut to 80."""
    prompt, first = none_if_empty(truncate(last_prompt, 80)), none_if_empty(truncate(first_text, 80))
    source = F.when(none_if_empty(ai_title).isNotNull(), "ai-title").when(prompt.isNotNull(), "last-prompt").when(first.isNotNull(), "first-prompt").otherwise("fallback")
    return F.coalesce(none_if_empty(ai_title), prompt, first, F.lit(UNTITLED)), source


def from_conversations(conversations: DataFrame, patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """Exported conversations to sessions; those without readable times are left out (skipped() counts them).

    Messages are folded inside their row with array functions: no explode, no shuffle.
    """
    human = F.filter("chat_messages", lambda m: m["sender"] == "human")
    block = lambda m: F.get(F.filter(m["content"], lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), F.lit(0))["text"]
    texts = F.filter(F.transform(human, lambda m: F.coalesce(block(m), none_if_empty(m["text"]))), lambda x: x.isNotNull())
    blocks = lambda m: F.transform(F.filter(m["content"], lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"])
    flat = lambda m: F.when(F.length(m["text"]) > 0, F.array(m["text"])).otherwise(F.array().cast("array<string>"))
    every = F.flatten(F.transform(human, lambda m: F.when(F.size(blocks(m)) > 0, blocks(m)).otherwise(flat(m))))
    calls = F.filter(F.flatten(F.transform(F.filter("chat_messages", lambda m: m["content"].isNotNull()), lambda m: m["content"])), lambda b: (b["type"] == "tool_use") & (F.length(b["name"]) > 0))
    names = F.transform(calls, lambda b: b["name"])
    tools = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.size(F.filter(names, lambda x: x == n)).cast("long"))))
    start, end = parse_ms(F.col("created_at")), parse_ms(F.col("updated_at"))
    named = none_if_empty(F.col("name"))
    df = conversations.withColumn("started_at", start).withColumn("updated_at_ms", end).where("started_at IS NOT NULL AND updated_at_ms IS NOT NULL")
    return df.select(
        F.col("uuid").alias("id"), F.lit("cloud").alias("source"), F.col("uuid").alias("raw_session_id"), "started_at", F.col("updated_at_ms").alias("updated_at"),
        F.greatest(F.lit(0), F.col("updated_at_ms") - F.col("started_at")).cast("long").alias("duration_ms"), F.coalesce(named, F.lit(UNTITLED)).alias("title"), F.when(named.isNotNull(), "cloud-name").otherwise("fallback").alias("title_source"),
        F.lit("none").alias("cwd_kind"), F.size(human).cast("long").alias("user_turns"), F.size(F.filter("chat_messages", lambda m: m["sender"] == "assistant")).cast("long").alias("assistant_turns"),
        F.coalesce(preview(none_if_empty(F.col("summary"))), preview(F.get(texts, F.lit(0)))).alias("preview"), none_if_empty(F.col("summary")).alias("summary"),
        F.when(named.isNotNull(), match_project(F.col("name"), F.coalesce("summary", F.lit("")), list(patterns))).alias("project"), F.when(F.size(tools) > 0, tools).alias("top_tools"), every.alias("human_texts"),
    )


def skipped(conversations: DataFrame) -> DataFrame:
    bad = parse_ms(F.col("created_at")).isNull() | parse_ms(F.col("updated_at")).isNull()
    return conversations.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("skipped"))


def from_transcripts(folds: DataFrame, desktop: DataFrame | None = None) -> DataFrame:
    """Folded transcripts (fold_transcripts) to sessions. With desktop manifests (cli_session_id, id, title, cwd): theirs win for id, title and cwd."""
    title, how = title_cascade(F.col("ai_title"), F.col("last_prompt"), F.col("first_user_text"))
    t = F.col("token_totals")
    any_tokens = (t["input"] > 0) | (t["output"] > 0) | (t["cache_creation"] > 0) | (t["cache_read"] > 0)
    df = folds.select(
        F.col("file_id").alias("id"), F.lit("cli-direct").alias("source"), F.col("file_id").alias("raw_session_id"), F.coalesce("min_ts", F.col("mtime_ms").cast("long")).alias("started_at"), F.coalesce("max_ts", F.col("mtime_ms").cast("long")).alias("updated_at"),
        title.alias("title"), how.alias("title_source"), F.when(F.col("cwd").isNotNull(), "host").otherwise("none").alias("cwd_kind"), "user_turns", "assistant_turns", preview(F.col("first_user_text")).alias("preview"), F.col("model"), "models_used", "cwd",
        basename(F.col("cwd")).alias("project"), F.when(any_tokens, t).alias("token_totals"), "top_tools", F.col("mtime_ms").alias("source_mtime_ms"),
    ).withColumn("duration_ms", F.greatest(F.lit(0), F.col("updated_at") - F.col("started_at")).cast("long"))
    if desktop is None:
        return df
    d = desktop.select(F.col("cli_session_id").alias("id"), F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("cwd").alias("_cwd"), F.col("model").alias("_model"))
    hit = F.col("_id").isNotNull()
    return df.join(d, "id", "left").withColumns({
        "source": F.when(hit, "cli-desktop").otherwise(F.col("source")), "title_source": F.when(hit, "manifest").otherwise(F.col("title_source")), "title": F.coalesce("_title", "title"), "cwd": F.coalesce("_cwd", "cwd"),
        "project": basename(F.coalesce("_cwd", "cwd")), "model": F.coalesce("model", "_model"), "id": F.coalesce("_id", "id"),
    }).drop("_id", "_title", "_cwd", "_model")


def from_cowork(manifests: DataFrame, audits: DataFrame) -> DataFrame:
    """Manifests with their folded audit logs; wall-clock duration as it is, also negative."""
    used = F.when(F.size("model_usage_keys") > 0, F.col("model_usage_keys")).when(F.col("manifest_model").isNotNull(), F.array("manifest_model"))
    df = manifests.withColumnRenamed("model", "manifest_model").join(audits, "session_key", "left")
    return df.select(
        "id", F.lit("cowork").alias("source"), F.coalesce("cli_session_id", "id").alias("raw_session_id"), F.col("created_at").alias("started_at"), F.col("last_activity_at").alias("updated_at"), (F.col("last_activity_at") - F.col("created_at")).alias("duration_ms"),
        "title", F.lit("manifest").alias("title_source"), F.lit("vm").alias("cwd_kind"), F.coalesce("user_turns", F.lit(0)).alias("user_turns"), F.coalesce("assistant_turns", F.lit(0)).alias("assistant_turns"),
        preview(F.col("initial_message")).alias("preview"), F.coalesce("last_result_model", "manifest_model").alias("model"), used.alias("models_used"), "cwd", F.col("total_cost_usd"), F.col("mtime_ms").alias("source_mtime_ms"),
    )


def desktop_stubs(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        "id", F.lit("cli-desktop").alias("source"), F.col("cli_session_id").alias("raw_session_id"), F.col("created_at").alias("started_at"), F.col("last_activity_at").alias("updated_at"), F.greatest(F.lit(0), F.col("last_activity_at") - F.col("created_at")).cast("long").alias("duration_ms"),
        "title", F.lit("manifest").alias("title_source"), F.lit("host").alias("cwd_kind"), F.lit(0).cast("long").alias("user_turns"), F.lit(None).cast("string").alias("preview"), "model", "cwd", basename(F.col("cwd")).alias("project"),
    )


def project_text(name: Column, description: Column, template: Column, limit: int = 2000) -> Column:
    """What a project is embedded by."""
    return F.left(F.concat_ws("\n", none_if_empty(name), none_if_empty(description), none_if_empty(template)), F.lit(limit))


def first_message_text(conversations: DataFrame) -> DataFrame:
    """(id, text) by the stricter rule: the first human message alone, its text block before its flat text."""
    first = F.get(F.filter("chat_messages", lambda m: m["sender"] == "human"), F.lit(0))
    block = F.get(F.filter(first["content"], lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), F.lit(0))["text"]
    return conversations.select(F.col("uuid").alias("id"), F.coalesce(block, none_if_empty(first["text"])).alias("text"))
