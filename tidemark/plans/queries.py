"""Every registered query with the SQL that DuckDB holds it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import relative
from ..functions.kernels import chunks, line_body, line_preview, should_expand
from ..functions.text import cut_title, ellipsis, format_bytes, format_count, format_usd, inline_html, normalize_for_hash, preview, strip_markdown, truncate
from ..operators import cost, duplicates, layout, lifecycle, merge, rollups, search, search_index, similarity, topics
from ..operators import sessions as S
from ..operators.graph import fresh_folder, tidy, written
from ..sources import archives, fixtures, json_lines, manifests, tables
from ..streaming import activity
from ..schema import DAY_MS, PROBE, UNTITLED
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = tidy(f)
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def _usd(x: str) -> str:
    return f"coalesce(sum(CAST({x} AS DECIMAL(18, 8)))::DOUBLE, 0)"


_EST = "CASE WHEN total_cost_usd IS NULL THEN cost END"
_SUMS = f"count(*) AS sessions, {_usd('total_cost_usd')} AS exact_usd, {_usd(_EST)} AS estimate_usd"
_MONEY = ["exact_usd", "estimate_usd"]


@query(f"""WITH {V.PRICED}, m AS (SELECT coalesce(model, '(unknown)') AS model, {_SUMS}, coalesce(sum(output), 0)::BIGINT AS output_tokens, {_usd("cost")} AS c FROM priced GROUP BY 1)
SELECT model, sessions, exact_usd, estimate_usd, output_tokens, round(c / sum(c) OVER (), 6) AS share FROM m""")
def cost_by_model(spark, sf):
    return cost.by_model(V.priced(spark, sf)).select("model", "sessions", *_MONEY, "output_tokens", _r("share", 6))


@query(f"""WITH {V.PRICED} SELECT strftime(make_timestamp(updated_at * 1000), '%Y-%m') AS month, upper(strftime(make_timestamp(updated_at * 1000), '%b')) AS label, {_SUMS} FROM priced WHERE cost IS NOT NULL GROUP BY 1, 2""")
def cost_by_month(spark, sf):
    return cost.by_month(V.priced(spark, sf)).select("month", "label", "sessions", *_MONEY)


@query(f"""WITH {V.PRICED}, p AS (SELECT coalesce(project, '__untagged__') AS project, count(*) AS n, {_usd('total_cost_usd')} AS e, {_usd(_EST)} AS x FROM priced GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY e + x DESC, project) AS k FROM p)
SELECT CASE WHEN k <= 8 THEN project ELSE '__rest__' END AS project, sum(n)::BIGINT AS sessions, {_usd('e')} AS exact_usd, {_usd('x')} AS estimate_usd, count(*)::INT AS n_projects FROM k GROUP BY 1""")
def cost_by_project_top8(spark, sf):
    return cost.by_project(V.priced(spark, sf)).select("project", "sessions", *_MONEY, "n_projects")


@query(f"WITH {V.PRICED} SELECT unknown_model AS model, count(*) AS sessions FROM priced WHERE unknown_model IS NOT NULL GROUP BY 1")
def unknown_models(spark, sf):
    return cost.unknown_models(V.priced(spark, sf))


@query(f"""WITH {V.PRICED} SELECT id, pick AS model_id_used, input_usd, output_usd, cache_write_usd, cache_read_usd, note
FROM priced WHERE total_cost_usd IS NULL AND cost IS NOT NULL""")
def cost_breakdown(spark, sf):
    b = V.priced(spark, sf).where("cost_breakdown IS NOT NULL").select("id", "cost_breakdown.*")
    return b.select("id", "model_id_used", "input_usd", "output_usd", "cache_write_usd", "cache_read_usd", "note")


@query(f"WITH {V.PRICED} SELECT id, source, title, cost FROM priced WHERE cost IS NOT NULL ORDER BY cost DESC, id LIMIT 20")
def top_expensive_sessions(spark, sf):
    return cost.most_expensive(V.priced(spark, sf)).select("id", "source", "title", "cost")


@query(f"""WITH {V.PRICED}, p AS (SELECT project FROM priced WHERE coalesce(project, '') <> '' GROUP BY 1 ORDER BY count(*) DESC, min(pos) LIMIT 1), e AS (SELECT event_type AS tool FROM events GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 1)
SELECT {_SUMS}, coalesce(sum(output), 0)::BIGINT AS output_tokens, count(*) FILTER (WHERE coalesce(project, '') <> '') AS tagged, (SELECT project FROM p) AS top_project, (SELECT tool FROM e) AS top_tool FROM priced""")
def kpi_summary(spark, sf):
    k = cost.kpis(V.priced(spark, sf), V.tools(spark, sf))
    return k.select("sessions", *_MONEY, "output_tokens", "tagged", "top_project", "top_tool")


_WEEK = "(updated_at - ((updated_at + 345600000) % 604800000 + 604800000) % 604800000)"
_WEEKS = f"s AS ({V.SESSIONS}), c AS (SELECT {_WEEK} AS week, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE source = '{x}') AS {x.replace('-', '_')}" for x in ("cloud", "cowork", "cli-direct", "cli-desktop")) + " FROM s GROUP BY 1), w AS (SELECT unnest(generate_series(min(week), max(week), 604800000)) AS week FROM c)"


@query(f"WITH {_WEEKS} SELECT week, coalesce(n, 0) AS n FROM w LEFT JOIN c USING (week)")
def weekly_activity(spark, sf):
    return rollups.weekly(V.sessions(spark, sf))


@query(f"WITH {_WEEKS} SELECT week, coalesce(cloud, 0) AS cloud, coalesce(cowork, 0) AS cowork, coalesce(cli_direct, 0) AS cli_direct, coalesce(cli_desktop, 0) AS cli_desktop FROM w LEFT JOIN c USING (week)")
def weekly_by_source(spark, sf):
    return rollups.weekly_by_source(V.sessions(spark, sf))


_VISIBLE = f"{_WEEKS}, v AS (SELECT {_WEEK} AS week, count(*) AS visible FROM s WHERE user_turns > 0 AND source IN ('cloud', 'cowork') GROUP BY 1), b AS (SELECT week, coalesce(n, 0) AS total, coalesce(visible, 0) AS visible FROM w LEFT JOIN c USING (week) LEFT JOIN v USING (week))"


@query(f"WITH {_VISIBLE} SELECT week, total, visible FROM b")
def visible_weeks(spark, sf):
    df = V.sessions(spark, sf)
    return rollups.visible_weeks(df, search.filter_sessions(df, sources=["cloud", "cowork"]))


@query(f"WITH {_VISIBLE} SELECT sum(total)::BIGINT AS total, sum(visible)::BIGINT AS visible, max(total) AS peak, arg_min(week, (-total, week)) AS peak_week, count(*) AS weeks, round(sum(total) / count(*), 6) AS per_week FROM b")
def timeline_stats(spark, sf):
    return rollups.timeline_stats(visible_weeks(spark, sf)).withColumn("per_week", F.round("per_week", 6))


@query(f"""WITH {_WEEKS}, m AS (SELECT week, month(make_timestamp(week * 1000))::INT AS month, year(make_timestamp(week * 1000))::INT AS year FROM w), l AS (SELECT *, lag(month) OVER (ORDER BY week) AS pm, lag(year) OVER (ORDER BY week) AS py FROM m)
SELECT week, month, CASE WHEN py IS NULL OR py <> year THEN year END AS year FROM l WHERE py IS NULL OR py <> year OR pm <> month""")
def month_ticks(spark, sf):
    return rollups.month_ticks(rollups.weekly(V.sessions(spark, sf)))


_FACETS = f"s AS ({V.SESSIONS}), f AS (SELECT 'project' AS facet, CASE WHEN coalesce(project, '') <> '' THEN project ELSE '(unknown)' END AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'topic', topic, count(*) FROM s WHERE topic IS NOT NULL GROUP BY 2)"


@query(f"WITH {_FACETS} SELECT facet, value, n FROM f")
def facet_counts(spark, sf):
    return rollups.facet_counts(V.sessions(spark, sf))


@query(f"""WITH {_FACETS}, r AS (SELECT *, value IN ('project-39', '~topic-4') AS pinned, row_number() OVER (PARTITION BY facet ORDER BY (value IN ('project-39', '~topic-4')) DESC, n DESC, value) AS k FROM f)
SELECT facet, CASE WHEN pinned OR k <= 8 THEN value ELSE '(rest)' END AS value, sum(n)::BIGINT AS n, count(*) AS "values" FROM r GROUP BY 1, 2""")
def facet_top8_pinned(spark, sf):
    return rollups.capped_facets(rollups.facet_counts(V.sessions(spark, sf)), 8, ["project-39", "~topic-4"])


def _searchable(spark, sf):
    """Sessions with the tools and models that search looks at."""
    maps = V.tools(spark, sf).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("top_tools"))
    models = V.token_sessions(spark, sf).select("id", "models_used")
    return V.sessions(spark, sf).join(maps, "id", "left").join(models, "id", "left")


#: Words of titles, tools, models and previews, of one to sixteen characters, and one that nothing has.
_SEARCHES = ("  Revisit ORDER 1", "click", "HAIKU-4", "urgent order 77", "f", "t-9", "no such words")
_FOUND = f"""s AS ({V.SESSIONS}), q AS (SELECT unnest([{", ".join(f"'{q}'" for q in _SEARCHES)}]) AS query), k AS (SELECT query, lower(trim(query)) AS q FROM q),
names AS (SELECT DISTINCT user_id AS id, event_type AS name FROM events UNION SELECT id, m FROM ({V.USED})),
f AS (SELECT query, id FROM s, k WHERE contains(lower(title), q) OR contains(lower(preview), q) OR contains(lower(coalesce(project, '')), q) UNION SELECT query, id FROM names JOIN s USING (id), k WHERE contains(lower(name), q))"""


@query(f"WITH {_FOUND} SELECT query, id, title, source FROM f JOIN s USING (id) WHERE user_turns > 0")
def search_sessions(spark, sf):
    """By scans, all arms on."""
    s, found = written(_searchable(spark, sf)), None
    for q in _SEARCHES:
        one = search.filter_sessions(s, q, columns=("title", "preview", "project")).select(F.lit(q).alias("query"), "id", "title", "source")
        found = one if found is None else found.unionByName(one)
    return found


@query(f"WITH {_FOUND} SELECT query, id, title, source FROM f JOIN s USING (id)")
def search_indexed(spark, sf):
    """The same by posting lists; sessions without turns too."""
    folder, columns = fresh_folder(spark), ("title", "preview", "project")
    search_index.write(_searchable(spark, sf).select("id", "source", *columns, "top_tools", "models_used"), folder, columns)
    return search_index.search_all(spark, folder, list(_SEARCHES), columns).select("query", "row.id", "row.title", "row.source")


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, project, topic, source FROM s WHERE user_turns > 0 AND source IN ('cloud', 'cli-direct') AND (project IN ('project-2', 'project-12') OR coalesce(project, '') = '') AND topic IN ('~topic-0', '~topic-2')")
def facet_filter(spark, sf):
    return search.filter_sessions(V.sessions(spark, sf), sources=["cloud", "cli-direct"], projects=["project-2", "project-12"], unknown_project=True, topics=["~topic-0", "~topic-2"]).select("id", "project", "topic", "source")


_PAGE = f"s AS ({V.SESSIONS}), p AS (SELECT *, row_number() OVER (ORDER BY user_turns DESC, updated_at DESC, pos) AS rank FROM s)"


@query(f"WITH {_PAGE} SELECT rank::INT AS rank, id, user_turns FROM p WHERE rank <= 50")
def sorted_page(spark, sf):
    return search.ranked_page(V.sessions(spark, sf), "turns").select("rank", "id", "user_turns")


@query(f"WITH {_PAGE} SELECT id, rank, lag(id) OVER (ORDER BY rank) AS previous_id, lead(id) OVER (ORDER BY rank) AS next_id FROM p")
def neighbor_ids(spark, sf):
    return search.neighbours(V.sessions(spark, sf), "turns")


@query(f"WITH {_PAGE} SELECT id, rank FROM p WHERE rank BETWEEN 201 AND 250")
def fifth_page(spark, sf):
    return search.nth_page(V.sessions(spark, sf), "turns", 5)


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, source, project FROM s ORDER BY CASE WHEN project = '' THEN 0 WHEN project IS NULL THEN 1 ELSE 2 END, project, updated_at DESC, pos LIMIT 50")
def project_page(spark, sf):
    return search.page(V.sessions(spark, sf), "project").select("id", "source", "project")


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, updated_at FROM s ORDER BY updated_at DESC, pos LIMIT 50")
def recent_page(spark, sf):
    return search.page(V.sessions(spark, sf), "recent").select("id", "updated_at")


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, updated_at FROM s ORDER BY updated_at, pos LIMIT 50")
def oldest_page(spark, sf):
    return search.page(V.sessions(spark, sf), "oldest").select("id", "updated_at")


@query(f"WITH {V.PRICED} SELECT id, coalesce(cost, 0) AS cost FROM priced ORDER BY coalesce(cost, 0) DESC, updated_at DESC, pos LIMIT 50")
def cost_page(spark, sf):
    page = search.page(V.priced(spark, sf), "cost")
    return page.select("id", F.coalesce("total_cost_usd", "cost_estimated_usd", F.lit(0.0)).alias("cost"))

_TURNS = "SELECT conv_id AS id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS t FROM conversations GROUP BY 1"


@query(f"SELECT id, user_turns, assistant_turns FROM ({_TURNS})")
def session_turns(spark, sf):
    return S.turn_counts(V.messages(spark, sf)).select("id", "user_turns", "assistant_turns")


@query(rf"SELECT id, nullif(left(trim(regexp_replace(t, '\s+', ' ', 'g')), 200), '') AS preview FROM ({_TURNS})")
def session_preview(spark, sf):
    return S.turn_counts(V.messages(spark, sf)).select("id", preview(F.col("first_human_text")).alias("preview"))


@query("SELECT user_id AS id, event_type AS tool, count(*) AS n, min(event_id) AS pos FROM events GROUP BY 1, 2")
def tool_histogram(spark, sf):
    return V.tools(spark, sf)


@query("SELECT id, string_agg(concat(tool, ' ', n), ', ' ORDER BY n DESC, tool) AS tools FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, tool) AS k FROM (SELECT user_id AS id, event_type AS tool, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1")
def top3_tools(spark, sf):
    maps = V.tools(spark, sf).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("m"))
    return maps.select("id", search.top_tools(F.col("m")).alias("tools"))


@query(f"WITH s AS ({V.SESSIONS}), n AS (SELECT unnest(['cloud', 'cowork', 'cli-direct', 'cli-desktop']) AS source) SELECT n.source, count(s.id) AS n FROM n LEFT JOIN s ON s.source = n.source GROUP BY 1")
def source_counts(spark, sf):
    return rollups.source_counts(V.sessions(spark, sf))


def _merge_parts(spark, sf):
    s = V.sessions(spark, sf).select("id", "source", "project", "topic", "title", "pos")
    stub = s.select("id", "source", F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("topic"), F.lit("stub").alias("title"), "pos")
    again = s.where("topic IS NOT NULL OR project IS NULL").withColumn("title", F.concat("title", F.lit(" again")))
    return ("cowork", stub), ("cli-direct", s), ("cloud", again)


_MERGE = f"""s AS ({V.SESSIONS}), u AS (
  SELECT id, source, NULL AS project, NULL AS topic, 'stub' AS title, pos, 0 AS part FROM s
  UNION ALL SELECT id, source, project, topic, title, pos, 2 FROM s
  UNION ALL SELECT id, source, project, topic, concat(title, ' again'), pos, 3 FROM s WHERE topic IS NOT NULL OR project IS NULL)"""


@query(f"WITH {_MERGE} SELECT id, source, project, topic, title, pos FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY (project IS NOT NULL)::INT + (topic IS NOT NULL)::INT DESC, part DESC) AS k FROM u) WHERE k = 1")
def merge_richest(spark, sf):
    return merge.merge_sources(*_merge_parts(spark, sf))


@query(f"""WITH s AS ({V.SESSIONS}), u AS (SELECT id, updated_at, 'old' AS side, 1 AS p FROM s UNION ALL SELECT id, updated_at + (id % 3 - 1) * 1000, 'new', 0 FROM s)
SELECT id, updated_at, side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, p DESC) AS k FROM u) WHERE k = 1""")
def upload_merge_newest(spark, sf):
    s = V.sessions(spark, sf)
    old = s.select("id", "updated_at", F.lit("old").alias("side"))
    new = s.select("id", (F.col("updated_at") + (F.col("id") % 3 - 1) * 1000).alias("updated_at"), F.lit("new").alias("side"))
    return merge.merge_uploads(old, new)


@query(f"""WITH s AS ({V.SESSIONS}), u AS (SELECT id, 'old' AS side, 0 AS p, updated_at FROM s UNION ALL SELECT id, 'new', 1, updated_at FROM s)
SELECT id, updated_at, side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, p DESC) AS k FROM u) WHERE k = 1""")
def upload_merge_bodies(spark, sf):
    s = V.sessions(spark, sf)
    side = lambda name: s.select("id", "updated_at", F.lit(name).alias("side"))
    return merge.merge_uploads(side("old"), side("new"), tie="incoming")


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, source, title FROM s WHERE source <> 'cloud' UNION ALL SELECT id, source, concat(title, ' (uploaded)') FROM s WHERE source = 'cloud' AND o_orderstatus = 'F'")
def overlay_cloud(spark, sf):
    s = V.sessions(spark, sf)
    uploaded = s.where("source = 'cloud' AND o_orderstatus = 'F'").select("id", "source", "title")
    return merge.overlay_uploaded(s.select("id", "source", "title"), uploaded.withColumn("title", F.concat("title", F.lit(" (uploaded)"))))


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, source, title FROM s WHERE source NOT IN ('cowork', 'cli-desktop')")
def delete_by_source(spark, sf):
    return merge.delete_sources(V.sessions(spark, sf).select("id", "source", "title"), ["cowork", "cli-desktop"])


@query(f"WITH s AS ({V.SESSIONS}) SELECT source, id, 'project' AS field FROM s WHERE project IS NULL UNION ALL SELECT source, id, 'topic' FROM s WHERE topic IS NULL AND id % 5 = 0")
def validate_entries(spark, sf):
    s = V.sessions(spark, sf).withColumn("topic", F.when(F.col("id") % 5 == 0, F.col("topic")).otherwise(F.lit("x")))
    return merge.validation_errors(s, ["id", "source", "title", "project", "topic", "started_at"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_sessions(spark, sf):
    return merge.stale_ids(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), "doc_id")


@query(f"WITH s AS ({V.SESSIONS}) SELECT source, id, CASE WHEN project IS NOT NULL AND topic IS NULL THEN 'reuse' ELSE 'read' END AS action FROM s")
def incremental_rescan(spark, sf):
    # the last run knew no session with a topic, and those without a project have changed since
    s = V.sessions(spark, sf).select("source", "id", "project", "topic", F.col("updated_at").cast("double").alias("source_mtime_ms"))
    now = s.drop("project", "topic")
    before = s.where("topic IS NULL").withColumn("source_mtime_ms", F.col("source_mtime_ms") - F.when(F.col("project").isNull(), 5).otherwise(0)).drop("project", "topic")
    reuse, read = merge.reusable(now, before)
    return reuse.select("source", "id", F.lit("reuse").alias("action")).unionByName(read.select("source", "id", F.lit("read").alias("action")))


def _projects(spark, sf):
    return V.sessions(spark, sf).withColumn("project", F.col("o_custkey"))


_LIFE = f"""s AS (SELECT * REPLACE (o_custkey AS project) FROM ({V.SESSIONS})), g AS (
  SELECT *, (started_at - lag(updated_at) OVER (PARTITION BY project ORDER BY started_at, pos)) / 86400000.0 AS gap,
         regexp_matches(concat(title, chr(10), preview), '{PROBE}', 'i') AS asks, count(*) OVER (PARTITION BY project ORDER BY started_at RANGE BETWEEN 0 PRECEDING AND 1209600000 FOLLOWING) AS ahead FROM s),
d AS (SELECT *, max(ahead) OVER (PARTITION BY project ORDER BY started_at, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 3 AS dense FROM g),
p AS (SELECT project, count(*) AS sessions, count(*) FILTER (WHERE asks AND gap >= 60 AND NOT dense) AS probes, arg_max(updated_at, (started_at, pos)) AS last_active_at, coalesce(bool_or(dense AND started_at >= {V.NOW - 180 * DAY_MS}), false) AS alive FROM d GROUP BY 1),
life AS (SELECT project, sessions, probes, last_active_at, floor(({V.NOW} - last_active_at) / 86400000.0)::BIGINT AS days_since_last, alive FROM p),
c AS (SELECT project, sessions, probes, last_active_at, days_since_last, CASE WHEN days_since_last < 30 THEN 'active' WHEN probes > 0 THEN 'zombie' WHEN days_since_last >= 180 AND NOT alive THEN 'zombie' ELSE 'dormant' END AS classification FROM life)"""


@query(f"WITH {_LIFE} SELECT * FROM c")
def lifecycle_projects(spark, sf):
    return lifecycle.classify(_projects(spark, sf), V.NOW).drop("first_pos")


@query(f"WITH {_LIFE} SELECT k.classification, count(c.project) AS projects FROM (SELECT unnest(['active', 'dormant', 'zombie']) AS classification) k LEFT JOIN c USING (classification) GROUP BY 1")
def lifecycle_counts(spark, sf):
    return lifecycle.class_counts(lifecycle.classify(_projects(spark, sf), V.NOW))


@query(f"WITH {_LIFE} SELECT id, s.project FROM s SEMI JOIN (SELECT project FROM c WHERE classification = 'zombie') z USING (project)")
def zombie_semi(spark, sf):
    df = _projects(spark, sf)
    return lifecycle.zombie_sessions(df.select("id", "project"), lifecycle.classify(df, V.NOW))


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY started_at, pos) AS i FROM (SELECT * REPLACE (o_custkey % 400 AS project) FROM ({V.SESSIONS}))),
w AS (SELECT a.project, a.i, a.started_at, count(*) AS n, max(b.started_at) AS "end" FROM s a JOIN s b ON a.project = b.project AND b.i >= a.i AND b.started_at <= a.started_at + 1209600000 GROUP BY 1, 2, 3),
g AS (
  SELECT project, 0::BIGINT AS upto, NULL::BIGINT AS start, NULL::BIGINT AS "end", 0::BIGINT AS n FROM (SELECT DISTINCT project FROM s)
  UNION ALL
  SELECT g.project, f.i + f.n - 1, f.started_at, f."end", f.n FROM g, LATERAL (SELECT * FROM w WHERE w.project = g.project AND w.n >= 3 AND w.i > g.upto ORDER BY i LIMIT 1) f)
SELECT project, start, "end", n FROM g WHERE n > 0""")
def burst_windows(spark, sf):
    return lifecycle.bursts(V.sessions(spark, sf).withColumn("project", F.col("o_custkey") % 400))


_PATHS = f"""SELECT id, CASE WHEN id % 3 = 0 THEN project END AS project, CASE id % 5 WHEN 0 THEN concat('/home/u/app-', id % 9, '/') WHEN 1 THEN concat('C:\\work\\tool-', id % 9) WHEN 2 THEN '/' WHEN 3 THEN concat('bare-', id % 9) END AS cwd,
CASE WHEN id % 2 = 0 THEN 'About My Project A today' WHEN id % 7 = 0 THEN 'notes on myblog' ELSE 'my projector' END AS title FROM ({V.SESSIONS})"""


@query(f"""WITH p AS ({_PATHS}), b AS (SELECT *, nullif(regexp_extract(regexp_replace(cwd, '[\\\\/]+$', ''), '([^\\\\/]*)$', 1), '') AS base,
CASE WHEN regexp_matches(title, '\\bmy[ -]?project[ -]?a\\b', 'i') THEN 'my-project-a' WHEN regexp_matches(title, '\\bmy[ -]?blog\\b', 'i') THEN 'my-blog' END AS word FROM p)
SELECT id, coalesce(nullif(project, ''), base, word) AS project_id, CASE WHEN nullif(project, '') IS NOT NULL THEN 'project_field' WHEN base IS NOT NULL THEN 'cwd_basename' WHEN word IS NOT NULL THEN 'title_keyword' END AS inference_source FROM b""")
def infer_project(spark, sf):
    k = F.col("id")
    pick = lambda n, *args: F.concat(F.lit(n), *args)
    nine = (k % 9).cast("string")
    s = V.sessions(spark, sf).select(
        "id", F.when(k % 3 == 0, F.col("project")).alias("project"), F.when(k % 5 == 0, pick("/home/u/app-", nine, F.lit("/"))).when(k % 5 == 1, pick("C:\\work\\tool-", nine)).when(k % 5 == 2, "/").when(k % 5 == 3, pick("bare-", nine)).alias("cwd"),
        F.when(k % 2 == 0, "About My Project A today").when(k % 7 == 0, "notes on myblog").otherwise("my projector").alias("title"),
    )
    return s.withColumn("p", S.infer_project(F.col("project"), F.col("cwd"), F.col("title"))).select("id", F.col("p.id").alias("project_id"), "p.inference_source")


_NAMES = [("1", "order 12"), ("2", "design"), ("3", "abc"), ("4", "Status O"), ("5", "URGENT")]


@query(rf"""WITH s AS ({V.SESSIONS}) SELECT id, CASE WHEN regexp_matches(title, '\border 12\b', 'i') THEN 'order 12' WHEN regexp_matches(title, '\bStatus O\b', 'i') THEN 'Status O' WHEN regexp_matches(title, '\bURGENT\b', 'i') THEN 'URGENT'
WHEN regexp_matches(preview, '\border 12\b', 'i') THEN 'order 12' WHEN regexp_matches(preview, '\bStatus O\b', 'i') THEN 'Status O' WHEN regexp_matches(preview, '\bURGENT\b', 'i') THEN 'URGENT' END AS matched FROM s""")
def project_match(spark, sf):
    return V.sessions(spark, sf).select("id", S.match_project(F.col("title"), F.col("preview"), S.project_patterns(_NAMES)).alias("matched"))


@query(f"""WITH s AS ({V.SESSIONS}) SELECT id, CASE WHEN id % 3 = 0 THEN concat('order ', id) WHEN o_orderstatus <> 'P' THEN concat('STATUS ', o_orderstatus) END AS project FROM s""")
def project_names(spark, sf):
    """As many names as there are orders: in a third of the titles, else two in the previews, of which one is listed later."""
    s = V.sessions(spark, sf).drop("project")
    names = s.where("id % 3 = 0").select(F.concat(F.lit(" order "), F.col("id").cast("string")).alias("name"), F.col("pos").cast("long").alias("pos"))
    more = spark.createDataFrame([("STATUS F", 1 << 60), ("STATUS O", 0), ("Stat", 0), ("tests", 0)], "name string, pos long")
    return S.match_projects(s, names.unionByName(more), "title", "preview").select("id", "project")


_SQUEEZE = r"left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '```[\s\S]*?```', ' ', 'g'), 'https?://\S+', ' ', 'g'), '(?m)^[ \t]*[#\-*+]+\s+', '', 'g'), '(^|\s)(?:[\w.-]+/)+([\w.-]+\.\w+)', '\1\2', 'g'), '\s+', ' ', 'g')), 400)"
_NORM = f"SELECT doc_id, {_SQUEEZE.format(t='text')} AS norm FROM documents"


@query(f"SELECT sha256(norm) AS hash, left(sha256(norm), 12) AS cluster_id, count(*) AS size, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS session_ids, left(min(norm), 200) AS sample_text FROM ({_NORM}) WHERE length(norm) >= 40 GROUP BY norm HAVING count(*) >= 2")
def duplicates_exact(spark, sf):
    docs = V.table(spark, sf, "documents")
    found = duplicates.exact_clusters(docs, "text", "doc_id", "doc_id")
    return found.select("hash", "cluster_id", "size", F.array_join(F.transform("session_ids", lambda x: x.cast("string")), ",").alias("session_ids"), "sample_text")


def _tier(df, norm, name):
    return df.withColumn("k", norm).groupBy("k").agg(F.sort_array(F.collect_list("doc_id")).alias("session_ids"), F.min("doc_id").alias("pos")).where(F.size("session_ids") >= 2).select(F.concat(F.lit(name), F.left(F.sha2("k", 256), F.lit(12))).alias("cluster_id"), "pos", "session_ids")


@query(rf"""WITH RECURSIVE n AS (SELECT doc_id, norm, left(norm, 60) AS pre FROM ({_NORM}) WHERE length(norm) >= 40),
m AS (SELECT concat('e', left(sha256(norm), 12)) AS c, 'exact' AS kind, 0 AS tier, doc_id, min(doc_id) OVER (PARTITION BY norm) AS pos FROM n QUALIFY count(*) OVER (PARTITION BY norm) >= 2
  UNION ALL SELECT concat('s', left(sha256(pre), 12)), 'semantic', 1, doc_id, min(doc_id) OVER (PARTITION BY pre) FROM n QUALIFY count(*) OVER (PARTITION BY pre) >= 2),
link AS (SELECT DISTINCT a.c AS a, b.c AS b FROM m a JOIN m b USING (doc_id)), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), root AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY 1)
SELECT arg_min(c, (tier, pos, c)) AS representative, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kind, count(DISTINCT doc_id) AS size FROM m JOIN root USING (c) GROUP BY root""")
def duplicates_merged(spark, sf):
    n = written(V.table(spark, sf, "documents").select("doc_id", normalize_for_hash(F.col("text")).alias("norm"))).where("char_length(norm) >= 40")
    found = duplicates.merged_clusters(_tier(n, F.col("norm"), "e"), _tier(n, F.left("norm", F.lit(60)), "s"))
    return found.select("representative", "kind", F.size("session_ids").cast("long").alias("size"))


_DF = f"w AS ({V.WORDS}), x AS (SELECT doc, source, unnest(tokens) AS token FROM w), df AS (SELECT token, count(*) AS df FROM x GROUP BY 1)"


@query(f"WITH {_DF} SELECT token, df FROM df")
def doc_frequency(spark, sf):
    return topics.doc_frequency(V.words(spark, sf))


_TERMS = f"""{_DF}, sc AS (SELECT source AS cluster, token, count(*) * ln((SELECT count(*) FROM w) / min(df)) AS score FROM x JOIN df USING (token) GROUP BY 1, 2),
tt AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, token) AS rank FROM sc QUALIFY rank <= 5)"""


def _terms(spark, sf):
    w = V.words(spark, sf)
    return topics.terms_of(w.select(F.col("source").alias("cluster"), "tokens"), 5), w.select("doc", "tokens")


@query(f"WITH {_TERMS} SELECT cluster, token, round(score, 6) AS score, rank::INT AS rank FROM tt")
def distinctive_terms(spark, sf):
    return _terms(spark, sf)[0].withColumn("score", F.round("score", 6))


@query(f"WITH {_TERMS} SELECT cluster, string_agg(token, ' + ' ORDER BY token) AS label FROM tt WHERE rank <= 3 GROUP BY 1")
def topic_labels(spark, sf):
    return topics.term_labels(_terms(spark, sf)[0].where("rank <= 3"))


@query(f"""WITH {_TERMS}, p AS (SELECT a.cluster, a.token AS a, b.token AS b FROM tt a JOIN tt b ON a.cluster = b.cluster AND a.rank < b.rank), h AS (SELECT doc, token FROM x WHERE token IN (SELECT token FROM tt)),
co AS (SELECT u.token AS a, v.token AS b, count(*) AS co FROM h u JOIN h v ON u.doc = v.doc AND u.token <> v.token GROUP BY 1, 2)
SELECT cluster, round(avg(ln((coalesce(co, 0) + 1) / df)), 6) AS coherence, count(*) AS pairs FROM p LEFT JOIN co USING (a, b) JOIN df ON df.token = p.b GROUP BY 1""")
def umass_coherence(spark, sf):
    terms, words = _terms(spark, sf)
    return topics.coherence(terms, words).withColumn("coherence", F.round("coherence", 6))


_RESCUE = 0.3


@query(f"""WITH {_DF}, idf AS (SELECT token, ln((SELECT count(*) FROM w) / df) AS idf FROM df), l AS (SELECT doc, source, CASE WHEN doc % 4 <> 0 THEN source END AS label FROM w),
d AS (SELECT doc, token, idf AS a FROM x JOIN idf USING (token) WHERE doc % 4 = 0), k AS (SELECT source AS t, token, count(*) * min(idf) AS b FROM x JOIN idf USING (token) WHERE doc % 4 <> 0 GROUP BY 1, 2),
nd AS (SELECT doc, sqrt(sum(a * a)) AS na FROM d GROUP BY 1), nk AS (SELECT t, sqrt(sum(b * b)) AS nb FROM k GROUP BY 1),
sim AS (SELECT doc, t, round(sum(a * b) / (min(na) * min(nb)), 9) AS sim FROM d JOIN k USING (token) JOIN nd USING (doc) JOIN nk USING (t) GROUP BY 1, 2),
best AS (SELECT doc, t, sim FROM sim WHERE sim > 0 AND sim >= {_RESCUE} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY sim DESC, t) = 1)
SELECT doc, coalesce(label, t) AS label, CASE WHEN label IS NULL THEN round(sim, 6) END AS rescued_at FROM l LEFT JOIN best USING (doc)""")
def outlier_rescue(spark, sf):
    # every fourth document has no label; the names of labels order equal similarities
    placed = V.words(spark, sf).select("doc", F.when(F.col("doc") % 4 != 0, F.col("source")).alias("label"), "tokens")
    return topics.rescue_placed(placed, _RESCUE).withColumn("rescued_at", F.round("rescued_at", 6))


_SIMS = f"c AS ({V.CENTROIDS}), sims AS (SELECT vec_id // 5 AS doc_id, ord, centroid_id, max(list_inner_product(embedding::DOUBLE[], vec)) AS sim FROM embeddings, c GROUP BY 1, 2, 3)"


def _chunks(spark, sf):
    return V.vectors(spark, sf).withColumn("doc_id", F.floor(F.col("vec_id") / 5))


@query(f"WITH {_SIMS} SELECT doc_id, centroid_id, round(sim, 6) AS sim FROM sims")
def chunk_max_sim(spark, sf):
    return similarity.centroid_similarities(_chunks(spark, sf), V.centroids(spark, sf)).select("doc_id", "centroid_id", F.round("sim", 6).alias("sim"))


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, ord) AS k FROM sims), b AS (SELECT a.doc_id, a.centroid_id, a.sim, z.sim AS second FROM r a LEFT JOIN r z ON z.doc_id = a.doc_id AND z.k = 2 WHERE a.k = 1)
SELECT doc_id, CASE WHEN sim >= 0.1 AND sim - second >= 0.0201 THEN centroid_id END AS label, round(sim, 6) AS similarity, round(second, 6) AS runner_up FROM b""")
def nearest_centroid(spark, sf):
    found = similarity.nearest(_chunks(spark, sf), V.centroids(spark, sf), 0.1, 0.0201)
    return found.select("doc_id", "label", F.round("similarity", 6).alias("similarity"), F.round("runner_up", 6).alias("runner_up"))


@query("""WITH m AS (SELECT vec_id // 5 AS doc_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT doc_id, (i - 1)::INT AS at, round(m / n, 6) AS x FROM m JOIN n USING (doc_id)""")
def mean_pool(spark, sf):
    return similarity.mean_pool(_chunks(spark, sf)).select("doc_id", F.posexplode("vec").alias("at", "x")).withColumn("x", F.round("x", 6))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def similar_pairs(spark, sf):
    return similarity.similar_pairs(V.vectors(spark, sf), 0.3).withColumn("sim", F.round("sim", 6))


@query(f"""WITH s AS ({V.SESSIONS}), k AS (SELECT source = 'cloud' AS cloud, coalesce(project, '') <> '' AS named, topic IS NOT NULL AS emergent, topic, project FROM s)
SELECT count(DISTINCT topic) AS topics, count(*) FILTER (WHERE emergent OR named) AS labelled, count(DISTINCT CASE WHEN named THEN project END) AS projects,
round(count(*) FILTER (WHERE cloud AND named) / count(*) FILTER (WHERE cloud), 9) AS classified, round(count(*) FILTER (WHERE cloud AND NOT named AND emergent) / count(*) FILTER (WHERE cloud), 9) AS emergent, round(count(*) FILTER (WHERE cloud AND NOT named AND NOT emergent) / count(*) FILTER (WHERE cloud), 9) AS unlabelled FROM k""")
def label_coverage(spark, sf):
    t = rollups.semantic_tallies(V.sessions(spark, sf))
    return t.select("topics", "labelled", "projects", _r("classified", 9), _r("emergent", 9), _r("unlabelled", 9))


@query(f"WITH s AS ({V.SESSIONS}), l AS (SELECT id, CASE WHEN id % 6 = 0 THEN '~overlay' WHEN id % 6 = 3 THEN 'named' END AS label FROM s) SELECT id, CASE WHEN label LIKE '~%' THEN label ELSE topic END AS topic, CASE WHEN label IS NOT NULL AND label NOT LIKE '~%' AND coalesce(project, '') = '' THEN label ELSE project END AS project FROM s LEFT JOIN l USING (id)")
def label_overlay(spark, sf):
    s = V.sessions(spark, sf)
    labels = s.select("id", F.when(F.col("id") % 6 == 0, "~overlay").when(F.col("id") % 6 == 3, "named").alias("label")).where("label IS NOT NULL")
    return S.overlay_labels(s.select("id", "topic", "project"), labels).select("id", "topic", "project")


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, round((started_at - min(started_at) OVER ()) / greatest(1, max(started_at) OVER () - min(started_at) OVER ()) * 100.0, 6) AS x FROM s")
def timeline_positions(spark, sf):
    return rollups.timeline_positions(V.sessions(spark, sf)).select("id", F.round("x", 6).alias("x"))


@query(f"WITH s AS ({V.SESSIONS}) SELECT min(started_at) AS first_at, max(updated_at) AS last_at FROM s")
def date_range(spark, sf):
    return rollups.date_range(V.sessions(spark, sf))


@query(f"WITH s AS ({V.SESSIONS}) SELECT coalesce(bool_and(source = 'cloud'), false) AND count(*) > 0 AS all_cloud FROM s")
def all_cloud(spark, sf):
    return search.all_cloud(V.sessions(spark, sf))


@query(f"""WITH s AS ({V.SESSIONS}) SELECT id, CASE WHEN {V.NOW} - updated_at < 0 OR {V.NOW} - updated_at >= 259200000 THEN strftime(make_timestamp(updated_at * 1000), '%Y-%m-%d') WHEN {V.NOW} - updated_at < 3600000 THEN concat(greatest(({V.NOW} - updated_at) // 60000, 1), 'm ago')
WHEN {V.NOW} - updated_at < 172800000 THEN concat(({V.NOW} - updated_at) // 3600000, 'h ago') ELSE concat(({V.NOW} - updated_at) // 86400000, 'd ago') END AS shown FROM s""")
def relative_times(spark, sf):
    return V.sessions(spark, sf).select("id", relative(V.NOW, F.col("updated_at")).alias("shown"))


@query()
def chunk_text(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.lit("title").alias("t"), F.col("source").alias("s"), F.array("text").alias("turns"))
    return docs.select("doc_id", F.posexplode(chunks("t", "s", "turns")).alias("at", "chunk"))


@query(r"""WITH q AS (SELECT conv_id AS id, turn AS pos, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)
SELECT id, pos, CASE WHEN length(t) <= 600 THEN t ELSE concat(left(t, 600), '…(+', length(t) - 600, ' chars)') END AS preview FROM q""")
def line_previews(spark, sf):
    lines = V.messages(spark, sf).select("id", "pos", F.to_json(F.struct(F.when(F.col("sender") == "human", "user").otherwise("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message"))).alias("raw"))
    return lines.select("id", "pos", line_preview("raw").alias("preview"))


@query()
def topic_clusters(spark, sf):
    v = V.vectors(spark, sf).select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("doc"), "vec", F.array(F.concat(F.lit("label"), F.translate(F.col("label").cast("string"), "0123456789", "abcdefghij"))).alias("tokens"), F.lit("").alias("text"))
    return topics.discover(v, 0.3, 2).select("id", "label", "size", F.array_join("members", ",").alias("members"))


@query()
def kmeans_labels(spark, sf):
    return topics.kmeans(V.vectors(spark, sf).select(F.col("vec_id").alias("doc"), "vec"), 10)


@query("""SELECT date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS week_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18, 6)))::DOUBLE AS value FROM events GROUP BY 1, 2""")
def stream_weekly(spark, sf):
    out = activity.drain(activity.weekly(activity.read_events(spark, f"{sf}/events.parquet")), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("week_start"), "event_type", "n", "value")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    out = activity.drain(activity.user_sessions(activity.read_events(spark, f"{sf}/events.parquet")), "complete")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


# Sources: raw files are written from the tables, read by the sources and folded; the SQL says the same of the tables.
_UUID = "concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"


def _uuid(c):
    h = F.md5(c.cast("string"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _files(rows, name, line, order, last=None):
    """(name, text): lines of each file in order, and a last one."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("raw")))), lambda s: s["raw"]), "\n")
    return rows.groupBy(name.alias("name")).agg((text if last is None else F.concat(text, F.lit("\n" + last))).alias("text"))


def _transcripts(spark, sf):
    """Each conversation as a transcript: system lines of a type that no reader knows, tool calls in every second turn, and a broken last line."""
    m = V.table(spark, sf, "conversations")
    at = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("tool-"), (F.col("turn") % 3).cast("string")).alias("name"))
    user = F.struct(F.lit("user").alias("type"), at.alias("timestamp"), F.concat(F.lit("/work/app-"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message"))
    usage = F.struct(F.char_length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    model = F.when(F.col("turn") % 4 == 1, "claude-opus-4-6").otherwise("claude-haiku-4-5")
    content = F.when(F.col("turn") % 2 == 1, F.array(said, tool)).otherwise(F.array(said))
    other = F.struct(F.lit("assistant").alias("type"), at.alias("timestamp"), F.struct(F.lit("assistant").alias("role"), model.alias("model"), content.alias("content"), usage.alias("usage")).alias("message"))
    line = F.when(F.col("role") == "user", F.to_json(user)).when(F.col("role") == "assistant", F.to_json(other)).otherwise(F.to_json(F.struct(F.col("role").alias("type"))))
    name = F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string"), F.lit("/"), _uuid(F.col("conv_id")), F.lit(".jsonl"))
    folder = fresh_folder(spark)
    fixtures.write_texts(_files(m, name, line, F.col("turn"), "{broken"), folder)
    return json_lines.transcripts(spark, folder)


_ID = _UUID.format(h="md5(conv_id::VARCHAR)")
_TRANSCRIPT = f"""SELECT {_ID} AS id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, count(*) FILTER (WHERE role = 'assistant' AND turn % 2 = 1) AS tools,
CASE WHEN count(*) FILTER (WHERE role = 'user') > 0 THEN concat('app-', conv_id % 7) END AS project, arg_max(CASE WHEN turn % 4 = 1 THEN 'claude-opus-4-6' ELSE 'claude-haiku-4-5' END, turn) FILTER (WHERE role = 'assistant') AS model,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS input, coalesce(sum(turn) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output, arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS first_text,
epoch_ms(min(make_timestamp(2024, 1, (turn % 28 + 1)::BIGINT, 0, 0, 0)) FILTER (WHERE role IN ('user', 'assistant'))) AS started_at FROM conversations GROUP BY conv_id"""


@query(f"SELECT id, user_turns, assistant_turns, project, model, input, output, started_at, 1 AS malformed, tools, nullif(left(trim(regexp_replace(first_text, '\\s+', ' ', 'g')), 200), '') AS preview FROM ({_TRANSCRIPT})")
def transcript_sessions(spark, sf):
    folds = written(json_lines.fold_transcripts(_transcripts(spark, sf)))
    s = S.from_transcripts(folds).join(folds.select(F.col("file_id").alias("id"), "malformed", F.col("token_totals").alias("t")), "id")
    calls = F.aggregate(F.map_values("top_tools"), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("id", "user_turns", "assistant_turns", "project", "model", "t.input", "t.output", "started_at", "malformed", F.coalesce(calls, F.lit(0)).cast("long").alias("tools"), "preview")


@query(f"SELECT {_ID} AS id, arg_min(text, turn) AS first_human_text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id")
def transcript_first_texts(spark, sf):
    return json_lines.first_texts(_transcripts(spark, sf)).withColumnRenamed("file_id", "id")


@query("SELECT role AS type FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY 1")
def transcript_drift(spark, sf):
    return json_lines.unknown_line_types(_transcripts(spark, sf)).select("type")


_CLIENT = _UUID.format(h="md5(c_custkey::VARCHAR)")


def _cowork(spark, sf):
    """Each customer as a manifest, with an audit log of a result line an order; manifests of customers in debt lack a title, and those of one segment hold a member that no reader knows."""
    c = V.table(spark, sf, "customer")
    key = _uuid(F.col("c_custkey"))
    made = F.to_json(F.struct(
        F.concat(F.lit("local_"), key).alias("sessionId"), (F.col("c_custkey") * 1000).alias("createdAt"), (F.col("c_custkey") * 1000 + 500).alias("lastActivityAt"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("title"), F.lit("/w").alias("cwd"),
        F.lit("claude-opus-4-6").alias("model"), F.col("c_mktsegment").alias("initialMessage"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(1)).alias("notKnown"),
    ))
    base = F.concat_ws("/", key, key, F.concat(F.lit("local_"), key))
    o = V.table(spark, sf, "orders").withColumn("c_custkey", F.col("o_custkey")).join(c.select("c_custkey"), "c_custkey")
    usage = F.create_map(F.when(F.col("o_orderkey") % 2 == 0, "claude-haiku-4-5").otherwise("claude-opus-4-6"), F.lit(1))
    line = F.to_json(F.struct(F.lit("result").alias("type"), F.col("o_orderkey").alias("duration_ms"), F.lit(2).alias("duration_api_ms"), F.lit(1).alias("num_turns"), F.lit(0.5).alias("total_cost_usd"), usage.alias("modelUsage")))
    folder = fresh_folder(spark)
    fixtures.write_texts(c.select(F.concat(base, F.lit(".json")).alias("name"), made.alias("text")), folder)
    fixtures.write_texts(_files(o, F.concat(base, F.lit("/audit.jsonl")), line, F.col("o_orderkey")), folder)
    lines = json_lines.read_lines(spark, f"{folder}/*/*/*/audit.jsonl").withColumn("session_key", F.regexp_extract("path", r"/([^/]+)/audit\.jsonl$", 1))
    return manifests.read_manifests(spark, folder), lines


@query(f"""WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS ms, arg_max(o_orderkey, o_orderkey) AS last, bool_or(o_orderkey % 2 = 0) AND bool_or(o_orderkey % 2 = 1) AS two FROM orders GROUP BY 1)
SELECT {_CLIENT} AS id, c_name AS title, c_mktsegment AS preview, 500 AS duration_ms, CASE WHEN n IS NOT NULL AND last % 2 = 0 THEN 'claude-haiku-4-5' ELSE 'claude-opus-4-6' END AS model, CASE WHEN two THEN 2 ELSE 1 END AS models, n * 0.5::DOUBLE AS total_cost_usd
FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_acctbal >= 0""")
def cowork_sessions(spark, sf):
    found, lines = _cowork(spark, sf)
    s = S.from_cowork(manifests.valid(found, manifests.COWORK_REQUIRED), json_lines.fold_audit(lines))
    return s.select("id", "title", "preview", "duration_ms", "model", F.size("models_used").alias("models"), "total_cost_usd")


@query(f"""SELECT concat('local_', {_CLIENT}) AS session_key, count(*) AS result_lines, sum(o_orderkey)::BIGINT AS duration_ms, (2 * count(*))::BIGINT AS duration_api_ms, count(*) AS num_turns, 0 AS malformed FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def audit_folds(spark, sf):
    return json_lines.fold_audit(_cowork(spark, sf)[1]).select("session_key", "result_lines", "duration_ms", "duration_api_ms", "num_turns", "malformed")


@query("SELECT 'notKnown' AS key FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def manifest_drift(spark, sf):
    return manifests.drift(_cowork(spark, sf)[0]).select("key")


def _desktop(spark, sf):
    """A desktop manifest for every third conversation, and one without a transcript for every fifth; a sixth of the latter lack a model."""
    m = V.table(spark, sf, "conversations").select("conv_id").distinct()
    has = m.where("conv_id % 3 = 0").select(F.col("conv_id"), _uuid(F.col("conv_id")).alias("key"))
    alone = m.where("conv_id % 5 = 0").select(F.col("conv_id"), _uuid(F.concat(F.lit("alone "), F.col("conv_id").cast("string"))).alias("key"))
    no_model = F.col("alone") & (F.col("conv_id") % 30 == 0)
    every = has.withColumn("alone", F.lit(False)).unionByName(alone.withColumn("alone", F.lit(True)))
    made = F.to_json(F.struct(
        F.concat(F.lit("local_"), F.col("key")).alias("sessionId"), F.col("key").alias("cliSessionId"), (F.col("conv_id") * 1000).alias("createdAt"), (F.col("conv_id") * 1000 + F.col("conv_id") % 7 - 3).alias("lastActivityAt"),
        F.concat(F.lit("desk "), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit("D:\\work\\desk-"), (F.col("conv_id") % 4).cast("string")).alias("cwd"), F.when(~no_model, "claude-sonnet-4-6").alias("model"),
    ))
    folder = fresh_folder(spark)
    fixtures.write_texts(every.select(F.concat_ws("/", "key", "key", F.concat(F.lit("local_"), F.col("key"), F.lit(".json"))).alias("name"), made.alias("text")), folder)
    return manifests.valid(manifests.read_manifests(spark, folder), manifests.DESKTOP_REQUIRED)


_ALONE = _UUID.format(h="md5(concat('alone ', conv_id))")


@query(f"""WITH t AS (SELECT *, conv_id % 3 = 0 AS desk FROM (SELECT conv_id, {_ID} AS id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS a,
  arg_max(CASE WHEN turn % 4 = 1 THEN 'claude-opus-4-6' ELSE 'claude-haiku-4-5' END, turn) FILTER (WHERE role = 'assistant') AS model FROM conversations GROUP BY 1))
SELECT id, CASE WHEN desk THEN 'cli-desktop' ELSE 'cli-direct' END AS source, user_turns, CASE WHEN desk THEN concat('desk ', conv_id) END AS title, CASE WHEN desk THEN concat('desk-', conv_id % 4) WHEN user_turns > 0 THEN concat('app-', conv_id % 7) END AS project,
CASE WHEN desk THEN coalesce(model, 'claude-sonnet-4-6') ELSE model END AS model FROM t""")
def desktop_enriched(spark, sf):
    """Transcripts under their manifests' id, title and folder; those without one as they are."""
    s = S.from_transcripts(written(json_lines.fold_transcripts(_transcripts(spark, sf))), _desktop(spark, sf))
    return s.select("id", "source", "user_turns", F.when(F.col("title_source") == "manifest", F.col("title")).alias("title"), "project", "model")


@query(f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), m AS (SELECT conv_id, {_ID} AS id FROM c WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, {_ALONE} FROM c WHERE conv_id % 5 = 0 AND conv_id % 30 <> 0)
SELECT id, 'cli-desktop' AS source, concat('desk ', conv_id) AS title, greatest(conv_id % 7 - 3, 0)::BIGINT AS duration_ms, 0::BIGINT AS user_turns, concat('desk-', conv_id % 4) AS project, 'claude-sonnet-4-6' AS model FROM m""")
def desktop_stubs(spark, sf):
    return S.desktop_stubs(_desktop(spark, sf)).select("id", "source", "title", "duration_ms", "user_turns", "project", "model")


def _export(spark, sf):
    """The conversations as an export: a file with an array for each partition."""
    m = V.table(spark, sf, "conversations")
    message = F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.coalesce("text", F.lit("")).alias("text"))
    talk = m.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda s: s["m"]).alias("chat_messages"))
    made = F.to_json(F.struct(_uuid(F.col("conv_id")).alias("uuid"), F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("name"), F.when(F.col("conv_id") % 10 != 0, "2024-01-01T00:00:00Z").otherwise("never").alias("created_at"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"), "chat_messages"))
    folder = fresh_folder(spark)
    fixtures.write_arrays(talk.select(made.alias("raw")), f"{folder}/export")
    return archives.read_conversations(spark, f"{folder}/export/part-*")


@query(rf"""SELECT {_ID} AS id, concat('talk ', conv_id) AS title, 86400000 AS duration_ms, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns,
nullif(left(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> ''), '\s+', ' ', 'g')), 200), '') AS preview FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id""")
def export_sessions(spark, sf):
    """Those with unreadable times are left out by the operator itself."""
    return S.from_conversations(_export(spark, sf)).select("id", "title", "duration_ms", "user_turns", "assistant_turns", "preview")


@query("SELECT count(DISTINCT conv_id) FILTER (WHERE conv_id % 10 <> 0) AS kept, count(DISTINCT conv_id) FILTER (WHERE conv_id % 10 = 0) AS skipped FROM conversations")
def export_skipped(spark, sf):
    return S.skipped(_export(spark, sf))


# Operators over results of others.
@query(f"""WITH k AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS n, left(sha256(norm), 12) AS cluster_id FROM ({_NORM}) WHERE length(norm) >= 40)
SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) - 1)::INT AS at, doc_id AS id, source FROM k JOIN documents USING (doc_id) WHERE n >= 2""")
def cluster_members(spark, sf):
    docs = V.table(spark, sf, "documents").withColumn("id", F.col("doc_id"))
    return duplicates.cluster_members(duplicates.exact_clusters(docs, "text", "id", "id"), docs, ["source"])


@query(f"WITH k AS (SELECT doc_id, norm FROM ({_NORM}) WHERE length(norm) >= 40 QUALIFY count(*) OVER (PARTITION BY norm) >= 2) SELECT doc_id AS session_id, left(sha256(norm), 12) AS cluster_id FROM k")
def duplicate_index(spark, sf):
    docs = V.table(spark, sf, "documents")
    return duplicates.session_index(duplicates.exact_clusters(docs, "text", "doc_id", "doc_id").withColumn("pos", F.get("session_ids", F.lit(0))))


@query(f"WITH s AS ({V.SESSIONS}) SELECT topic AS label, count(*) AS size FROM s WHERE source = 'cloud' AND topic IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def largest_clusters(spark, sf):
    return duplicates.largest_labels(V.sessions(spark, sf).withColumn("label", F.col("topic")), 3)


@query(f"""WITH {_LIFE}, f AS (SELECT project, min(started_at) AS first_active_at, arg_min(title, pos) AS display_name, max(CASE WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 0 END) AS r FROM s GROUP BY 1),
q AS (SELECT project, string_agg(id::VARCHAR, ',' ORDER BY started_at, pos) AS probe_ids FROM d WHERE asks AND gap >= 60 AND NOT dense GROUP BY 1)
SELECT c.project, classification, first_active_at, display_name, ['title_keyword', 'cwd_basename', 'project_field'][r + 1] AS inference_source, coalesce(probe_ids, '') AS probe_ids FROM c JOIN f USING (project) LEFT JOIN q USING (project)""")
def lifecycle_records(spark, sf):
    how = F.when(F.col("id") % 3 == 0, "project_field").when(F.col("id") % 3 == 1, "cwd_basename").otherwise("title_keyword")
    s = _projects(spark, sf).withColumn("display_name", F.col("title")).withColumn("inference_source", how)
    return lifecycle.project_records(s, V.NOW).select("project", "classification", "first_active_at", "display_name", "inference_source", F.array_join(F.transform("probe_ids", lambda x: x.cast("string")), ",").alias("probe_ids"))


@query(f"WITH {_LIFE} SELECT project, sessions FROM c WHERE classification = 'zombie'")
def lifecycle_displayed(spark, sf):
    return lifecycle.displayed(lifecycle.classify(_projects(spark, sf), V.NOW)).select("project", "sessions")


def _decimals(e, digits):
    """Rounded half up in decimals, as both engines' double formats differ on ties."""
    return f"CAST(CAST(round(CAST(({e})::VARCHAR AS DECIMAL(30, 12)), {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 1000 THEN concat('$', {_decimals("o_totalprice / 1000", 1)}, 'k') ELSE concat('$', {_decimals("o_totalprice", 2)}) END AS usd,
CASE WHEN o_orderkey >= 1000000 THEN concat({_decimals("o_orderkey / 1000000", 1)}, 'M') WHEN o_orderkey >= 1000 THEN concat({_decimals("o_orderkey / 1000", 1)}, 'k') ELSE o_orderkey::VARCHAR END AS count FROM orders""")
def number_formats(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), format_usd(F.col("o_totalprice")).alias("usd"), format_count(F.col("o_orderkey")).alias("count"))


@query("""WITH t AS (SELECT conv_id, turn, concat('## ', CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant' ELSE role END, chr(10), chr(10), coalesce(text, '')) AS part FROM conversations)
SELECT conv_id AS id, string_agg(part, concat(chr(10), chr(10)) ORDER BY turn) AS markdown FROM t GROUP BY 1""")
def markdown_export(spark, sf):
    return tables.markdown(V.messages(spark, sf))


@query(f"WITH s AS ({V.SESSIONS}) SELECT DISTINCT 'topic' AS kind, topic AS value FROM s WHERE topic IS NOT NULL")
def current_labels(spark, sf):
    """Labels of this corpus stay, those of an earlier one are discarded."""
    s = V.sessions(spark, sf)
    version = tables.corpus_version(s)
    labels = s.where("topic IS NOT NULL").select(F.lit("topic").alias("kind"), F.col("topic").alias("value"), F.lit(version).alias("version")).distinct()
    old = labels.withColumn("version", F.lit("earlier")).withColumn("value", F.concat("value", F.lit(" (earlier)")))
    return tables.current_labels(labels.unionByName(old), version)


@query("""WITH w AS (SELECT conv_id AS id, turn, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '`([^`\n]+)`', '<code>\1</code>', 'g') AS html FROM conversations WHERE text NOT LIKE '%*%' AND text NOT LIKE '%](%') SELECT * FROM w""")
def inline_markup(spark, sf):
    m = V.table(spark, sf, "conversations").where("text NOT LIKE '%*%' AND text NOT LIKE '%](%'")
    return m.select(F.col("conv_id").alias("id"), "turn", inline_html(F.col("text")).alias("html"))


@query()
def project_plane(spark, sf):
    return topics.plane(V.vectors(spark, sf).select(F.col("vec_id").alias("doc"), "vec"))


@query()
def project_neighbours(spark, sf):
    """A plane on which neighbours stay neighbours; no SQL, tests hold the neighbours and the plane to all pairs."""
    return layout.neighbour_plane(V.vectors(spark, sf).select(F.col("vec_id").alias("doc"), "vec"))


def _turn_lines(spark, sf):
    """(id, pos, kind, raw): each turn as a transcript line; every third turn answers with a tool call, every fifth is one string."""
    pos, text = F.col("pos"), F.col("text")
    said = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command: string>").alias("input"))
    call = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run "), pos.cast("string")).alias("command")).alias("input"))
    blocks = F.when(pos % 3 == 1, F.array(said, call)).otherwise(F.array(said))
    kind = F.when(F.col("sender") == "human", "user").otherwise("assistant")
    line = F.when(pos % 5 == 2, F.to_json(F.struct(kind.alias("type"), F.struct(text.alias("content")).alias("message")))).otherwise(F.to_json(F.struct(kind.alias("type"), F.struct(blocks.alias("content")).alias("message"))))
    return V.messages(spark, sf).select("id", "pos", kind.alias("kind"), line.alias("raw"))


_BODY = """SELECT conv_id AS id, turn AS pos, coalesce(text, '') AS t, turn % 5 <> 2 AND turn % 3 = 1 AS calls, turn % 5 = 2 AS plain FROM conversations"""


@query(rf"""WITH b AS (SELECT id, pos, CASE WHEN calls THEN concat(t, CASE WHEN t <> '' THEN concat(chr(10), chr(10), '---', chr(10), chr(10)) ELSE '' END, 'Bash', chr(10), '{{', chr(10), '  "command": "run ', pos, '"', chr(10), '}}') ELSE t END AS body,
  trim(regexp_replace(t, '\s+', ' ', 'g')) AS s, calls, plain FROM ({_BODY})),
p AS (SELECT *, CASE WHEN plain AND length(s) > 1500 THEN concat(left(s, 1500), '…(+', length(s) - 1500, ' chars)') WHEN NOT plain AND length(s) > 600 THEN concat(left(s, 600), '…(+', length(s) - 600, ' chars)') ELSE s END AS said FROM b)
SELECT id, pos, body, body <> '' AND length(body) > 1200 AND body <> CASE WHEN calls THEN concat(said, CASE WHEN said <> '' THEN ' · ' ELSE '' END, 'Bash · run ', pos) ELSE said END AS expands FROM p""")
def line_bodies(spark, sf):
    """Whole bodies of lines, and whether a preview leaves something to expand."""
    lines = _turn_lines(spark, sf).withColumn("body", line_body("raw")).withColumn("preview", line_preview("raw"))
    return lines.select("id", "pos", "body", should_expand(F.col("preview"), F.col("body")).alias("expands"))


@query("SELECT p_partkey AS id, left(concat_ws(chr(10), nullif(p_name, ''), CASE WHEN p_size % 2 = 0 THEN repeat(concat(p_brand, ' '), 300) END, nullif(p_type, '')), 2000) AS text FROM part")
def project_texts(spark, sf):
    """What projects are embedded by: names, descriptions (some missing, some long), templates."""
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), S.project_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat("p_brand", F.lit(" ")), F.lit(300))), F.col("p_type")).alias("text"))


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, CASE WHEN source = 'cloud' THEN 'cloud + upload' ELSE concat(source, ' + cloud + upload') END AS sources FROM s")
def merged_labels(spark, sf):
    s = V.sessions(spark, sf)
    return s.select("id", merge.merge_labels(F.col("source"), F.concat(F.lit("cloud + "), F.col("source")), F.lit("upload + cloud")).alias("sources"))


@query(f"""WITH d AS (SELECT doc_id, n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat({_decimals("n / 1024", 1)}, ' KB') ELSE concat({_decimals("n / 1048576", 1)}, ' MB') END AS shown FROM d""")
def byte_sizes(spark, sf):
    n = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 100).otherwise(100_000)
    return V.table(spark, sf, "documents").select("doc_id", format_bytes(n).alias("shown"))


@query("SELECT doc_id, regexp_replace(text, '[#*`>]', '', 'g') AS text FROM documents")
def stripped_markdown(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", strip_markdown(F.col("text")).alias("text"))


@query(f"SELECT {_ID} AS id, nullif(arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'user'), '') AS text FROM conversations GROUP BY conv_id")
def first_messages(spark, sf):
    """The stricter rule: the first human message alone."""
    return S.first_message_text(_export(spark, sf))


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END AS head, coalesce(text, '') AS body FROM conversations)
SELECT conv_id AS id, string_agg(concat('### ', head, ' (', turn, ')', chr(10), chr(10), body), concat(chr(10), chr(10)) ORDER BY turn) AS markdown FROM t GROUP BY 1""")
def local_markdown_export(spark, sf):
    """The local variant of a transcript as Markdown."""
    m = V.messages(spark, sf)
    lines = m.select("id", F.col("pos").alias("line_no"), F.when(F.col("sender") == "human", "user").otherwise("assistant").alias("kind"), F.col("text").alias("body"), F.col("pos").cast("string").alias("at"))
    return tables.local_markdown(lines)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark, sf):
    """A stream that brings every event twice, each kept once."""
    events = activity.read_events(spark, f"{sf}/events.parquet")
    return activity.drain(activity.once(events.union(events))).select("event_id", "user_id", "event_type")


@query(rf"""WITH x AS (SELECT source AS cluster, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM documents), c AS (SELECT cluster, token, count(DISTINCT doc_id) AS docs, count(*) AS total FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY docs DESC, total DESC, token) AS k FROM c), n AS (SELECT source AS cluster, count(*) AS size FROM documents GROUP BY 1)
SELECT n.cluster, coalesce(string_agg(token, ' + ' ORDER BY k), '') AS label, any_value(size) AS size FROM n LEFT JOIN r ON r.cluster = n.cluster AND k <= 3 GROUP BY 1""")
def cluster_terms(spark, sf):
    """Labels that k-means clusters get, for clusters that SQL knows too: tokens of most members, then most uses, then by name."""
    d = V.table(spark, sf, "documents")
    runs = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.octet_length(w) > 2)
    return topics.kmeans_labels(d.select(F.col("doc_id").alias("doc"), F.col("source").alias("cluster")), d.select(F.col("doc_id").alias("doc"), runs.alias("tokens")))


@query(f"SELECT {_ID} AS id, coalesce(string_agg(text, '\n' ORDER BY turn) FILTER (WHERE role = 'user' AND text <> ''), '') AS texts FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id")
def human_texts(spark, sf):
    """All texts of the human side, in order."""
    return S.from_conversations(_export(spark, sf)).select("id", F.array_join("human_texts", "\n").alias("texts"))


_CUT80 = r"nullif(left(trim(regexp_replace({}, '\s+', ' ', 'g')), 80), '')"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('ai ', doc_id) END AS ai, CASE WHEN doc_id % 3 < 2 THEN {_CUT80.format("concat('  asked ', text)")} END AS p, CASE WHEN doc_id % 2 = 0 THEN {_CUT80.format("text")} END AS f FROM documents)
SELECT doc_id, coalesce(ai, p, f, '{UNTITLED}') AS title, CASE WHEN ai IS NOT NULL THEN 'ai-title' WHEN p IS NOT NULL THEN 'last-prompt' WHEN f IS NOT NULL THEN 'first-prompt' ELSE 'fallback' END AS title_source FROM d""")
def title_cascade(spark, sf):
    k, text = F.col("doc_id"), F.col("text")
    title, source = S.title_cascade(F.when(k % 3 == 0, F.concat(F.lit("ai "), k.cast("string"))), F.when(k % 3 < 2, F.concat(F.lit("  asked "), text)), F.when(k % 2 == 0, text))
    return V.table(spark, sf, "documents").select("doc_id", title.alias("title"), source.alias("title_source"))


@query(f"WITH s AS ({V.SESSIONS}) SELECT id FROM s WHERE user_turns > 0 AND id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def tool_filter(spark, sf):
    return search.filter_sessions(_searchable(spark, sf), tool="click").select("id")


@query(f"""WITH h AS (SELECT sha256(norm) AS hash, count(*) AS size FROM ({_NORM}) WHERE length(norm) >= 40 GROUP BY 1 HAVING count(*) >= 2)
SELECT hash, size, row_number() OVER (ORDER BY size DESC, hash)::INT AS rank FROM h ORDER BY rank LIMIT 20""")
def top_duplicates(spark, sf):
    """The twenty largest clusters in their order."""
    found = duplicates.ordered(duplicates.exact_clusters(V.table(spark, sf, "documents"), "text", "doc_id", "doc_id").select("hash", "size")).limit(20)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "hash")))  # twenty rows


_RAW = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH d AS (SELECT doc_id, text, {_RAW} AS raw, left({_RAW}, 47) AS head FROM documents), k AS (SELECT *, CASE WHEN strpos(reverse(head), ' ') > 0 THEN 47 - strpos(reverse(head), ' ') ELSE 0 END AS space FROM d)
SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) AS cut, CASE WHEN length(text) <= 60 THEN text ELSE concat(left(text, 59), '…') END AS short,
CASE WHEN length(raw) <= 48 THEN raw ELSE concat(regexp_replace(left(raw, CASE WHEN space >= 31 THEN space ELSE 47 END), '\s+$', ''), '…') END AS title FROM k""")
def text_cuts(spark, sf):
    """The three ways to cut a text: squeezed, with an ellipsis, and at a word."""
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", truncate(t, 120).alias("cut"), ellipsis(t, 60).alias("short"), cut_title(t).alias("title"))


@query("""SELECT concat(conv_id, ',', turn, ',', CASE WHEN regexp_matches(text, '[,"\n]') THEN concat('"', replace(text, '"', '""'), '"') ELSE coalesce(text, '') END) AS value FROM conversations""")
def csv_export(spark, sf):
    return tables.csv_lines(V.table(spark, sf, "conversations").select("conv_id", "turn", "text"))


@query(f"WITH s AS ({V.SESSIONS}), n AS (SELECT unnest(['cloud', 'cowork', 'cli-direct', 'cli-desktop']) AS source) SELECT n.source, count(s.id) AS n FROM n LEFT JOIN s ON s.source = n.source AND s.source <> 'cowork' GROUP BY 1")
def stored_counts(spark, sf):
    """The manifest of a store whose cowork sessions vanished in a second run that scanned cloud and cowork."""
    s, folder = V.sessions(spark, sf).select("id", "source", "title"), fresh_folder(spark)
    tables.write_sessions(s, folder)
    tables.write_sessions(s.where("source = 'cloud'"), folder, ("cloud", "cowork"))
    return tables.manifest(tables.all_sessions(spark, folder), 0).select(F.explode("counts").alias("source", "n"))


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, title FROM s WHERE source = 'cloud'")
def stored_cloud(spark, sf):
    """Cloud sessions of an earlier run, with their shape asserted."""
    folder = fresh_folder(spark)
    tables.write_sessions(V.sessions(spark, sf).select("id", "source", "title"), folder)
    return tables.assert_shape(tables.previous(spark, folder, "cloud")).select("id", "title")


@query(f"WITH s AS ({V.SESSIONS}) SELECT id, started_at AS completed_at FROM s WHERE id % 7 <> 0 AND user_turns > 0")
def healed_rows(spark, sf):
    """A stored list whose rows that fail are deleted when it is read."""
    folder = fresh_folder(spark)
    rows = V.sessions(spark, sf).select("id", F.col("started_at").alias("completed_at"), F.when(F.col("id") % 7 != 0, F.col("user_turns")).alias("score"))
    rows.write.parquet(f"{folder}/v=1")
    tables.healed(spark, folder, F.col("score") > 0)
    return tables.healed(spark, folder, F.col("score") > 0).select("id", "completed_at")


@query("SELECT user_id AS session, count(*) AS chunks, max(coalesce(value, 0)) AS best FROM events GROUP BY 1 HAVING count(*) >= 3")
def stream_complete(spark, sf):
    """Sessions of a stream of chunks, each given when all of its three chunks or more are there."""
    folder = fresh_folder(spark)
    V.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.lit(3).alias("expected"), F.coalesce("value", F.lit(0.0)).alias("sim")).write.parquet(folder)
    stream = spark.readStream.schema("session long, expected int, sim double").parquet(folder)
    return activity.drain(activity.complete_sessions(stream))


@query("""SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN (event_id % 5)::INT END AS phase FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""")
def progress_events(spark, sf):
    """A progress log with broken lines and drift warnings, which are left out."""
    k = F.col("event_id")
    said = F.when(k % 11 == 0, "Unknown line type x").when(k % 3 == 0, F.concat(F.lit("Phase "), (k % 5).cast("string"), F.lit(" of 5"))).otherwise("running")
    line = F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(said, F.lit(" #"), k.cast("string")).alias("message"))))
    found = activity.rescan_events(V.table(spark, sf, "events").select(line.alias("value")))
    return found.select(F.regexp_extract("message", r"#(\d+)$", 1).cast("long").alias("event_id"), "kind", "phase")


@query("SELECT concat('c', c_custkey) AS id, md5(c_name) AS hash, concat('s', c_custkey) AS session_ids, c_name AS sample_text FROM customer WHERE c_custkey % 4 <> 0")
def parsed_clusters(spark, sf):
    """Cluster files with members and clusters of wrong types, and some that are no JSON."""
    c = V.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    good = F.concat(F.lit('{"id": "c'), key, F.lit('", "hash": "'), F.md5("c_name"), F.lit('", "sessionIds": ["s'), key, F.lit('", 5, null], "sampleText": "'), F.col("c_name"), F.lit('"}'))
    text = F.when(F.col("c_custkey") % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"clusters": ['), good, F.lit(', {"id": 7}, "x", {"id": "y", "hash": "h", "sessionIds": "z", "sampleText": "t"}]}')))
    return duplicates.parse_clusters(c.select(text.alias("value"))).select("id", "hash", F.array_join("session_ids", ",").alias("session_ids"), "sample_text")


@query("SELECT concat('bot-', conv_id % 3) AS sender, min(conv_id) AS first_id FROM conversations WHERE turn % 9 = 4 GROUP BY 1")
def sender_drift(spark, sf):
    m = V.messages(spark, sf).where("sender IN ('human', 'assistant')")
    return json_lines.unknown_senders(m.withColumn("sender", F.when(F.col("pos") % 9 == 4, F.concat(F.lit("bot-"), (F.col("id") % 3).cast("string"))).otherwise(F.col("sender"))))
