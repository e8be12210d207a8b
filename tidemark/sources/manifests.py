"""Session manifests as JSON files: discovery by path, type-checked fields, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_lines import UUID, _number, _string, load

#: Fields without which a manifest is refused.
COWORK_REQUIRED = ("sessionId", "createdAt", "lastActivityAt", "title", "cwd")
DESKTOP_REQUIRED = ("sessionId", "cliSessionId", "createdAt", "lastActivityAt", "title", "cwd", "model")
#: Manifest members that are no drift, of either kind.
KNOWN_KEYS = (
    "sessionId", "processName", "cliSessionId", "cwd", "userSelectedFolders", "createdAt", "lastActivityAt", "model", "isArchived", "title", "vmProcessName", "initialMessage", "slashCommands", "enabledMcpTools",
    "remoteMcpServersConfig", "egressAllowedDomains", "systemPrompt", "accountName", "emailAddress", "userApprovedFileAccessPaths", "mcqAnswers", "hostLoopMode", "orgCliExecPolicies", "memoryEnabled", "scheduledTaskId", "sessionType", "error",
)
DESKTOP_KNOWN_KEYS = (
    "sessionId", "cliSessionId", "cwd", "originCwd", "createdAt", "lastActivityAt", "model", "effort", "isArchived", "title", "titleSource", "permissionMode", "chromePermissionMode", "enabledMcpTools", "remoteMcpServersConfig",
)
_NUMBERS = {"createdAt", "lastActivityAt"}
_SHAPE = f"/{UUID}/{UUID}/local_[0-9a-f-]{{36}}\\.json$"


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ms, raw, v) of root/<uuid>/<uuid>/local_<id>.json; other files and folders are left out; v is null if it is no JSON."""
    found = load(spark.read.option("wholetext", True), "text", f"{root.rstrip('/')}/*/*/local_*.json")
    if found is None:
        return spark.createDataFrame([], "path string, mtime_ms double, raw string").withColumn("v", F.try_parse_json("raw"))
    files = found.select(F.col("_metadata.file_path").alias("path"), (F.unix_micros("_metadata.file_modification_time") / 1000.0).alias("mtime_ms"), F.col("value").alias("raw"))
    return files.where(F.col("path").rlike(_SHAPE)).withColumn("v", F.try_parse_json("raw"))


def valid(manifests: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Manifests with every required member, of the right type, as columns; the rest is refused."""
    field = lambda k: _number("v", f"$.{k}") if k in _NUMBERS else _string("v", f"$.{k}")
    df = manifests.select(
        "path", "mtime_ms", "raw", field("sessionId").alias("session_key"), F.coalesce(field("cliSessionId"), F.regexp_replace(field("sessionId"), "^local_", "")).alias("id"), field("cliSessionId").alias("cli_session_id"), field("createdAt").alias("created_at"),
        field("lastActivityAt").alias("last_activity_at"), field("title").alias("title"), field("cwd").alias("cwd"), field("model").alias("model"), field("initialMessage").alias("initial_message"),
    )
    names = {"sessionId": "session_key", "cliSessionId": "cli_session_id", "createdAt": "created_at", "lastActivityAt": "last_activity_at"}
    for k in required:
        df = df.where(F.col(names.get(k, k)).isNotNull())
    return df


def drift(manifests: DataFrame, known=KNOWN_KEYS) -> DataFrame:
    """Members that aren't known, each once with the first file that has it."""
    keys = manifests.where("v IS NOT NULL").select("path", F.explode(F.json_object_keys("raw")).alias("key"))
    return keys.where(~F.col("key").isin(*known)).groupBy("key").agg(F.min("path").alias("first_path"))
