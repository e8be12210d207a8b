"""Keyed merges, overlays, validation and set differences of session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MERGE_ORDER, REQUIRED


def _best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key; a struct aggregate, so rows are combined before the shuffle and no key is sorted in one task."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return best.select("_row.*")


def richness(df: DataFrame, ignore: tuple[str, ...] = ()) -> Column:
    """How many fields of a record are present."""
    out = F.lit(0)
    for c in df.columns:
        if c not in ignore:
            out = out + F.col(c).isNotNull().cast("int")
    return out


def merge_sources(*parts: tuple[str, DataFrame], key=("source", "id"), position: str = "pos") -> DataFrame:
    """Union of (part name, records); of records with one key the one with most fields present stays, of equals the later in MERGE_ORDER, then in position."""
    rank = {name: i for i, name in enumerate(MERGE_ORDER)}
    tagged = [df.withColumn("_rich", richness(df, (position,))).withColumn("_part", F.lit(rank.get(name, i))) for i, (name, df) in enumerate(parts)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    return _best(both, list(key), [F.col("_rich"), F.col("_part"), F.col(position)]).drop("_rich", "_part")


def merge_uploads(existing: DataFrame, incoming: DataFrame, key: str = "id", newer: str = "updated_at", tie: str = "existing") -> DataFrame:
    """Union by key; the newer record stays. Equal times keep the existing one for entries, and take the incoming one for bodies (``tie='incoming'``)."""
    order = {"existing": (1, 0), "incoming": (0, 1)}[tie]
    both = existing.withColumn("_prefer", F.lit(order[0])).unionByName(incoming.withColumn("_prefer", F.lit(order[1])), allowMissingColumns=True)
    return _best(both, [key], [F.col(newer), F.col("_prefer")]).drop("_prefer")


def merge_labels(*labels: Column) -> Column:
    """Source labels, distinct in order, joined."""
    return F.array_join(F.array_distinct(F.flatten(F.array(*[F.split(x, r" \+ ") for x in labels]))), " + ")


def overlay_uploaded(fetched: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Uploaded sessions replace the fetched ones of source cloud."""
    return fetched.where(F.col("source") != "cloud").unionByName(uploaded, allowMissingColumns=True)


def delete_sources(sessions: DataFrame, sources: list[str]) -> DataFrame:
    return sessions.where(~F.col("source").isin(*sources)) if sources else sessions


def validation_errors(sessions: DataFrame, required=REQUIRED, key=("source", "id")) -> DataFrame:
    """One row a missing required field; no rows means valid."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return sessions.select(*key, F.explode(missing).alias("field"))


def stale_ids(current: DataFrame, analyzed: DataFrame, key: str) -> DataFrame:
    """Keys of the corpus that the last analysis hasn't seen."""
    return current.select(key).distinct().join(analyzed.select(key), key, "left_anti")


def reusable(current: DataFrame, previous: DataFrame, key=("source", "id"), mtime: str = "source_mtime_ms") -> tuple[DataFrame, DataFrame]:
    """An incremental rescan: (previous records that are still good, current files to read again). Both the key and a positive mtime must be equal."""
    on = [*key, mtime]
    good = previous.where(F.col(mtime) > 0)
    return good.join(current.select(*on), on, "left_semi"), current.join(good.select(*on), on, "left_anti")
