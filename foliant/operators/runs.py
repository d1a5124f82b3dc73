"""Runs over documents: engines by name, staged extraction with early rejects, sessions, migration, bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedupe import local_wins, without_deleted

Stage = Callable[[DataFrame], DataFrame]
ENGINES: dict[str, Stage] = {}


def register(name: str) -> Callable[[Stage], Stage]:
    """Register an engine: a DataFrame to DataFrame function."""

    def add(f: Stage) -> Stage:
        ENGINES[name.strip().lower()] = f
        return f

    return add


@register("legacy")
def legacy(rows: DataFrame) -> DataFrame:
    """The rows as they are."""
    return rows


def engine(name: str | None) -> Stage:
    """An engine by name; unknown names give the legacy one."""
    return ENGINES.get((name or "").strip().lower(), ENGINES["legacy"])


def staged(rows: DataFrame, stages: list[tuple[str, Stage]]) -> DataFrame:
    """Apply stages in order; rows whose column reject is set by a stage stop there with the stage's name in status.

    A stage that does not set reject passes every row on; nothing is dropped, rejected rows are returned beside the rest."""
    live, out = rows, []
    for name, stage in stages:
        live = stage(live)
        if "reject" in live.columns:
            out.append(live.where("reject").withColumn("status", F.lit(f"rejected: {name}")).drop("reject"))
            live = live.where("not coalesce(reject, false)").drop("reject")
    done = live.withColumn("status", F.lit("ok"))
    for part in out:
        done = done.unionByName(part, allowMissingColumns=True)
    return done


def hydrate(wizards: DataFrame, parts: dict[str, DataFrame], key: str = "wizard_id") -> DataFrame:
    """Wizards with each part's value column (named after the part) by left joins, tombstones read as missing."""
    out = wizards
    for name, df in parts.items():
        out = out.join(without_deleted(df).select(key, F.col("value").alias(name)), key, "left")
    return out


def migrate(spark: SparkSession, local: DataFrame, cloud: DataFrame, keys: list[str], path: str) -> bool:
    """Write the merged legacy data once; a marker table makes later calls do nothing. True if it wrote."""
    marker = f"{path}/marker"
    try:
        if spark.read.parquet(marker).limit(1).count():
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    local_wins(local, cloud, keys).write.mode("overwrite").parquet(f"{path}/data")
    spark.range(1).write.mode("overwrite").parquet(marker)
    return True


def session_documents(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Documents of sessions after removals: the last addition of each, unless removed later."""
    last = added.groupBy("session_id", "document_id").agg(F.max_by("summary", "seq").alias("summary"), F.max("seq").alias("seq"))
    gone = removed.groupBy("session_id", "document_id").agg(F.max("seq").alias("gone"))
    return last.join(gone, ["session_id", "document_id"], "left").where("gone is null or gone < seq").drop("gone")


def evidence(records: DataFrame) -> DataFrame:
    """records, boxes and the level that so much evidence allows."""
    n = records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size("annotations")), F.lit(0)).alias("boxes"))
    return n.withColumn("status", F.when(F.col("records") < 5, "insufficient").when(F.col("records") < 15, "preliminary").otherwise("reliable"))


def supervised_pairs(edits: DataFrame) -> DataFrame:
    """Cluster and region edits (edit_id, label, members) to unordered member pairs; members of an edit are few."""
    m = F.array_sort(F.array_distinct("members"))
    pairs = F.flatten(F.transform(m, lambda a, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return edits.select("edit_id", "label", F.explode(pairs).alias("p")).select("edit_id", "label", "p.a", "p.b")
