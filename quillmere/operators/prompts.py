"""The prompt registry as a table: versions, activation, evaluation results, diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .checks import check_template, template_variables

SCHEMA = "prompt_id string, prompt_version string, template string, variables array<string>, status string, parent_version string, change_summary string, eval_result_id string, created_at timestamp, activated_at timestamp, activated_by string"
STATUSES = ("draft", "testing", "active", "archived")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _this(prompt_id: str, version: str) -> F.Column:
    return (F.col("prompt_id") == prompt_id) & (F.col("prompt_version") == version)


def create(registry: DataFrame, rows: DataFrame, if_absent: bool = False) -> DataFrame:
    """registry plus new versions. Active ones, and templates whose variables do not fit, raise; versions
    that exist raise, or are left out with if_absent."""
    if rows.where("status = 'active'").limit(1).count():
        raise ValueError("a new version can't be active")
    bad = rows.withColumn("_c", check_template(F.col("template"), F.col("variables"))).where("size(_c.missing) + size(_c.undeclared) > 0")
    if bad.limit(1).count():
        raise ValueError("template and variables differ")
    new = rows.join(registry.select("prompt_id", "prompt_version"), ["prompt_id", "prompt_version"], "left_anti")
    if not if_absent and new.count() < rows.count():
        raise ValueError("the version exists")
    return registry.unionByName(new.select(*registry.columns))


def versions(registry: DataFrame, prompt_id: str) -> DataFrame:
    """A prompt's versions in order, each with the one created before it."""
    w = Window.partitionBy("prompt_id").orderBy("created_at", "prompt_version")
    return registry.where(F.col("prompt_id") == prompt_id).withColumn("previous", F.lag("prompt_version").over(w))


def pinned(registry: DataFrame, prompt_id: str, version: str | None = None) -> DataFrame:
    """The row of a version of any status, or the active one; none is an error."""
    found = registry.where(_this(prompt_id, version) if version else (F.col("prompt_id") == prompt_id) & (F.col("status") == "active"))
    if not found.limit(1).count():
        raise KeyError((prompt_id, version))
    return found


def set_result(registry: DataFrame, prompt_id: str, version: str, result: str) -> DataFrame:
    pinned(registry, prompt_id, version)
    return registry.withColumn("eval_result_id", F.when(_this(prompt_id, version), result).otherwise(F.col("eval_result_id")))


def activate(registry: DataFrame, prompt_id: str, version: str, by: str, at: str, override: str | None = None) -> DataFrame:
    """One version active, the other active one archived. Without an evaluation result a reason is
    needed, which is then added to the version's summary."""
    row = pinned(registry, prompt_id, version).first()
    forced = row["eval_result_id"] is None
    if forced and not override:
        raise ValueError("no evaluation result; give a reason to override")
    this, other = _this(prompt_id, version), (F.col("prompt_id") == prompt_id) & (F.col("status") == "active")
    note = F.concat_ws(" ", "change_summary", F.lit(f"[override by {by}: {override}]")) if forced else F.col("change_summary")
    return registry.withColumns({
        "status": F.when(this, "active").when(other, "archived").otherwise(F.col("status")), "activated_at": F.when(this, F.lit(at).cast("timestamp")).otherwise(F.col("activated_at")),
        "activated_by": F.when(this, by).otherwise(F.col("activated_by")), "change_summary": F.when(this, note).otherwise(F.col("change_summary")),
    })


def seed(registry: DataFrame, rows: DataFrame, production: str, by: str, at: str) -> DataFrame:
    """registry with seed versions put in where they are absent, as testing; each prompt of them without an active version
    gets production as its active one, with a bootstrap note. Run again, it changes nothing."""
    out = create(registry, rows.withColumn("status", F.lit("testing")), if_absent=True)
    prompts = {r.prompt_id for r in rows.select("prompt_id").distinct().collect()}
    active = {r.prompt_id for r in out.where("status = 'active'").select("prompt_id").distinct().collect()}
    for p in sorted(prompts - active):
        out = activate(out, p, production, by, at, "bootstrap: no version was active")
    return out


def broken(registry: DataFrame) -> DataFrame:
    """Prompts with more than one active version."""
    return registry.where("status = 'active'").groupBy("prompt_id").count().where("count > 1")


@F.arrow_udf(StringType())
def unified_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Unified diff of two templates, empty if they are equal."""
    for a, b in batches:
        yield pa.array(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "old", "new", lineterm="")) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())


__all__ = ["SCHEMA", "STATUSES", "activate", "broken", "create", "empty", "pinned", "seed", "set_result", "template_variables", "unified_diff", "versions"]
