"""Generated task rows for load tests, as many as are asked for, by expressions over a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(kind: str, *parts: tuple[int, Column]) -> Column:
    """kind-org-001-0001-...: numbers padded with zeros to a width."""
    return F.concat(F.lit(f"{kind}org"), *[F.format_string(f"-%0{width}d", n) for width, n in parts])


def tasks(spark: SparkSession, orgs: int, users: int, projects: int, per_project: int, owner: str = "user-1") -> DataFrame:
    """orgs x projects x per_project rows of a task table, all columns text or int, none null."""
    rows = spark.range(orgs * projects * per_project)
    org, project, task = (F.col(c) for c in ("org", "project", "task"))
    rows = rows.select((F.floor(F.col("id") / (projects * per_project)) + 1).alias("org"), (F.floor(F.col("id") / per_project) % projects + 1).alias("project"), (F.col("id") % per_project + 1).alias("task"))
    status = F.when(task % 7 == 0, "blocked").when(task % 5 == 0, "done").when(task % 3 == 0, "in_progress").otherwise("todo")
    org_id = numbered("", (3, org))
    return rows.select(
        numbered("task-", (3, org), (4, project), (4, task)).alias("id"),
        org_id.alias("org_id"),
        numbered("project-", (3, org), (4, project)).alias("project_id"),
        F.lit(owner).alias("owner_id"),
        F.concat_ws(" ", F.lit("Task"), F.concat_ws(".", project, task)).alias("title"),
        status.alias("status"),
        ((task - 1) % 5 + 1).cast("int").alias("priority"),
        numbered("user-", (3, org), (4, (project + task - 2) % users + 1)).alias("assignee_id"),
        ((task - 1) % 8 + 1).cast("int").alias("story_points"),
        F.lit("2026-01-01T00:00:00Z").alias("updated_at"),
        F.repeat(F.md5(F.concat_ws(":", org_id, project, task)), 3).alias("summary"),
    )
