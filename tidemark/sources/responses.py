"""Nested API response documents to flat rows.

Input: one JSON document per row in a text column. Each document is parsed once with a schema;
null nodes and nodes without an id are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: README paths in order of preference
README_PATHS = (
    "README.md",
    "readme.md",
    "Readme.md",
    "README.rst",
    "README",
    "README.markdown",
    "README.txt",
)
NAMES = "STRUCT<nodes: ARRAY<STRUCT<name: STRING>>>"
LABELS_WITH_COLOR = "STRUCT<nodes: ARRAY<STRUCT<name: STRING, color: STRING>>>"
COUNT = "STRUCT<totalCount: BIGINT>"
TOPICS = "STRUCT<nodes: ARRAY<STRUCT<topic: STRUCT<name: STRING>>>>"
BLOB = "STRUCT<object: STRUCT<text: STRING, isBinary: BOOLEAN>>"

REPO_LABELS = f"""data STRUCT<nodes: ARRAY<STRUCT<databaseId: BIGINT, nameWithOwner: STRING, createdAt: STRING,
  isFork: BOOLEAN, isArchived: BOOLEAN, stargazerCount: BIGINT, labels: {NAMES}>>>"""
COMMIT = "STRUCT<oid: STRING, committedDate: STRING, " + ", ".join(
    f"f{i}: {BLOB}" for i in range(len(README_PATHS))
) + ">"
REPO_DETAILS = f"""data STRUCT<nodes: ARRAY<STRUCT<databaseId: BIGINT, nameWithOwner: STRING, description: STRING,
  createdAt: STRING, pushedAt: STRING, isFork: BOOLEAN, isArchived: BOOLEAN, stargazerCount: BIGINT, forkCount: BIGINT,
  licenseInfo: STRUCT<spdxId: STRING>, primaryLanguage: STRUCT<name: STRING>, languages: {NAMES}, repositoryTopics: {TOPICS},
  defaultBranchRef: STRUCT<target: STRUCT<history: STRUCT<nodes: ARRAY<{COMMIT}>>>>>>>"""
ISSUE_NODE = f"""STRUCT<number: BIGINT, title: STRING, body: STRING, createdAt: STRING, updatedAt: STRING,
  labels: {LABELS_WITH_COLOR}, comments: {COUNT}, assignees: {COUNT}>"""
# one alias per repository of the request: a map from alias to node
OPEN_ISSUES = f"""data MAP<STRING, STRUCT<databaseId: BIGINT, issues: STRUCT<nodes: ARRAY<{ISSUE_NODE}>>>>"""
FRESH_HITS = f"""data STRUCT<search: STRUCT<nodes: ARRAY<STRUCT<number: BIGINT, title: STRING, body: STRING,
  createdAt: STRING, updatedAt: STRING, labels: {LABELS_WITH_COLOR}, comments: {COUNT}, assignees: {COUNT},
  repository: STRUCT<databaseId: BIGINT, nameWithOwner: STRING, description: STRING, createdAt: STRING, stargazerCount: BIGINT,
    isFork: BOOLEAN, isArchived: BOOLEAN, primaryLanguage: STRUCT<name: STRING>, repositoryTopics: {TOPICS}>>>>>"""


def _names(nodes: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(nodes, lambda n: n["name"]), none)


def _colors(nodes: Column) -> Column:
    known = F.filter(nodes, lambda n: n["name"].isNotNull())
    pairs = F.transform(known, lambda n: F.struct(n["name"].alias("key"), n["color"].alias("value")))
    return F.map_from_entries(F.array_distinct(pairs))


def _nodes(df: DataFrame, column: str, schema: str) -> DataFrame:
    parsed = df.select(F.from_json(column, schema).alias("d"))
    return parsed.select(F.explode("d.data.nodes").alias("n")).filter(F.col("n.databaseId").isNotNull())


def flatten_repo_labels(df: DataFrame, column: str = "body") -> DataFrame:
    """repo_id, name, created_at, is_fork, is_archived, stars, labels."""
    return _nodes(df, column, REPO_LABELS).select(
        F.col("n.databaseId").alias("repo_id"),
        F.col("n.nameWithOwner").alias("name"),
        F.col("n.createdAt").alias("created_at"),
        F.col("n.isFork").alias("is_fork"),
        F.col("n.isArchived").alias("is_archived"),
        F.col("n.stargazerCount").alias("stars"),
        _names(F.col("n.labels.nodes")).alias("labels"),
    )


def flatten_repo_details(df: DataFrame, column: str = "body") -> DataFrame:
    """One row per repository with the first README of its last commit that is text."""
    commit = F.get(F.col("n.defaultBranchRef.target.history.nodes"), F.lit(0))

    def readme(i: int) -> Column:
        blob = F.col(f"commit.f{i}.object")
        text = F.col(f"commit.f{i}.object.text")
        usable = blob.isNotNull() & (F.length(text) > 0) & ~F.coalesce(F.col(f"commit.f{i}.object.isBinary"), F.lit(False))
        return F.when(usable, text)

    topics = F.transform("n.repositoryTopics.nodes", lambda t: t["topic"]["name"])
    return _nodes(df, column, REPO_DETAILS).withColumn("commit", commit).select(
        F.col("n.databaseId").alias("repo_id"),
        F.col("n.nameWithOwner").alias("name"),
        F.coalesce("n.description", F.lit("")).alias("description"),
        F.col("n.createdAt").alias("created_at"),
        F.col("n.pushedAt").alias("pushed_at"),
        F.col("n.isFork").alias("is_fork"),
        F.col("n.isArchived").alias("is_archived"),
        F.col("n.stargazerCount").alias("stars"),
        F.col("n.forkCount").alias("forks"),
        F.col("n.licenseInfo.spdxId").alias("license"),
        F.col("n.primaryLanguage.name").alias("language"),
        _names(F.col("n.languages.nodes")).alias("languages"),
        F.coalesce(topics, F.array().cast("array<string>")).alias("topics"),
        F.col("commit.committedDate").alias("readme_commit_date"),
        F.coalesce(*[readme(i) for i in range(len(README_PATHS))], F.lit("")).alias("readme"),
    )


def flatten_issue_dates(df: DataFrame, column: str = "body") -> DataFrame:
    """repo_id, created_at of every labelled issue."""
    return _issue_nodes(df, column).select("repo_id", F.col("i.createdAt").alias("created_at"))


def _issue_nodes(df: DataFrame, column: str) -> DataFrame:
    parsed = df.select(F.from_json(column, OPEN_ISSUES).alias("d"))
    repos = parsed.select(F.explode("d.data").alias("alias", "r")).filter(F.col("r.databaseId").isNotNull())
    return repos.select(F.col("r.databaseId").alias("repo_id"), F.explode("r.issues.nodes").alias("i")).filter(
        F.col("i").isNotNull()
    )


def _issue_columns(node: str) -> list[Column]:
    labels = F.col(f"{node}.labels.nodes")
    return [
        F.col(f"{node}.number").alias("number"),
        F.col(f"{node}.title").alias("title"),
        F.coalesce(f"{node}.body", F.lit("")).alias("body"),
        F.col(f"{node}.createdAt").alias("created_at"),
        F.col(f"{node}.updatedAt").alias("updated_at"),
        _names(labels).alias("labels"),
        _colors(labels).alias("label_colors"),
        F.coalesce(f"{node}.comments.totalCount", F.lit(0)).alias("n_comments"),
        F.coalesce(f"{node}.assignees.totalCount", F.lit(0)).alias("n_assignees"),
    ]


def flatten_issues(df: DataFrame, column: str = "body") -> DataFrame:
    """One row per open issue with labels and their colours."""
    return _issue_nodes(df, column).select("repo_id", *_issue_columns("i"))


def flatten_fresh_hits(df: DataFrame, column: str = "body") -> DataFrame:
    """One row per issue found by the search, with the facts of its repository."""
    parsed = df.select(F.from_json(column, FRESH_HITS).alias("d"))
    hits = parsed.select(F.explode("d.data.search.nodes").alias("i")).filter(F.col("i.repository.databaseId").isNotNull())
    topics = F.transform("i.repository.repositoryTopics.nodes", lambda t: t["topic"]["name"])
    return hits.select(
        F.col("i.repository.databaseId").alias("repo_id"),
        F.col("i.repository.nameWithOwner").alias("name"),
        F.coalesce("i.repository.description", F.lit("")).alias("description"),
        F.col("i.repository.createdAt").alias("repo_created_at"),
        F.col("i.repository.stargazerCount").alias("stars"),
        F.col("i.repository.isFork").alias("is_fork"),
        F.col("i.repository.isArchived").alias("is_archived"),
        F.col("i.repository.primaryLanguage.name").alias("language"),
        F.coalesce(topics, F.array().cast("array<string>")).alias("topics"),
        *_issue_columns("i"),
    )
