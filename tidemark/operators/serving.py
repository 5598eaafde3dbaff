"""Tables behind a recommendation page: issue records, young repositories, facts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.labels import label_colors, label_difficulty, label_skills
from tidemark.functions.text import scrub_text
from tidemark.operators.items import short_name

# fixed values: limits of the young-repository pool
FRESH_MAX_AGE_DAYS, FRESH_MIN_STARS, FRESH_MAX_REPOS = 180, 10, 300


def issue_records(issues: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Clean issue rows: scrubbed title and snippet, at most eight labels, difficulty and skills.

    Difficulty and skills come from `features` (repo_id, number, difficulty, skills) when it has
    them, else from the labels.
    """
    rows = issues
    if features is None:
        rows = rows.withColumns(
            {"f_difficulty": F.lit(None).cast("string"), "f_skills": F.array().cast("array<string>")}
        )
    else:
        known = features.select(
            "repo_id", "number", F.col("difficulty").alias("f_difficulty"), F.col("skills").alias("f_skills")
        )
        rows = rows.join(known, ["repo_id", "number"], "left")
    by_label = label_difficulty(F.col("labels"))
    has_own = F.coalesce(F.length("f_difficulty") > 0, F.lit(False))
    skills = F.when(F.coalesce(F.size("f_skills"), F.lit(0)) > 0, F.col("f_skills")).otherwise(
        label_skills(F.col("labels"))
    )
    kept = F.slice("labels", 1, 8)
    return rows.select(
        "repo_id",
        "number",
        scrub_text(F.col("title"), 200).alias("title"),
        kept.alias("labels"),
        label_colors(kept, F.col("label_colors")).alias("label_colors"),
        "created_at",
        "updated_at",
        "n_comments",
        "n_assignees",
        F.when(has_own, F.col("f_difficulty")).otherwise(by_label).alias("difficulty"),
        F.when(has_own, "llm").when(by_label.isNotNull(), "labels").alias("difficulty_source"),
        F.slice(skills, 1, 4).alias("skills"),
        scrub_text(F.col("body"), 300).alias("snippet"),
    )


def fresh_pool(
    hits: DataFrame,
    catalog: DataFrame,
    now: int,
    max_age_days: int = FRESH_MAX_AGE_DAYS,
    min_stars: int = FRESH_MIN_STARS,
    max_repos: int = FRESH_MAX_REPOS,
) -> tuple[DataFrame, DataFrame]:
    """(repositories, issues) of the search hits that qualify.

    Repositories: not a fork, not archived, enough stars, born at most `max_age_days` ago, not in
    the catalog; the most starred `max_repos` of them. Issues: each number once per repository.
    `hits`: flat search hits with `repo_created` in seconds.
    """
    born = now - max_age_days * 86_400
    good = hits.filter(
        ~F.col("is_fork")
        & ~F.col("is_archived")
        & (F.col("stars") >= min_stars)
        & (F.col("repo_created") >= born)
    ).join(catalog.select("repo_id").distinct(), "repo_id", "left_anti")
    one = F.struct("name", "description", "language", "topics", "stars", "repo_created")
    repos = (
        good.groupBy("repo_id")
        .agg(F.min(one).alias("r"), F.count_distinct("number").alias("n_issues"))
        .select(
            "repo_id",
            "r.name",
            scrub_text(F.col("r.description"), 300).alias("description"),
            "r.language",
            "r.topics",
            "r.stars",
            "r.repo_created",
            "n_issues",
        )
        .orderBy(F.col("stars").desc(), "repo_id")
        .limit(max_repos)
    )
    issues = good.join(repos.select("repo_id"), "repo_id", "left_semi").dropDuplicates(["repo_id", "number"])
    return repos, issues


def snapshot_manifest(
    issues: DataFrame, fresh: DataFrame, repo_features: DataFrame, issue_features: DataFrame
) -> DataFrame:
    """(metric, value) counts of a snapshot."""
    count = F.count(F.lit(1))

    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value")

    return (
        one(issues, "open_issues", count)
        .unionByName(one(issues.select("repo_id").distinct(), "repos_with_issues", count))
        .unionByName(one(repo_features, "repos_with_features", count))
        .unionByName(one(issue_features, "issues_with_features", count))
        .unionByName(one(fresh, "fresh_repos", count))
    )


def collect_facts(picks: DataFrame, repos: DataFrame, issues: DataFrame, costars: DataFrame) -> DataFrame:
    """(user, repo_id, number, facts): sentences that hold for a pick, from the catalog only.

    `picks`: user, repo_id, number, claimed (names the user says to have starred), user_skills.
    A claim is kept only when it is a real co-starred neighbour of the repository. `repos`:
    repo_id, name, language, summary, description, topics, skills. `costars`: repo_id,
    neighbour_name. `issues`: repo_id, number, title, labels, difficulty.
    """
    claims = picks.select("user", "repo_id", "number", F.posexplode("claimed").alias("pos", "neighbour_name"))
    true_claims = (
        claims.join(costars.select("repo_id", "neighbour_name").distinct(), ["repo_id", "neighbour_name"], "left_semi")
        .groupBy("user", "repo_id", "number")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "neighbour_name"))).alias("c"))
        .select("user", "repo_id", "number", F.slice(F.transform("c", lambda x: x["neighbour_name"]), 1, 3).alias("shared"))
    )
    facts_issue = issues.select(
        "repo_id", "number", F.col("title").alias("i_title"), F.col("labels").alias("i_labels"), F.col("difficulty").alias("i_difficulty")
    )
    rows = (
        picks.join(repos, "repo_id")
        .join(true_claims, ["user", "repo_id", "number"], "left")
        .join(facts_issue, ["repo_id", "number"], "left")
    )
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, none), F.lower)
    known = F.array_union(
        F.array_union(low(F.col("skills")), F.array(F.lower(F.coalesce("language", F.lit(""))))), low(F.col("topics"))
    )
    match = F.slice(F.filter("user_skills", lambda s: F.array_contains(known, F.lower(s))), 1, 5)
    shared = F.coalesce("shared", none)
    language = F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("unknown"))
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    about = F.when(has("summary"), F.concat(F.lit("README summary: "), "summary")).when(
        has("description"), F.concat(F.lit("Description: "), "description")
    )
    sentences = F.array_compact(
        F.array(
            F.concat(F.lit("Repository: "), short_name(F.col("name")), F.lit(" (main language: "), language, F.lit(").")),
            about,
            F.when(
                F.size(shared) > 0,
                F.concat(
                    F.lit("People who starred "),
                    F.array_join(shared, ", "),
                    F.lit(" (which you starred) also starred this repository."),
                ),
            ),
            F.when(
                F.size(match) > 0,
                F.concat(F.lit("Skills you have that the project uses: "), F.array_join(match, ", "), F.lit(".")),
            ),
            F.when(
                F.col("i_title").isNotNull(),
                F.concat(
                    F.lit('Suggested issue: "'),
                    "i_title",
                    F.lit('" (labels: '),
                    F.array_join(F.slice("i_labels", 1, 4), ", "),
                    F.lit(")."),
                ),
            ),
            F.when(has("i_difficulty"), F.concat(F.lit("Estimated difficulty: "), "i_difficulty", F.lit("."))),
        )
    )
    return rows.select("user", "repo_id", "number", sentences.alias("facts"))


def explanation(facts: Column) -> Column:
    """Facts two to four as one text; the first one when there is no other."""
    more = F.array_join(F.slice(facts, 2, 3), " ")
    return F.when(F.size(facts) > 1, more).otherwise(F.get(facts, F.lit(0)))


def priority_repos(repos: DataFrame, issues: DataFrame, max_repos: int) -> DataFrame:
    """The `max_repos` repositories with issues that most people contribute to, with their `priority` from 1.

    `repos`: repo_id, n_contrib, ... The limit is the feature: answers are paid for per repository.
    """
    with_issues = repos.join(issues.select("repo_id").distinct(), "repo_id", "left_semi")
    best = with_issues.orderBy(F.col("n_contrib").desc(), "repo_id").limit(max_repos)
    # at most max_repos rows are numbered
    w = Window.orderBy(F.col("n_contrib").desc(), "repo_id")
    return best.withColumn("priority", F.row_number().over(w))


def newest_batches(issues: DataFrame, per_repo: int = 5, per_call: int = 5) -> DataFrame:
    """(repo_id, batch, position, ...): the newest issues of a repository in numbered batches."""
    w = Window.partitionBy("repo_id").orderBy(F.col("created").desc(), F.col("number").desc())
    newest = issues.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_repo)
    return (
        newest.withColumn("batch", F.floor((F.col("_r") - 1) / per_call))
        .withColumn("position", (F.col("_r") - 1) % per_call + 1)
        .drop("_r")
    )
