"""Event-log jobs: who is external, what repositories attract, who touched what first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: raw event types, the kinds they become and the kinds that count as contribution
KIND_OF_TYPE = {
    "WatchEvent": "star",
    "ForkEvent": "fork",
    "PullRequestEvent": "pr",
    "IssuesEvent": "issue",
    "IssueCommentEvent": "comment",
    "PullRequestReviewEvent": "review",
    "PullRequestReviewCommentEvent": "review",
    "PushEvent": "push",
}
PUSH = "PushEvent"
KINDS = ("star", "fork", "pr", "issue", "comment", "review")
CONTRIB_KINDS = ("pr", "issue", "comment", "review")
CONTRIB_TYPES = tuple(t for t, k in KIND_OF_TYPE.items() if k in CONTRIB_KINDS)
BOT_LOGIN = r"(\[bot\]$|bot$|-ci$|^dependabot|^renovate|^github-actions)"


@dataclass(frozen=True)
class Windows:
    """Window borders in epoch seconds; every end is exclusive."""

    train_start: int
    val_start: int
    test_start: int
    test_end: int


def kind_of(column: Column) -> Column:
    pairs = [F.lit(x) for kv in KIND_OF_TYPE.items() for x in kv]
    return F.create_map(*pairs)[column]


def drop_bots_and_owners(raw: DataFrame) -> DataFrame:
    """Rows whose login is neither a bot nor the owner of the repository."""
    login = F.lower("login")
    owner = F.lower(F.split_part("repo_name", F.lit("/"), F.lit(1)))
    return raw.filter(~login.rlike(BOT_LOGIN) & (login != owner))


def external_events(raw: DataFrame, types: Sequence[str] = tuple(KIND_OF_TYPE)) -> DataFrame:
    """Events of actors that never pushed to the repository in the range; pushes removed."""
    kept = drop_bots_and_owners(raw.filter(F.col("type").isin(list(types))))
    maintainers = kept.filter(F.col("type") == PUSH).select("actor_id", "repo_id").distinct()
    return kept.filter(F.col("type") != PUSH).join(
        maintainers, ["actor_id", "repo_id"], "left_anti"
    )


def _latest_name() -> Column:
    return F.max(F.struct("created_us", "repo_name"))


def repo_activity(external: DataFrame, min_actors: int = 20) -> DataFrame:
    """Distinct actors per repository, in all and by type, with the latest name.

    Rows are first folded to one per (repository, actor), which spreads a busy repository over
    many groups and turns every distinct count into a plain sum.
    """

    def did(*types: str) -> Column:
        return F.max(F.col("type").isin(*types).cast("int"))

    per_actor = external.groupBy("repo_id", "actor_id").agg(
        _latest_name().alias("name"),
        did("WatchEvent").alias("n_star"),
        did("ForkEvent").alias("n_fork"),
        did("PullRequestEvent").alias("n_pr"),
        did("IssuesEvent").alias("n_issue"),
        did(*CONTRIB_TYPES).alias("n_contrib"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_star", "n_fork", "n_pr", "n_issue", "n_contrib")]
    return (
        per_actor.groupBy("repo_id")
        .agg(F.max("name").alias("name"), *sums, F.count(F.lit(1)).alias("n_actors"))
        .filter(F.col("n_actors") >= min_actors)
        .withColumn("repo_name", F.col("name.repo_name"))
        .drop("name")
    )


def co_touch(external: DataFrame, seeds: DataFrame, min_shared: int = 30) -> DataFrame:
    """Repositories outside `seeds` (repo_id) with the actors they share with seed repositories."""
    seeds = seeds.select("repo_id").distinct()
    per_actor = external.groupBy("repo_id", "actor_id").agg(_latest_name().alias("name"))
    seed_actors = per_actor.join(seeds, "repo_id", "left_semi").select("actor_id").distinct()
    return (
        per_actor.join(seeds, "repo_id", "left_anti")
        .join(seed_actors, "actor_id", "left_semi")
        .groupBy("repo_id")
        .agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("n_shared"))
        .filter(F.col("n_shared") >= min_shared)
        .select("repo_id", F.col("name.repo_name").alias("repo_name"), "n_shared")
    )


def day_events(raw: DataFrame, repos: DataFrame) -> DataFrame:
    """Per day, type, actor and repository of the set: first time, count, latest name, kind."""
    day = F.floor(F.col("created_us") / 86_400_000_000).alias("day")
    return (
        drop_bots_and_owners(raw)
        .join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
        .groupBy(day, "type", "actor_id", "repo_id")
        .agg(
            F.min("created_us").alias("first_us"),
            F.count(F.lit(1)).alias("n"),
            _latest_name().alias("name"),
        )
        .select(
            "day",
            kind_of(F.col("type")).alias("kind"),
            "actor_id",
            "repo_id",
            "first_us",
            "n",
            F.col("name.repo_name").alias("repo_name"),
        )
    )


PAYLOAD = """action STRING, number STRING, pull_request STRUCT<number: STRING>,
  issue STRUCT<number: STRING, user: STRUCT<login: STRING>, labels: ARRAY<STRUCT<name: STRING>>>,
  labels ARRAY<STRUCT<name: STRING>>"""


def payload_facts(raw: DataFrame) -> DataFrame:
    """Action, number, issue authorship and label names out of the payload, parsed once."""
    p = F.from_json("payload", PAYLOAD)
    names = F.transform(
        F.coalesce(F.col("p.issue.labels"), F.col("p.labels")), lambda x: F.lower(x["name"])
    )
    return raw.withColumn("p", p).select(
        "type",
        "actor_id",
        "repo_id",
        "created_us",
        F.col("p.action").alias("action"),
        F.coalesce("p.pull_request.number", "p.issue.number", "p.number").alias("number"),
        (F.lower("p.issue.user.login") == F.lower("login")).alias("actor_is_issue_author"),
        F.coalesce(names, F.array().cast("array<string>")).alias("labels"),
    )


def interactions(
    events: DataFrame, repos: DataFrame, windows: Windows, kinds: Sequence[str] = KINDS
) -> DataFrame:
    """(user, item, ts, kind, contrib): first touch per pair.

    A pair's events of a window are dropped when the user pushed to the repository before the end
    of that window. `contrib` says whether the pair also contributed in the window of its first
    touch. All of this depends on one pair only, so it is a single aggregate over (user, item)
    with one set of partial values per window, and no join.
    """
    ends = (windows.val_start, windows.test_start, windows.test_end)
    ts = F.col("ts")
    in_range = events.filter((ts >= windows.train_start) & (ts < windows.test_end))
    in_set = in_range.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    number = F.when(ts < ends[0], 0).when(ts < ends[1], 1).otherwise(2)
    wanted = F.col("kind").isin(list(kinds))
    contributed = F.col("kind").isin(list(CONTRIB_KINDS))
    aggregates = [F.min(F.when(F.col("kind") == "push", ts)).alias("first_push")]
    for w in range(3):
        here = wanted & (F.col("w") == w)
        aggregates += [
            F.min(F.when(here, F.struct("ts", "kind"))).alias(f"first{w}"),
            F.coalesce(F.max(here & contributed), F.lit(False)).alias(f"contrib{w}"),
        ]
    pairs = (
        in_set.withColumn("w", number)
        .groupBy("user", F.col("repo_id").alias("item"))
        .agg(*aggregates)
    )

    def usable(w: int) -> Column:
        external = F.col("first_push").isNull() | (F.col("first_push") >= ends[w])
        return F.when(
            external & F.col(f"first{w}").isNotNull(),
            F.struct(F.col(f"first{w}").alias("f"), F.col(f"contrib{w}").alias("contrib")),
        )

    # windows follow each other in time: the first usable window holds the first touch
    touch = F.coalesce(usable(0), usable(1), usable(2))
    return (
        pairs.select("user", "item", touch.alias("t"))
        .filter(F.col("t").isNotNull())
        .select("user", "item", F.col("t.f.ts").alias("ts"), F.col("t.f.kind").alias("kind"), "t.contrib")
    )


def maintainer_share(events: DataFrame, repos: DataFrame) -> DataFrame:
    """(kind, share): share of a kind's events made by actors that ever pushed to the repository."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    pairs = (
        events.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
        .groupBy("user", "repo_id")
        .agg(F.count_if(F.col("kind") == "push").alias("pushes"), *counts)
    )
    pushed = F.col("pushes") > 0
    sums = [F.sum(k).alias(k) for k in KINDS]
    sums += [F.sum(F.when(pushed, F.col(k)).otherwise(0)).alias(f"m_{k}") for k in KINDS]
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), F.col(f"m_{k}").alias("m"))
            for k in KINDS
        ]
    )
    return (
        pairs.agg(*sums)
        .select(F.explode(rows).alias("r"))
        .select("r.*")
        .filter(F.col("n") > 0)
        .select("kind", (F.col("m") / F.col("n")).alias("share"))
    )


def attribution_check(facts: DataFrame, events: DataFrame, test_end: int) -> DataFrame:
    """Per (type, maintainer): pairs, share of pairs that authored something, events.

    `facts` is `payload_facts` with a `user` column; a maintainer pushed before `test_end`.
    """
    pushes = (
        events.filter((F.col("kind") == "push") & (F.col("ts") < test_end))
        .select("user", "repo_id")
        .distinct()
        .withColumn("maintainer", F.lit(True))
    )
    opened = F.col("action") == "opened"
    authored = F.when(F.col("type") == "PullRequestEvent", opened).otherwise(
        opened & F.col("actor_is_issue_author")
    )
    pairs = (
        facts.groupBy("type", "user", "repo_id")
        .agg(F.bool_or(authored).alias("authored"), F.count(F.lit(1)).alias("n_events"))
        .join(pushes, ["user", "repo_id"], "left")
        .withColumn("maintainer", F.coalesce("maintainer", F.lit(False)))
    )
    return pairs.groupBy("type", "maintainer").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(F.col("authored").cast("int")).alias("share_authored"),
        F.sum("n_events").alias("events"),
    )


def source_stats(split: DataFrame, item_map: DataFrame) -> DataFrame:
    """(metric, value) rows: kinds, contribution share and users per part, groups, cold items.

    `split`: user, item, kind, contrib, part. `item_map`: item, group.
    """

    def named(df: DataFrame, metric: Column, value: Column) -> DataFrame:
        return df.select(metric.alias("metric"), value.cast("double").alias("value"))

    one = F.count(F.lit(1)).alias("n")
    kinds = named(
        split.groupBy("part", "kind").agg(one), F.concat_ws("_", "part", F.lit("kind"), "kind"), F.col("n")
    )
    users = split.groupBy("part", "user").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("contrib").alias("c")
    )
    parts = users.groupBy("part").agg(
        (F.sum("c") / F.sum("rows")).alias("share"), F.count(F.lit(1)).alias("users")
    )
    shares = named(parts, F.concat_ws("_", "part", F.lit("contrib_share")), F.col("share"))
    counts = named(parts, F.concat_ws("_", "part", F.lit("users")), F.col("users"))
    groups = named(
        item_map.groupBy("group").agg(one), F.concat_ws("_", F.lit("items"), "group"), F.col("n")
    )
    train_items = split.filter(F.col("part") == "train").select("item").distinct()
    cold = item_map.select("item").distinct().join(train_items, "item", "left_anti")
    cold_items = named(cold.agg(one), F.lit("cold_items"), F.col("n"))
    cold_pairs = split.filter(F.col("part") == "test").join(cold, "item", "left_semi")
    cold_pairs = named(cold_pairs.agg(one), F.lit("test_pairs_on_cold_items"), F.col("n"))
    out = kinds
    for more in (shares, counts, groups, cold_items, cold_pairs):
        out = out.unionByName(more)
    return out


def contrib_variant(split: DataFrame) -> DataFrame:
    """The same train rows; val and test only where the pair contributed."""
    return split.filter((F.col("part") == "train") | F.col("contrib"))
