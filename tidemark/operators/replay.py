"""Point-in-time replay of first contributions to repositories."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.eventlog import KINDS
from tidemark.operators.evaluation import comparable, gain
from tidemark.operators.vectorscore import BLOCK, DIGITS, TILE_CELLS, best_of_rows, blocks_of, in_blocks, moments, standardised, tag_scores
from tidemark.scale import cut

# fixed values: serving ladder candidates; the weight on the model is min(1, items / k)
LADDER_K = (1, 2, 3, 5, 10, 20, 10**9)
LADDER_BETA = (0.0, 0.15, 0.3, 0.6)
LADDER_NOW = (3, 0.15)


def month_bounds(month: str) -> tuple[int, int]:
    """[start, end) of a month YYYY-MM in UTC epoch seconds."""
    year, number = int(month[:4]), int(month[5:7])
    end = (year + number // 12, number % 12 + 1)
    return (
        int(datetime(year, number, 1, tzinfo=UTC).timestamp()),
        int(datetime(*end, 1, tzinfo=UTC).timestamp()),
    )


def cohort(events: DataFrame, catalog: DataFrame, start: int, end: int) -> DataFrame:
    """(user, repo_id, pr_ts): each user's earliest first PR to a catalog repository in [start, end).

    A PR does not count when the user pushed to the repository at or before it. First push and
    first PR of a pair come from one aggregate; no join of the log with itself.
    """
    pairs = events.groupBy("user", "repo_id").agg(
        F.min(F.when(F.col("kind") == "push", F.col("ts"))).alias("push"),
        F.min(F.when(F.col("kind") == "pr", F.col("ts"))).alias("pr"),
    )
    external = F.col("push").isNull() | (F.col("push") > F.col("pr"))
    return (
        pairs.filter(external & (F.col("pr") >= start) & (F.col("pr") < end))
        .join(catalog.select("repo_id").distinct(), "repo_id", "left_semi")
        .groupBy("user")
        .agg(F.min(F.struct("pr", "repo_id")).alias("f"))
        .select("user", F.col("f.repo_id").alias("repo_id"), F.col("f.pr").alias("pr_ts"))
    )


def profiles(events: DataFrame, users: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(user, repo_id, ts, kind): first touches strictly before each user's own `pr_ts`.

    A touch counts when the user pushed to the repository only later. The earliest touch decides:
    if it comes after the first push, so do all others.
    """
    before = events.join(users.select("user", "pr_ts"), "user").filter(F.col("ts") < F.col("pr_ts"))
    wanted = F.col("kind").isin(list(kinds))
    pairs = before.groupBy("user", "repo_id").agg(
        F.min(F.when(F.col("kind") == "push", F.col("ts"))).alias("push"),
        F.min(F.when(wanted, F.struct("ts", "kind"))).alias("f"),
    )
    kept = F.col("push").isNull() | (F.col("push") > F.col("f.ts"))
    return pairs.filter(F.col("f").isNotNull() & kept).select(
        "user", "repo_id", F.col("f.ts").alias("ts"), F.col("f.kind").alias("kind")
    )


def build_queries(
    cohort_rows: DataFrame, profile_rows: DataFrame, item_map: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(queries, profile items).

    queries: user, target, pr_ts, n_history (all repositories), n_profile (catalog only),
    target_in_profile. profile items: user, item, ts. The profile stays in rows because a
    history has no size limit. `item_map`: repo_id, item.
    """
    items = profile_rows.join(item_map, "repo_id", "left").select("user", "item", "ts")
    targets = cohort_rows.join(item_map.withColumnRenamed("item", "target"), "repo_id")
    facts = (
        items.join(targets.select("user", "target"), "user")
        .groupBy("user")
        .agg(
            F.count(F.lit(1)).alias("n_history"),
            F.count("item").alias("n_profile"),
            F.bool_or(F.coalesce(F.col("item") == F.col("target"), F.lit(False))).alias("seen"),
        )
    )
    queries = targets.join(facts, "user", "left").select(
        "user",
        "target",
        "pr_ts",
        F.coalesce("n_history", F.lit(0)).alias("n_history"),
        F.coalesce("n_profile", F.lit(0)).alias("n_profile"),
        F.coalesce("seen", F.lit(False)).alias("target_in_profile"),
    )
    known = items.filter(F.col("item").isNotNull())
    return queries, known.join(targets.select("user"), "user", "left_semi")


def replay_metrics(
    top: DataFrame, queries: DataFrame, facts: DataFrame, k: int = 20, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by..., user, hit, ndcg, near_lang, near_org) of unmasked top lists.

    Near: a miss whose list holds an item in the target's language (if it has one) or of its
    owner. `facts`: item, language ('' = none), owner.
    """
    keys = [*by, "user"]
    wanted = queries.select(*keys, "target").join(
        facts.select(
            F.col("item").alias("target"), F.col("language").alias("t_lang"), F.col("owner").alias("t_owner")
        ),
        "target",
        "left",
    )
    listed = top.filter(F.col("rank") <= k).join(facts.select("item", "language", "owner"), "item", "left")
    joined = wanted.join(listed.select(*keys, "item", "rank", "language", "owner"), keys, "left")
    hit_rank = F.min(F.when(F.col("item") == F.col("target"), F.col("rank")))
    lang = F.bool_or((F.col("language") == F.col("t_lang")) & (F.col("t_lang") != ""))
    owner = F.bool_or(F.col("owner") == F.col("t_owner"))
    grouped = joined.groupBy(*keys).agg(
        hit_rank.alias("r"),
        F.coalesce(lang, F.lit(False)).alias("l"),
        F.coalesce(owner, F.lit(False)).alias("o"),
    )
    miss = F.col("r").isNull()
    return grouped.select(
        *keys,
        (~miss).cast("double").alias("hit"),
        F.coalesce(gain(F.col("r")), F.lit(0.0)).alias("ndcg"),
        (miss & F.col("l")).cast("double").alias("near_lang"),
        (miss & F.col("o")).cast("double").alias("near_org"),
    )


def history_bin(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").otherwise("20+")


def ladder_topk(
    queries: DataFrame,
    model: DataFrame,
    text: DataFrame,
    languages: DataFrame,
    catalog: DataFrame,
    dim_model: int,
    dim_text: int,
    ks: Sequence[int] = LADDER_K,
    betas: Sequence[float] = LADDER_BETA,
    top: int = 20,
    block: int = BLOCK,
) -> DataFrame:
    """(user, k, beta, item, score, rank): the best items of every (k, beta) rung.

    Score = w z(model) + (1 - w) z(text) + beta [language match] + tie with w = min(1, n / k). A
    z-score over the catalog is an affine function of the inner product, whose mean and deviation
    follow from the catalog's moments. Users and items meet in blocks (see `blocked_topk`), where two
    matrix products serve all rungs: a rung is a sum of the two and of the matches, formed in the block,
    and only its best items leave it. `score` is without what is the same for all items of a user.

    `queries`: user, n. `model`, `text`: user, vec (missing = zero). `languages`: user, language
    of the profile. `catalog`: item, model_vec, text_vec, language, tie.
    """
    rungs = [(int(k), float(b)) for k in ks for b in betas]

    def with_tie(column: str) -> Column:
        return F.concat(F.transform(column, lambda x: x.cast("double")), F.array("tie"))

    catalog = cut(
        catalog.select(
            "item", F.nullif(F.col("language"), F.lit("")).alias("tag"), with_tie("model_vec").alias("mv"), with_tie("text_vec").alias("tv")
        ),
        "catalog",
    )
    m_stats = moments(catalog.select(F.col("mv").alias("vec")), dim_model + 1)
    t_stats = moments(catalog.select(F.col("tv").alias("vec")), dim_text + 1)

    def padded(df: DataFrame, dim: int) -> DataFrame:
        zero = F.array_repeat(F.lit(0.0), dim)
        full = queries.select("user").join(df.select("user", "vec"), "user", "left")
        vec = F.coalesce(F.transform("vec", lambda x: x.cast("double")), zero)
        return full.select("user", F.concat(vec, F.array(F.lit(1.0))).alias("vec"))

    zm = standardised(padded(model, dim_model), m_stats).select("user", F.col("zvec").alias("zm"))
    zt = standardised(padded(text, dim_text), t_stats).select("user", F.col("zvec").alias("zt"))
    spoken = languages.filter(F.col("language") != "").groupBy("user").agg(F.collect_set("language").alias("tags"))
    asked = queries.select("user", "n").join(zm, "user").join(zt, "user").join(spoken, "user", "left").withColumn("boost", F.lit(1.0))
    asked = cut(asked, "asked")
    n_q, n_i = blocks_of(asked, catalog, block)
    left, right = in_blocks(asked, "user", n_q, "qb", n_i, "ib"), in_blocks(catalog, "item", n_i, "ib", n_q, "qb")

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("item", kind="stable")
        users, items = q["user"].to_numpy(), v["item"].to_numpy()
        found = [pd.DataFrame({"user": users[:0], "rung": np.zeros(0, np.int32), "item": items[:0], "score": np.zeros(0)})]
        if not len(q) or not len(v):
            return found[0]
        zm, zt, mv, tv = (np.stack(c.to_numpy()) for c in (q["zm"], q["zt"], v["mv"], v["tv"]))
        matches, tag_of = tag_scores(q, v["tag"].to_numpy())
        n = q["n"].to_numpy(float)
        step = max(1, TILE_CELLS // len(v))
        for a in range(0, len(q), step):
            rows = slice(a, a + step)
            by_model, by_text = zm[rows, :-1] @ mv[:, :-1].T, zt[rows, :-1] @ tv[:, :-1].T
            match = matches[rows][:, tag_of]
            for k in sorted({k for k, _ in rungs}):
                w = np.minimum(1.0, n[rows] / k)[:, None]
                tie = w * zm[rows, -1:] + (1 - w) * zt[rows, -1:] + 1.0
                mixed = w * by_model + (1 - w) * by_text + tie * mv[:, -1]
                for number, (own, beta) in enumerate(rungs):
                    if own != k:
                        continue
                    scores = np.round(mixed + beta * match, DIGITS)
                    row, col = best_of_rows(scores, top)
                    found.append(pd.DataFrame({"user": users[a + row], "rung": np.full(len(row), number, np.int32), "item": items[col], "score": scores[row, col]}))
        return pd.concat(found[1:])

    kinds = (queries.schema["user"].dataType.simpleString(), catalog.schema["item"].dataType.simpleString())
    found = (
        left.groupBy("qb", "ib")
        .cogroup(right.groupBy("qb", "ib"))
        .applyInPandas(score, f"user {kinds[0]}, rung int, item {kinds[1]}, score double")
    )
    names = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(b).alias("beta")) for k, b in rungs])
    w = Window.partitionBy("user", "rung").orderBy(comparable("score", DIGITS).desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("user", names[F.col("rung")].alias("r"), "item", "score", "rank").select("user", "r.k", "r.beta", "item", "score", "rank")


def replay_report(per_user: DataFrame, queries: DataFrame) -> DataFrame:
    """(cohort, model, queries, n, hit, ndcg, near_lang, near_org): all queries, queries whose
    target was new to the user, and bins of prior history.

    `per_user`: cohort, model, user and the replay metrics (already averaged over seeds).
    """
    facts = queries.select("cohort", "user", "n_history", "target_in_profile")
    subsets = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(~F.col("target_in_profile"), "new repo"),
            F.concat(F.lit("history "), history_bin(F.col("n_history"))),
            F.when(
                ~F.col("target_in_profile"),
                F.concat(F.lit("new repo, history "), history_bin(F.col("n_history"))),
            ),
        )
    )
    metrics = ("hit", "ndcg", "near_lang", "near_org")
    return (
        per_user.join(facts, ["cohort", "user"])
        .withColumn("queries", F.explode(subsets))
        .groupBy("cohort", "model", "queries")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    )


def interval_values(per_user: DataFrame, queries: DataFrame, metric: str = "ndcg") -> DataFrame:
    """(cohort, queries, series, user, value) for paired intervals: all queries, and those whose target
    was new to the user. A single model's row per user is its own series."""
    facts = queries.select("cohort", "user", "target_in_profile")
    subsets = F.array_compact(F.array(F.lit("all"), F.when(~F.col("target_in_profile"), "new repo")))
    joined = per_user.join(facts, ["cohort", "user"]).withColumn("queries", F.explode(subsets))
    return joined.select("cohort", "queries", F.col("model").alias("series"), "user", F.col(metric).alias("value"))


def tuned_values(per_user: DataFrame) -> DataFrame:
    """(cohort, series, user, value) on the report cohort: the rung that is best on the tune cohort
    (`tuned`) and the one in service (`serving`); `per_user` as in `choose_rung`."""
    best = choose_rung(per_user).filter("is_best").select("k", "beta")
    report = per_user.filter(F.col("cohort") == "report")
    now = (F.col("k") == LADDER_NOW[0]) & (F.col("beta") == LADDER_NOW[1])
    tuned = report.join(F.broadcast(best), ["k", "beta"]).withColumn("series", F.lit("tuned"))  # one rung
    both = tuned.unionByName(report.filter(now).withColumn("series", F.lit("serving")))
    return both.select("cohort", "series", "user", F.col("ndcg").alias("value"))


def choose_rung(per_user: DataFrame) -> DataFrame:
    """(k, beta, tune_ndcg, report_ndcg): the rung that is best on the tune cohort (ties to the
    smaller k) and the one in service, each with both cohorts' NDCG.

    `per_user`: cohort ('tune' or 'report'), k, beta, user, ndcg.
    """
    table = per_user.groupBy("k", "beta").agg(
        F.avg(F.when(F.col("cohort") == "tune", F.col("ndcg"))).alias("tune_ndcg"),
        F.avg(F.when(F.col("cohort") == "report", F.col("ndcg"))).alias("report_ndcg"),
    )
    order = Window.partitionBy(F.lit(1)).orderBy(comparable("tune_ndcg").desc(), "k", "beta")
    ranked = table.withColumn("place", F.row_number().over(order))
    now = (F.col("k") == LADDER_NOW[0]) & (F.col("beta") == LADDER_NOW[1])
    return (
        ranked.filter((F.col("place") == 1) | now)
        .withColumn("is_best", F.col("place") == 1)
        .drop("place")
    )


def ladder_report(rungs: DataFrame, per_user: DataFrame, model: str) -> DataFrame:
    """(ladder, k, beta, tune_ndcg, report_ndcg): the rung in service, the tuned one and the model alone.

    `rungs`: cohort, k, beta, user, ndcg. `per_user`: cohort, model, user, ndcg. Rungs that are both the best
    and in service give both rows.
    """
    chosen = choose_rung(rungs)
    now = (F.col("k") == LADDER_NOW[0]) & (F.col("beta") == LADDER_NOW[1])
    names = F.explode(F.array_compact(F.array(F.when(now, "serving"), F.when(F.col("is_best"), "tuned"))))
    rows = chosen.select(names.alias("ladder"), "k", "beta", "tune_ndcg", "report_ndcg")
    none = F.lit(None)
    alone = per_user.filter(F.col("model") == model).agg(
        F.avg(F.when(F.col("cohort") == "tune", F.col("ndcg"))).alias("tune_ndcg"),
        F.avg(F.when(F.col("cohort") == "report", F.col("ndcg"))).alias("report_ndcg"),
    )
    return rows.unionByName(
        alone.select(F.lit("model alone").alias("ladder"), none.cast("long").alias("k"), none.cast("double").alias("beta"), "tune_ndcg", "report_ndcg")
    )
