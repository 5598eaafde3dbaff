"""Tables of language-model answers: due prompts, parsing, grounding, reranking, judging."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.labels import DIFFICULTIES
from tidemark.functions.prompts import prompt_key
from tidemark.functions.text import bound, normalise
from tidemark.operators.evaluation import comparable, gain, ideal_gain
from tidemark.operators.split import hash_key
from tidemark.operators.training import MAX_ROUNDS, draw, unheld
from tidemark.scale import cut, portions, unbounded

PORTION = 200_000  # rankings that a task takes apart

# fixed values: general words a claim is checked for, besides the catalog's own
CLAIM_WORDS = (
    "python",
    "javascript",
    "typescript",
    "rust",
    "go",
    "java",
    "c++",
    "c#",
    "ruby",
    "php",
    "swift",
    "kotlin",
    "dart",
    "shell",
    "html",
    "css",
    "sql",
    "documentation",
    "testing",
    "docker",
    "kubernetes",
    "react",
    "pytorch",
    "machine learning",
    "translation",
)


def due_prompts(
    prompts: DataFrame, cache: DataFrame, backend: str, model: str, options: str
) -> tuple[DataFrame, DataFrame]:
    """(prompts without an answer yet, answers found). `prompts`: prompt and any id columns.
    `cache`: key, response."""
    keyed = prompts.withColumn("key", prompt_key(backend, model, options, F.col("prompt")))
    known = cache.select("key", "response")
    return (
        keyed.join(known, "key", "left_anti").dropDuplicates(["key"]),
        keyed.join(known.dropDuplicates(["key"]), "key"),
    )


def parse_object(text: Column) -> Column:
    """First '{' to last '}' as a JSON object (variant), null when there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.when(F.length(found) > 0, found))


def _text(column: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(column, path, "string"), F.lit("")))


def _texts(column: Column, path: str, n: int) -> Column:
    values = F.try_variant_get(column, path, "array<string>")
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.trim(t))
    return F.slice(cleaned, 1, n)


def repo_features(responses: DataFrame) -> DataFrame:
    """(repo_id, summary, skills, domain, parsed); at most six skills."""
    rows = responses.withColumn("v", parse_object(F.col("response")))
    v = F.col("v")
    return rows.select(
        "repo_id",
        _text(v, "$.summary").alias("summary"),
        _texts(v, "$.skills", 6).alias("skills"),
        _text(v, "$.domain").alias("domain"),
        (F.coalesce(F.to_json(v), F.lit("{}")) != "{}").alias("parsed"),  # an empty object says nothing
    )


def issue_features(responses: DataFrame, batches: DataFrame) -> DataFrame:
    """(issue_row, difficulty, skills, evidence) for every issue that was asked about.

    `responses`: batch, response. `batches`: batch, position (from 1), issue_row. Answers are
    matched by the id they state; the last one with an id counts.
    """
    parsed = responses.select("batch", parse_object(F.col("response")).alias("v"))
    entries = parsed.select(
        "batch", F.posexplode(F.try_variant_get("v", "$.issues", "array<variant>")).alias("at", "e")
    )
    e = F.col("e")
    level = F.lower(_text(e, "$.difficulty"))
    typed = entries.select(
        "batch",
        "at",
        F.try_variant_get(e, "$.id", "int").alias("position"),
        F.when(level.isin(*DIFFICULTIES), level).alias("difficulty"),
        _texts(e, "$.skills", 4).alias("skills"),
        _text(e, "$.evidence").alias("evidence"),
    )
    last = (
        typed.groupBy("batch", "position")
        .agg(F.max(F.struct("at", "difficulty", "skills", "evidence")).alias("x"))
        .filter(F.col("position").isNotNull())
    )
    asked = batches.join(responses.select("batch"), "batch", "left_semi")
    return asked.join(last, ["batch", "position"], "left").select(
        "issue_row",
        F.col("x.difficulty").alias("difficulty"),
        F.coalesce("x.skills", F.array().cast("array<string>")).alias("skills"),
        F.coalesce("x.evidence", F.lit("")).alias("evidence"),
    )


def skill_grounded(skill: Column, source: Column) -> Column:
    """The normalised skill occurs in the normalised source."""
    return _occurs(skill, normalise(source))


def _occurs(skill: Column, base: Column) -> Column:
    s = normalise(skill)
    return (F.length(s) > 0) & F.contains(base, s)


def evidence_grounded(evidence: Column, source: Column) -> Column:
    """At least half of the four-word windows of the evidence occur in the source; shorter
    evidence must occur as a whole."""

    def check(both: Column) -> Column:
        text, base, words = both["text"], both["base"], both["words"]
        n = F.size(words)
        starts = F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1)))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(4)), " "))
        share = F.size(F.filter(windows, lambda w: F.contains(base, w))) / F.size(starts)
        return F.when(F.length(text) == 0, False).when(n < 4, F.contains(base, text)).otherwise(share >= 0.5)

    # both texts are normalised once, not once for every window
    text = normalise(evidence)
    return bound(F.struct(text.alias("text"), F.split(text, " ").alias("words"), normalise(source).alias("base")), check)


def grounding_report(repos: DataFrame, issues: DataFrame) -> DataFrame:
    """(kind, metric, value): parse rate, grounded shares and difficulty shares.

    `repos`: parsed, skills, source. `issues`: difficulty, skills, evidence, source. Either may have
    `language`: a skill is also grounded by the language's name, evidence never is.
    """

    def skill_counts(df: DataFrame) -> Column:
        language = [F.coalesce("language", F.lit(""))] if "language" in df.columns else []
        known = F.concat_ws(" ", "source", *language)
        # the source is normalised once, not once for every skill
        return bound(normalise(known), lambda base: F.size(F.filter("skills", lambda s: _occurs(s, base))))

    r = repos.select("parsed", F.size("skills").alias("n"), skill_counts(repos).alias("hits"))
    r = r.agg(
        F.count(F.lit(1)).cast("double").alias("outputs"),
        F.avg(F.col("parsed").cast("int")).alias("parse_rate"),
        (F.sum("hits") / F.sum("n")).alias("skills_in_source"),
    )
    i = issues.select(
        "difficulty",
        F.size("skills").alias("n"),
        skill_counts(issues).alias("hits"),
        evidence_grounded(F.col("evidence"), F.col("source")).alias("copied"),
    )
    rated = F.count("difficulty")
    i = i.agg(
        F.count(F.lit(1)).cast("double").alias("outputs"),
        F.avg(F.col("difficulty").isNotNull().cast("int")).alias("difficulty_valid"),
        (F.sum("hits") / F.sum("n")).alias("skills_in_source"),
        F.avg(F.col("copied").cast("int")).alias("evidence_copied"),
        *[
            F.try_divide(F.count_if(F.col("difficulty") == d), rated).alias(f"difficulty_{d}")
            for d in DIFFICULTIES
        ],
    )

    def long(df: DataFrame, kind: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns])
        return df.select(F.lit(kind).alias("kind"), F.explode(cells).alias("c")).select("kind", "c.*")

    out = long(r, "repo").unionByName(long(i, "issue"))
    absent = F.col("metric").startswith("difficulty_") & (F.coalesce("value", F.lit(0.0)) == 0)
    return out.filter(~absent | (F.col("metric") == "difficulty_valid"))


def parse_ranking(text: Column, n: Column) -> tuple[Column, Column]:
    """(0-based order, number of missing): bracketed numbers in range, each once, then the missing
    positions in shown order."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)),
        lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) - 1,
    )
    valid = F.array_distinct(F.filter(found, lambda k: (k >= 0) & (k < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    missing = F.array_except(every, valid)
    return F.concat(valid, missing), F.size(missing)


def borda(rankings: DataFrame) -> DataFrame:
    """(list, candidate, points, place): sum of n - position over the rankings of a list, ties by
    the first ranking. `rankings`: list, ranking (number from 0), order (array of candidates).

    An order becomes a row per candidate inside the task that holds its list, so tasks are kept to about
    `PORTION` orders however many there are. Writes the rankings once, to count them.
    """
    rankings = portions(cut(rankings.select("list", "ranking", "order"), "rankings"), PORTION, "list")
    rows = rankings.select(
        "list", "ranking", F.size("order").alias("n"), F.posexplode("order").alias("pos", "candidate")
    )
    points = rows.groupBy("list", "candidate").agg(
        F.sum(F.col("n") - F.col("pos")).alias("points"),
        F.min(F.when(F.col("ranking") == 0, F.col("pos"))).alias("first"),
    )
    w = Window.partitionBy("list").orderBy(F.col("points").desc(), "first", "candidate")
    return points.withColumn("place", F.row_number().over(w)).drop("first")


def scaled_scores(scores: DataFrame, by: Sequence[str] = ("list",)) -> DataFrame:
    """Add `scaled`: score between 0 and 1 inside each list, 0 when all are equal."""
    edges = scores.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, 0.0).otherwise(F.try_divide(F.col("score") - F.col("_lo"), span))
    return scores.join(edges, list(by)).withColumn("scaled", scaled).drop("_lo", "_hi")


def random_candidate_sets(
    targets: DataFrame, held: DataFrame, index: DataFrame, n_items: int, n: int = 20, seed: int = 0
) -> DataFrame:
    """(user, item, is_target): one target per user and n - 1 distinct items the user does not hold.

    `held`: user, item pairs that may not be drawn (history and targets). `index`: item, rank in
    [0, n_items). Users that hold all but fewer than n - 1 items get what is left.
    """
    w = Window.partitionBy("user").orderBy(hash_key(seed, "user", "item"), "item")
    chosen = targets.select("user", "item").withColumn("_r", F.row_number().over(w))
    chosen = cut(chosen.filter(F.col("_r") == 1).drop("_r"), "chosen")
    # the draws of each user are rows that no file size tells of: neither side of these joins is broadcast
    held, index = unbounded(held.select("user", "item").distinct()), unbounded(index.select("item", "rank"))
    sizes = held.groupBy("user").agg(F.count(F.lit(1)).alias("_h"))
    room = F.least(F.lit(n - 1), F.lit(n_items) - F.coalesce("_h", F.lit(0)))
    users = cut(chosen.select("user").join(unbounded(sizes), "user", "left").select("user", room.alias("need")), "room")
    open_users, found = users, None
    batch = 2 * n
    for r in range(MAX_ROUNDS):
        numbers = F.sequence(F.lit(r * batch), F.lit((r + 1) * batch - 1))
        drawn = open_users.select("user", "need", F.explode(numbers).alias("draw"))
        drawn = (
            drawn.withColumn("rank", draw(seed, n_items, "user", "draw"))
            .join(index, "rank")
            .select("user", "need", "item", "draw")
            .join(held, ["user", "item"], "left_anti")
        )
        merged = drawn if found is None else found.unionByName(drawn)
        first = merged.groupBy("user", "item").agg(F.min("draw").alias("draw"), F.max("need").alias("need"))
        w = Window.partitionBy("user").orderBy("draw")
        kept = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("need"))
        found = cut(kept.select("user", "need", "item", "draw"), "drawn")
        full = found.groupBy("user", "need").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("need"))
        open_users = cut(users.filter(F.col("need") > 0).join(unbounded(full), "user", "left_anti"), "open")
        if open_users.isEmpty():
            break
    else:
        # these users hold nearly everything: take what they do not hold, in an order by hash
        rest = unheld(open_users, held, index).select("user", "item").join(found.select("user", "item"), ["user", "item"], "left_anti")
        have = found.groupBy("user").agg(F.count(F.lit(1)).alias("have"))
        w = Window.partitionBy("user").orderBy(hash_key(seed, "user", "item"), "item")
        short = open_users.join(have, "user", "left").select("user", "need", (F.col("need") - F.coalesce("have", F.lit(0))).alias("short"))
        more = rest.withColumn("_r", F.row_number().over(w)).join(short, "user").filter(F.col("_r") <= F.col("short"))
        found = found.select("user", "item").unionByName(more.select("user", "item"))
    rest = found.select("user", "item", F.lit(False).alias("is_target"))
    return chosen.withColumn("is_target", F.lit(True)).unionByName(rest)


def candidate_orders(sets: DataFrame, scores: DataFrame, pop: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(set, variant, user, rank, is_target): the candidate sets in the orders to be compared.

    `sets`: set, user, item, is_target. `scores`: user, item, score of the model for these pairs (a missing one is
    0). `pop`: item, pop. `answers`: set, user, ranking (from 0), text: what a language model answered about the
    candidates, shown in the order of their ids; several answers about a set count by Borda's rule. A variant
    is named after its set: _model_order, _popularity_order, _text.
    """
    keys = ["set", "user"]
    known = sets.join(unbounded(scores.select("user", "item", "score")), ["user", "item"], "left").join(unbounded(pop.select("item", "pop")), "item", "left")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("item")) - 1  # a set is a short list
    known = cut(known.withColumn("candidate", number), "candidates")

    def ordered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.select("set", F.concat("set", F.lit("_" + name)).alias("variant"), "user", F.row_number().over(w).alias("rank"), "is_target")

    out = ordered(known, "model_order", comparable(F.coalesce("score", F.lit(0.0))).desc(), F.col("item"))
    out = out.unionByName(ordered(known, "popularity_order", F.coalesce("pop", F.lit(0)).desc(), F.col("item")))
    if answers is None:
        return out
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    order = parse_ranking(F.col("text"), F.col("n"))[0]
    rankings = answers.join(unbounded(sizes), keys).select(F.struct(*keys).alias("list"), "ranking", order.alias("order"))
    places = borda(rankings).select("list.*", "candidate", "place")
    placed = known.join(unbounded(places), [*keys, "candidate"])
    return out.unionByName(
        placed.select("set", F.concat("set", F.lit("_text")).alias("variant"), "user", F.col("place").alias("rank"), "is_target")
    )


def order_metrics(ranked: DataFrame, n_targets: DataFrame, k: int = 10, full: int = 20) -> DataFrame:
    """(variant, user, ndcg_k, recall_k, ndcg_full) of ordered candidate sets.

    `ranked`: variant, user, rank, is_target. `n_targets`: user, n.
    """
    hit = F.col("is_target")
    top = hit & (F.col("rank") <= k)
    g = gain(F.col("rank"))
    sums = ranked.filter(F.col("rank") <= full).groupBy("variant", "user").agg(
        F.coalesce(F.sum(F.when(top, g)), F.lit(0.0)).alias("dcg_k"),
        F.count_if(top).alias("hits_k"),
        F.coalesce(F.sum(F.when(hit, g)), F.lit(0.0)).alias("dcg_full"),
    )
    n = F.col("n")
    return sums.join(unbounded(n_targets.select("user", "n")), "user").select(
        "variant",
        "user",
        (F.col("dcg_k") / ideal_gain(n, k)).alias("ndcg_k"),
        (F.col("hits_k") / n).alias("recall_k"),
        (F.col("dcg_full") / ideal_gain(n, full)).alias("ndcg_full"),
    )


def plain(text: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[-_]", " "), r"(?U)\s+", " "))


def unsupported_claims(text: Column, facts: Column, vocabulary: Sequence[str] = CLAIM_WORDS) -> Column:
    """Sorted checkable terms of `text` that the facts (array) do not contain: vocabulary and
    difficulty words, owner/repository names, quotes, numbers and claims about stars."""
    t, f = plain(text), plain(F.array_join(facts, " "))
    words = sorted({" ".join(re.sub(r"[-_]", " ", w.lower()).split()) for w in vocabulary})
    checks = [
        F.when(t.rlike(rf"(?U)(?<![\w+#])\Q{w}\E(?![\w+#])") & ~F.contains(f, F.lit(w)), w) for w in words
    ]
    checks += [
        F.when(t.rlike(rf"(?U)\b{d}\b") & ~F.contains(f, F.lit(d)), d) for d in DIFFICULTIES
    ]
    starred = t.rlike(r"(?U)\bstarred\b") & ~F.contains(f, F.lit("starred"))
    checks.append(F.when(starred, "starred-claim"))

    def outside(pattern: str, group: int, shape) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.filter(F.transform(found, shape), lambda x: ~F.contains(f, plain(x)))

    same = lambda x: x
    quotes = lambda q: F.regexp_replace(q, r"^[ .,;:!?]+|[ .,;:!?]+$", "")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.array_compact(F.array(*checks)),
                outside(r"(?U)\b[\w.-]+/[\w.-]+\b", 0, same),
                outside(r'"([^"]{6,})"', 1, quotes),
                outside(r"(?U)\b\d+\b", 0, same),
            )
        )
    )


def names_supported(text: Column, facts: Column) -> Column:
    """Every owner/repository name of the text appears in the facts."""
    joined = F.lower(F.array_join(facts, " "))
    names = F.regexp_extract_all(text, F.lit(r"(?U)\b[\w.-]+/[\w.-]+\b"), F.lit(0))
    return F.forall(names, lambda n: F.contains(joined, F.lower(n)))


def judge_ratings(recommendations: DataFrame, responses: DataFrame) -> DataFrame:
    """Recommendations with the judge's score (null = not rated).

    `recommendations`: persona, rank (from 1) and more. `responses`: persona, response with a
    JSON list `ratings` of id and score; the last entry with an id counts.
    """
    entries = responses.select("persona", parse_object(F.col("response")).alias("v")).select(
        "persona", F.posexplode(F.try_variant_get("v", "$.ratings", "array<variant>")).alias("at", "e")
    )
    number = F.try_variant_get("e", "$.id", "string")
    typed = entries.select(
        "persona",
        "at",
        F.when(number.rlike("^[0-9]+$"), number.try_cast("int")).alias("rank"),
        F.try_variant_get("e", "$.score", "int").alias("score"),
    )
    last = (
        typed.filter(F.col("rank").isNotNull())
        .groupBy("persona", "rank")
        .agg(F.max(F.struct("at", "score")).alias("x"))
        .select("persona", "rank", F.col("x.score").alias("judge_score"))
    )
    return recommendations.join(last, ["persona", "rank"], "left")


def judge_summary(rated: DataFrame) -> DataFrame:
    """(scope, n, mean, good, partly, unrated) over all recommendations and per persona.

    The two shares count unrated rows as not good, like a comparison with a missing value.
    """
    score = F.col("judge_score")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    values = [
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        share(score == 2).alias("good"),
        share(score >= 1).alias("partly"),
        F.count_if(score.isNull()).alias("unrated"),
    ]
    scopes = F.array(F.lit("all"), F.col("persona").cast("string"))
    return rated.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(*values)


def blind_sample(rated: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """`n` rows in a seeded random order without the judge's columns."""
    hidden = [c for c in rated.columns if c.startswith("judge_")]
    key = hash_key(seed, "persona", "rank")
    return rated.drop(*hidden).orderBy(key, "persona", "rank").limit(n)
