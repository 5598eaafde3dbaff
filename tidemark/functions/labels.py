"""Difficulty, skill and colour rules for issue labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: label parts that tell the difficulty, the hardest match wins
EASY = (
    "good first issue",
    "first-timers-only",
    "first timers only",
    "beginner",
    "easy",
    "starter",
    "difficulty: easy",
    "level: easy",
    "good-first-issue",
    "good first contribution",
)
MEDIUM = ("medium", "intermediate", "difficulty: medium", "level: medium")
HARD = ("hard", "difficulty: hard", "complex", "advanced", "level: hard")
# fixed values: label words and the skill they stand for
SKILL_WORDS = {
    "documentation": "documentation",
    "docs": "documentation",
    "test": "testing",
    "tests": "testing",
    "testing": "testing",
    "ui": "frontend",
    "ux": "frontend",
    "frontend": "frontend",
    "css": "css",
    "backend": "backend",
    "api": "api",
    "ci": "ci",
    "translation": "translation",
    "i18n": "translation",
    "accessibility": "accessibility",
    "a11y": "accessibility",
    "performance": "performance",
    "security": "security",
    "design": "design",
    "refactor": "refactoring",
    "typescript": "typescript",
    "javascript": "javascript",
    "python": "python",
    "rust": "rust",
    "go": "go",
    "java": "java",
    "docker": "docker",
    "sql": "sql",
}
DIFFICULTIES = ("easy", "medium", "hard")


def label_difficulty(labels: Column) -> Column:
    """easy / medium / hard from an array of label names, null when no label tells."""

    def any_of(words: tuple[str, ...]) -> Column:
        def hit(label: Column) -> Column:
            found = F.lit(False)
            for word in words:
                found = found | F.lower(label).contains(word)
            return found

        return F.exists(labels, hit)

    return (
        F.when(any_of(HARD), "hard").when(any_of(MEDIUM), "medium").when(any_of(EASY), "easy")
    )


def label_skills(labels: Column) -> Column:
    """Skills named by label words, in order of first appearance."""
    known = F.create_map(*[F.lit(x) for kv in SKILL_WORDS.items() for x in kv])
    words = F.split(F.regexp_replace(F.lower(F.array_join(labels, " ")), r"[:/\-]", " "), r"\s+")
    skills = F.transform(words, lambda w: F.element_at(known, w))
    return F.array_distinct(F.array_compact(skills))


def label_colors(labels: Column, colors: Column) -> Column:
    """Map of kept labels to '#rrggbb' for labels with a six-digit colour."""
    pairs = F.transform(
        labels, lambda x: F.struct(x.alias("key"), F.lower(F.element_at(colors, x)).alias("value"))
    )
    valid = F.filter(pairs, lambda p: F.coalesce(F.length(p["value"]) == 6, F.lit(False)))
    distinct = F.array_distinct(valid)
    return F.map_from_entries(
        F.transform(distinct, lambda p: F.struct(p["key"], F.concat(F.lit("#"), p["value"])))
    )


def target_difficulty(hours: Column) -> Column:
    """Difficulty a contributor with `hours` per week should aim at."""
    return F.when(hours <= 3, "easy").when(hours <= 8, "medium").otherwise("hard")


def difficulty_match(issue: Column, target: Column) -> Column:
    """1 for the target level, less for easier, much less for harder, 0.5 when unknown."""
    scale = F.array(*[F.lit(d) for d in DIFFICULTIES])
    level, goal = F.array_position(scale, issue), F.array_position(scale, target)
    gap = F.abs(level - goal).cast("double")
    known = F.coalesce(issue.isin(*DIFFICULTIES), F.lit(False))
    return (
        F.when(~known, 0.5).when(level < goal, 1.0 - 0.25 * gap).otherwise(1.0 - 0.6 * gap)
    )


def age_days(ts: Column, now: Column) -> Column:
    """Days between two epoch-second columns, never negative; 365 when the date is missing."""
    days = F.greatest(F.lit(0.0), (now - ts) / 86_400.0)  # greatest skips nulls, hence the test
    return F.when(ts.isNull(), 365.0).otherwise(days)
