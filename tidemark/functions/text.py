"""Text cleaning, tokens and matching as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what is removed from free text, in this order, and what a text must hold for it
SCRUB_STEPS = (
    (r"(?s)```.*?```", " ", ("```",)),  # code fence
    (r"!\[[^\]]*\]\([^)]*\)", " ", ("![",)),  # image
    (r"\[([^\]]*)\]\([^)]*\)", "$1", ("](",)),  # link, label stays
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "[email]", ("@",)),
    (r"(?U)https?://\S*|www\.\S+", " ", ("://", "www.")),
    (r"<[^>]+>", " ", ("<",)),  # HTML tag
    (r"(?U)(?<![\w.])@[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})", "@user", ("@",)),
)
# fixed values: label phrases that mark an issue for newcomers
BEGINNER_LABELS = (
    "good first issue",
    "good-first-issue",
    "good first contribution",
    "first-timers-only",
    "first timers only",
    "beginner",
    "beginner friendly",
    "beginner-friendly",
    "help wanted",
    "easy",
    "starter",
)
# fixed value: token alphabet
TOKEN = r"[a-z0-9+#.]+"


def bound(column: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` reads it."""
    return F.get(F.transform(F.array(column), body), F.lit(0))


def collapse(column: Column) -> Column:
    """Whitespace runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def truncate_words(column: Column, n: int) -> Column:
    """Cut at `n` characters, then at the last space, and mark the cut."""
    head = F.regexp_replace(F.substring(column, 1, n), r" [^ ]*$", "")
    return F.when(F.length(column) > n, F.concat(head, F.lit(" ..."))).otherwise(column)


def _step(pattern: str, replacement: str, signs: Sequence[str]) -> Callable[[Column], Column]:
    """The replacement where a text holds a sign: looking for it takes far less time than the expression."""

    def step(text: Column) -> Column:
        held = reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs])
        return F.when(held, F.regexp_replace(text, pattern, replacement)).otherwise(text)

    return step


def scrub_text(column: Column, max_chars: int | None = None) -> Column:
    """Plain text without names, addresses, links, markup or code; null becomes ''."""
    text = F.coalesce(column, F.lit(""))
    for pattern, replacement, signs in SCRUB_STEPS:
        text = bound(text, _step(pattern, replacement, signs))
    text = collapse(text)
    return text if max_chars is None else truncate_words(text, max_chars)


def tokens(column: Column) -> Column:
    """Distinct lower-case words of two or more characters, outer dots removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) > 1))


def normalise(column: Column) -> Column:
    """Lower case, only token characters, single spaces."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^a-z0-9+#.]+", " "))


def beginner_pattern(phrases: Sequence[str] = BEGINNER_LABELS) -> str:
    """One regular expression for all phrases: spaces, hyphens and underscores are the same and a
    phrase must not touch another letter."""
    plain = sorted({re.sub(r"[\s_-]+", " ", p.lower()).strip() for p in phrases})
    words = ["[\\s_-]*".join(re.escape(w) for w in p.split(" ")) for p in plain]
    return f"(?i)(^|[^a-z])({'|'.join(words)})([^a-z]|$)"


def is_beginner_label(column: Column, phrases: Sequence[str] = BEGINNER_LABELS) -> Column:
    return column.rlike(beginner_pattern(phrases))


def lines(*parts: tuple[str, Column]) -> Column:
    """`label: text` lines of the parts that are not empty."""
    return F.concat_ws(
        "\n", *[F.when(F.length(t) > 0, F.concat(F.lit(f"{label}: "), t)) for label, t in parts]
    )
