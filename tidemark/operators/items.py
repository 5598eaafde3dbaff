"""Item text tables built from product records and repository pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse, lines, scrub_text, truncate_words


def _clean_list(column: Column) -> Column:
    cleaned = F.transform(F.coalesce(column, F.array().cast("array<string>")), collapse)
    return F.filter(cleaned, lambda x: F.length(x) > 0)


def product_text(
    title: Column,
    store: Column,
    categories: Column,
    features: Column,
    description: Column,
    max_features: int = 3,
    max_description: int = 300,
) -> Column:
    """Title, brand, category path, leading features and a cut description of one product."""
    empty = F.lit("")
    told = F.array_join(F.coalesce(description, F.array().cast("array<string>")), " ")
    return lines(
        ("Title", collapse(F.coalesce(title, empty))),
        ("Brand", collapse(F.coalesce(store, empty))),
        ("Category", F.array_join(_clean_list(categories), " > ")),
        ("Features", F.array_join(F.slice(_clean_list(features), 1, max_features), "; ")),
        ("Description", truncate_words(collapse(told), max_description)),
    )


def product_table(
    records: DataFrame, item_map: DataFrame, max_features: int = 3, max_description: int = 300
) -> DataFrame:
    """(item, raw_id, title, text), one row per mapped item; unknown items get empty text.

    `records`: raw_id, title, store, categories, features, description.
    """
    text = product_text(
        F.col("title"),
        F.col("store"),
        F.col("categories"),
        F.col("features"),
        F.col("description"),
        max_features,
        max_description,
    )
    known = records.select("raw_id", collapse(F.coalesce("title", F.lit(""))).alias("title"), text.alias("text"))
    return item_map.join(known, "raw_id", "left").select(
        "item",
        "raw_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def repo_text(
    name: Column,
    language: Column,
    description: Column,
    readme: Column,
    readme_chars: int = 1500,
    description_chars: int = 300,
) -> Column:
    """Facts of a repository page as one text."""
    head = F.concat(F.lit("Repository: "), short_name(F.coalesce(name, F.lit(""))))
    rest = lines(
        ("Language", F.coalesce(language, F.lit(""))),
        ("Description", scrub_text(description, description_chars)),
        ("README", scrub_text(readme, readme_chars)),
    )
    return F.when(F.length(rest) > 0, F.concat_ws("\n", head, rest)).otherwise(head)


def repo_table(
    item_map: DataFrame, details: DataFrame, readme_chars: int = 1500, description_chars: int = 300
) -> DataFrame:
    """(item, raw_id, title, text) of mapped repositories; `details` may miss some."""
    facts = details.select("raw_id", "language", "description", "readme")
    text = repo_text(
        F.col("name"),
        F.col("language"),
        F.col("description"),
        F.col("readme"),
        readme_chars,
        description_chars,
    )
    return item_map.join(facts, "raw_id", "left").select(
        "item", "raw_id", short_name(F.col("name")).alias("title"), text.alias("text")
    )
