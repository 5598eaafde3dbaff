"""Secrets in texts, with weak candidates reported only where complementary parts occur together.

Fixed rules find strong secrets: assignments of a value to a name such as ``password``, access
identifiers and long hexadecimal runs. The method adds credentials that come in several parts. Its parts
are identifiers (``user = x``, ``client_id: x``), secret-like values (long runs with lower-case letters,
upper-case letters and digits) and endpoints (URLs, hosts with a port). None of them is a secret by
itself. A text is divided into scopes of `SCOPE` code points; an interval join brings together parts with
less than `SCOPE` code points between them. An identifier or an endpoint is reported when linked with a
secret (weak or strong), a weak secret when linked with an identifier or an endpoint.

Everything is DataFrame expressions and joins. Positions are in code points, ends exclusive.

Nulls and empty texts have no spans. Repeated rows give repeated results; rows that share a doc_id but
not the text are told apart by a hash of the text. `redact` carries all other columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.matches import SPAN, counted, merged_spans, no_spans, replaced, spans_of
from tidemark.scale import cut

SCOPE = 200
MARK = "[secret]"

# Fixed patterns of the strong secrets; possessive repetition, so that long runs are not tried again.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex")

# Weak parts, by role.
IDENTIFIER = r"""\b(?i:username|user|login|client_?id|account|access_?key_?id)["']?\x20?[:=]\x20?["']?[A-Za-z0-9._@-]{3,}+"""
VALUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9A-Z+/_-]*+[a-z])(?=[0-9a-z+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"\b[a-z][a-z0-9+]++://[A-Za-z0-9.-]{3,}+(?::[0-9]{2,5})?|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}"
WEAK = (("linked_identifier", IDENTIFIER), ("linked_secret", VALUE), ("linked_endpoint", ENDPOINT))


def strong_spans(text: Column) -> Column:
    """Spans of the fixed rules, by kind; matches that are too short are dropped, not tried again."""
    assign = F.filter(spans_of(text, "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 12)
    access = F.filter(spans_of(text, "access", ACCESS), lambda s: F.length(s["value"]) >= 18)
    return F.concat(assign, access, spans_of(text, "hex", HEX))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, *(k for k, _ in WEAK))])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def linked_spans(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak parts that a complementary part lies near: an interval join within scopes.

    `parts` has the key columns and start, stop, kind. A part is in every scope that it reaches into and
    meets the parts in those and in the two next to them, so the join is an equality on key and scope. Of
    each role only the first start and the last stop in a scope matter to a part elsewhere; within a scope
    all parts are near enough. So a scope is at most three rows, however many parts it holds.
    """
    role = F.when(F.col("kind") == "linked_identifier", "identifier").when(F.col("kind") == "linked_endpoint", "endpoint").otherwise("secret")
    low, high = F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope)
    sided = parts.select(*key, "start", "stop", "kind", role.alias("role"))  # values can be long: they are not repeated for each scope
    left = sided.filter(F.col("kind").startswith("linked_")).withColumn("scope", F.explode(F.sequence(low - 1, high + 1)))
    right = sided.withColumn("scope", F.explode(F.sequence(low, high))).groupBy(*key, "scope", F.col("role").alias("other")).agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    near = (F.col("first") - F.col("stop") < scope) & (F.col("start") - F.col("last") < scope)
    complementary = (F.col("role") == "secret") != (F.col("other") == "secret")
    part = [*key, "start", "stop", "kind"]
    found = left.join(right, [*key, "scope"]).filter(near & complementary).select(*part)
    return parts.join(found, part, "left_semi").dropDuplicates(part).select(*part, "value")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """`columns` and the key (id, th); a null doc_id has a stand-in."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"), *columns)


def _spots(docs: DataFrame, scope: int) -> DataFrame:
    """id, th, doc_id, strong and spans (strong and linked) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weak = F.concat(*[spans_of(text, kind, pattern) for kind, pattern in WEAK])
    spots = cut(_keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), strong_spans(text).alias("strong"), weak.alias("weak")), "secrets")
    parts = (
        spots.filter(F.size("weak") > 0)
        .dropDuplicates(["id", "th"])
        .select("id", "th", F.explode(F.concat("strong", "weak")).alias("s"))
        .select("id", "th", "s.start", "s.stop", "s.kind", "s.value")
    )
    linked = linked_spans(parts, ["id", "th"], scope).groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop", "kind", "value")).cast(SPAN).alias("linked"))
    return spots.join(linked, ["id", "th"], "left").select("id", "th", "doc_id", "strong", F.concat("strong", F.coalesce("linked", no_spans())).alias("spans"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, strong and spans, arrays of (start, stop, kind, value)."""
    return _spots(docs, scope).select("doc_id", "strong", "spans")


def digests(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, the number of each strong kind, base_sha256 of the strong spans, all spans as text."""
    counts = [counted(F.col("strong"), k).alias(f"n_{k}") for k in KINDS]
    return find(docs, scope).select("doc_id", *counts, F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """`docs` with each found span (overlapping ones as one) replaced by `mark`."""
    spots = _spots(docs, scope).filter(F.size("spans") > 0).dropDuplicates(["id", "th"]).select("id", "th", merged_spans(F.col("spans")).alias("gone"))
    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    keyed = _keyed(docs, F.col("text"), F.struct(*rest).alias("row"))
    out = keyed.join(spots, ["id", "th"], "left").select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("gone"), mark)).alias("text"))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
