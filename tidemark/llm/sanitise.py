"""Personal data in texts, and the terms around it that would still reveal it.

Fixed rules find e-mail addresses, network addresses, card and telephone numbers. Each different value is
a protected entity. Removing it is not enough where a term around it points to it: the corpus tells how
strongly. For an entity e and a term t of its context (the words outside entities of the texts that hold e)

    P(e | t) = texts with t and e / (texts with t + DOUBT (1 - P(t | e) (1 - P(e))))
    PMI(e; t) = log2(P(e | t) / P(e)) = IC(e) + log2 P(e | t)

with IC(e) = -log2 P(e), the information that the entity holds. The estimate is smoothed by at most `DOUBT`
texts without e: less of them the more of the entity's texts have the term and the rarer the entity is.
So a word seen once with an entity of many texts says little, and the one name with an address that is
found in a single text says all. A term discloses the entity when what it leaves hidden, -log2 P(e | t), is
at most `HIDDEN` bits. All its occurrences in the texts that hold the entity are added as spans of kind
``term``: ``sanitise`` generalises those that have a wider class (capitalised words, words with digits) and
removes the rest.

Both sides count different texts, so copies of a text neither make its words telling nor hide them. All
counts cover the whole corpus. Everything is DataFrame expressions and joins.

Nulls and empty texts have no spans. Repeated rows give repeated results; rows that share a doc_id but
not the text are told apart by a hash of the text. `sanitise` carries all other columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.matches import SPAN, blanked, counted, merged_spans, no_spans, replaced, spans_of
from tidemark.scale import cut

DOUBT = 2.0  # texts
HIDDEN = 1.0  # bits: P(e | t) of a half and more

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. A match starts at the start of its run of characters or where the match before ended;
# repetition is possessive, so that long runs are passed in one step.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[\p{L}\p{N}]++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second one from the right doubled, ends in 0."""
    from_right = F.split(F.reverse(digits), "")
    weighed = F.transform(from_right, lambda d, k: F.when(k % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules by kind, each in the order of the text."""
    ip = F.filter(spans_of(text, "ip", IP), lambda s: s["value"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    card = F.filter(spans_of(text, "card", CARD), lambda s: (F.length(_digits(s["value"])) <= 19) & _luhn(_digits(s["value"])))
    phone = F.filter(spans_of(text, "phone", PHONE), lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(spans_of(text, "email", EMAIL), ip, card, phone)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by kind as listed, then start, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("place"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"), *columns)


def term_counts(docs: DataFrame) -> DataFrame:
    """t (hash of the lower-case word) and the number of different texts it occurs in, over the whole corpus."""
    # texts compress, hashes of their words do not: copies go before the words are taken
    texts = docs.select(F.xxhash64("text").alias("th"), "text").dropDuplicates(["th"])
    found = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    terms = F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lower(w))))
    return texts.select(F.explode(terms).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("all_texts"))


def disclosing_terms(beside: DataFrame, docs: DataFrame, doubt: float = DOUBT, hidden: float = HIDDEN) -> DataFrame:
    """(e, t) whose term discloses the entity. `beside` has one row for each text th that holds entity e (in
    e_texts different texts) and term t."""
    count = F.count(F.lit(1))
    n = max(docs.agg(F.count_distinct(F.xxhash64("text"))).first()[0], 1)
    pairs = beside.groupBy("e", "t").agg(count.alias("texts"), F.max("e_texts").alias("e_texts"))
    doubtful = doubt * (1 - F.col("texts") / F.col("e_texts") * (1 - F.col("e_texts") / n))
    telling = F.col("texts") / (F.col("all_texts") + doubtful) >= 2.0**-hidden
    return pairs.join(term_counts(docs), "t").filter(telling).select("e", "t")


def _spots(docs: DataFrame, doubt: float, hidden: float) -> DataFrame:
    """id, th, doc_id, base and spans (base and disclosing terms) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    outside = with_base.withColumn("gone", F.when(F.size("base") > 0, merged_spans(F.col("base")))).withColumn("rest", F.when(F.size("base") > 0, blanked(F.col("text"), F.col("gone"))))
    spots = cut(outside.select("id", "th", "doc_id", "base", spans_of(F.col("rest"), "term", TERM).alias("words")), "personal")
    holding = spots.filter(F.size("base") > 0)
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    own = cut(holding.select("th", entities.alias("entities"), "words").dropDuplicates(["th"]), "personal-texts")
    # entities that the same texts hold have the same terms: they count as one
    held = own.select("th", F.explode("entities").alias("one"))
    sets = held.groupBy("one").agg(F.count(F.lit(1)).alias("e_texts"), F.bit_xor("th").alias("x"), F.bit_xor(F.xxhash64("th")).alias("y"))
    held = held.join(sets, "one").select("th", F.xxhash64("e_texts", "x", "y").alias("e"), "e_texts").distinct()
    terms = own.select("th", F.explode(F.array_distinct(F.transform("words", lambda w: F.xxhash64(F.lower(w["value"]))))).alias("t"))
    beside = held.join(terms, "th")
    told = beside.join(disclosing_terms(beside, docs, doubt, hidden), ["e", "t"]).select("th", "t").distinct()
    words = own.select("th", F.explode("words").alias("w")).withColumn("t", F.xxhash64(F.lower("w.value")))
    found = words.join(told, ["th", "t"]).groupBy("th").agg(F.collect_list("w").cast(SPAN).alias("terms"))
    result = ["id", "th", "doc_id", "base"]
    spans = F.concat("base", F.coalesce("terms", no_spans()))
    return holding.join(found, "th", "left").select(*result, spans.alias("spans")).unionByName(spots.filter(F.size("base") == 0).select(*result, F.col("base").alias("spans")))


def find(docs: DataFrame, doubt: float = DOUBT, hidden: float = HIDDEN) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (start, stop, kind, value)."""
    return _spots(docs, doubt, hidden).select("doc_id", "base", "spans")


def digests(docs: DataFrame, doubt: float = DOUBT, hidden: float = HIDDEN) -> DataFrame:
    """Per row: doc_id, the number of each fixed kind, base_sha256 of the fixed spans, all spans as text."""
    return find(docs, doubt, hidden).select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def sanitise(docs: DataFrame, doubt: float = DOUBT, hidden: float = HIDDEN) -> DataFrame:
    """`docs` with entities replaced by their kind and disclosing terms generalised or removed.

    Overlapping spans are replaced as one, by the mark of the first.
    """
    spots = _spots(docs, doubt, hidden).filter(F.size("spans") > 0).dropDuplicates(["id", "th"]).select("id", "th", "spans")
    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    out = _keyed(docs, F.col("text"), F.struct(*rest).alias("row")).join(spots, ["id", "th"], "left")
    runs = merged_spans(F.col("spans"))

    def mark(run: Column) -> Column:
        first = F.element_at(F.filter("spans", lambda s: s["start"] == run["start"]), 1)
        wide = F.when(first["value"].rlike("[0-9]"), "[number]").when(first["value"].rlike(r"^\p{Lu}"), "[name]").otherwise("")
        return F.when(first["kind"] == "term", wide).otherwise(F.concat(F.lit("["), first["kind"], F.lit("]")))

    # each run is replaced by a control character first, which is then filled in by order
    kept = F.split(replaced(F.col("text"), F.col("runs"), "\x00"), "\x00")
    filled = F.array_join(F.flatten(F.transform(kept, lambda part, k: F.array(part, F.coalesce(F.try_element_at(F.col("marks"), k + 1), F.lit(""))))), "")
    clean = F.translate("text", "\x00", " ")  # as long as before
    out = out.withColumn("runs", F.when(F.col("spans").isNotNull(), runs)).withColumn("marks", F.transform("runs", mark)).withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean))
    out = out.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(filled))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
