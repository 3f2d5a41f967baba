"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Base patterns find emails, IP addresses, cards and phone numbers with their places (the seeds), and
   what no base pattern covers (the candidates): words with a digit or @, and runs of number words.
2. Each occurrence induces lexical patterns: the word before it, and the word after it, each with a coarse
   class of the value (with @, no digit, up to 5 digits, more), so that a pattern reaches other formats.
3. Patterns and values form a graph, weighted by occurrences. In turn, a pattern is scored by the share of
   its weight that confirmed values of a kind hold, discounted where few distinct ones do, and an
   unconfirmed value by the scores of its patterns. Values above the threshold are confirmed, and count
   for patterns in the next round.
4. Confirmed candidates are spans of the kind that confirmed them, beside the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.components import stored

KINDS = ("email", "ip", "card", "phone")

# The same matches as the plain patterns. A match begins only where the one before ended (\G) or where the
# character before cannot belong to it, and repetition is possessive: no text makes the search quadratic.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A candidate: two or more words of digits, or a word of 5 characters or more with a digit or @.
    "word": r"(?<![^\x20\x09-\x0D])(?:[+(]*+[0-9][0-9()./-]*+(?![^\x20\x09-\x0D,;:!?])(?:\x20[(]?+[0-9][0-9()./-]*+(?![^\x20\x09-\x0D,;:!?]))++|(?=[^\x20\x09-\x0D]{5})(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++)",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Characters kept on either side of a match, for the words next to it.
CONTEXT = 40
ROUNDS = 3
PATTERN_SCORE = 0.7
VALUE_SCORE = 0.6
#: Distinct confirmed values that a pattern needs.
SUPPORT = 4


def _matches(text: Column, kind: str) -> Column:
    """array<struct<gap, hit, left, right>>: matches with the length of text since the match before."""
    pattern = _PATTERNS[kind]
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"), F.right(g, F.lit(CONTEXT)).alias("left")))
    after = F.slice(F.transform(gaps, lambda g: F.left(g, F.lit(CONTEXT))), 2, F.size(gaps))
    rows = F.zip_with(rows, after, lambda r, a: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), r["left"].alias("left"), a.alias("right")))
    found = F.filter(rows, lambda r: r["hit"].isNotNull())
    hint = _HINTS.get(kind)
    possible = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9@]" if kind == "word" else "[0-9]")
    return F.when(possible, found).otherwise(F.array().cast("array<struct<gap: int, hit: string, left: string, right: string>>"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.reverse(_digits(hit))

    def points(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), points)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    n = F.length(_digits(hit))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(hit)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits): (row, doc_id) of every row, and (row, kind, start, end, value, left, right) of all matches.

    kind `word` is for candidates. One pass over the texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _matches(F.col("text"), k).alias("found")) for k in _PATTERNS])
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    kept = F.filter(kinds, lambda k: F.size(k["found"]) > 0)
    table = stored(scanned.select("row", "doc_id", kept.alias("kinds")), "matches")
    each = table.select("row", F.explode("kinds").alias("k")).select("row", "k.kind", F.posexplode("k.found").alias("n", "m"))
    in_order = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.hit")).over(in_order).cast("long")
    placed = each.withColumn("end", end).select("row", "kind", (F.col("end") - F.length("m.hit")).alias("start"), "end", F.col("m.hit").alias("value"), "m.left", "m.right")
    return table.select("row", "doc_id"), placed.filter(_valid(F.col("kind"), F.col("value")))


def _class(value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when(F.contains(value, F.lit("@")), "@").when(n == 0, "0").when(n <= 5, "1").otherwise("6")


def _rejected(kind: Column, value: Column) -> Column:
    """Values of a base pattern that are no valid IP address or phone number. A card that fails only its check digit stays."""
    whole = F.when(kind == "ip", value.rlike(r"^[0-9]+(\.[0-9]+){3}$")).when(kind == "phone", value.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$"))
    return F.coalesce(whole, F.lit(False))


def _word(text: Column, last: bool) -> Column:
    """The word at the end (or begin) of a context, in lower case, without punctuation around it."""
    found = F.regexp_extract(text, r"([^\s]+)\s*$" if last else r"^\s*([^\s]+)", 1)
    return F.lower(F.regexp_replace(found, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))


def _uncovered(hits: DataFrame) -> DataFrame:
    """Candidates that touch no base span of their row, without closing punctuation."""
    words = hits.filter("kind = 'word'").drop("kind")
    # A plus or an area code in brackets belongs to the number that it begins.
    opening = r"^(?:(?!\+[0-9]|\([0-9]++\).*[0-9])[\p{P}\p{S}])+"
    value = F.regexp_replace("value", opening + r"|[\p{P}\p{S}]+$", "")
    lead = F.length("value") - F.length(F.regexp_replace("value", opening, ""))
    words = words.withColumn("start", F.col("start") + lead).withColumn("value", value).withColumn("end", F.col("start") + F.length("value"))
    words = words.filter((F.length("value") >= 5) & (~F.contains(F.col("value"), F.lit(" ")) | F.length(_digits(F.col("value"))).between(6, 19)))
    # Both sides stand in one order per row: a word is covered if a base span that begins before its end
    # reaches over its start.
    base = hits.filter("kind <> 'word'").select("row", F.col("start").alias("at"), F.col("end").alias("reach"), F.lit(0).alias("turn"))
    asked = words.select("*", (F.col("end") - 1).alias("at"), F.lit(None).cast("long").alias("reach"), F.lit(1).alias("turn"))
    line = base.unionByName(asked, allowMissingColumns=True)
    so_far = F.max("reach").over(Window.partitionBy("row").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("covered_to", so_far).filter((F.col("turn") == 1) & (F.coalesce("covered_to", F.lit(-1)) <= F.col("start"))).select("row", "start", "end", "value", "left", "right")


def discovered(hits: DataFrame, rounds: int = ROUNDS, pattern_score: float = PATTERN_SCORE, value_score: float = VALUE_SCORE, support: int = SUPPORT) -> DataFrame:
    """(row, kind, start, end) of candidates that the patterns of confirmed values confirm."""
    candidates = stored(_uncovered(hits), "candidates")
    seeds = hits.filter("kind <> 'word'")
    every = seeds.select("kind", "value", "left", "right").unionByName(candidates.select(F.lit(None).cast("string").alias("kind"), "value", "left", "right"))
    coarse = _class(F.col("value"))
    sides = F.array(F.concat(F.lit("l "), _word(F.col("left"), True), F.lit(" "), coarse), F.concat(F.lit("r "), _word(F.col("right"), False), F.lit(" "), coarse))
    edges = every.withColumn("pattern", F.explode(sides)).filter(~F.col("pattern").rlike("^[lr]  "))
    # One row for each pattern and value, whatever the number of occurrences.
    edges = stored(edges.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("weight"), F.max("kind").alias("seed_kind")), "edges")
    confirmed = stored(edges.filter("seed_kind is not null").select("value", F.col("seed_kind").alias("kind")).distinct().withColumn("score", F.lit(1.0)), "confirmed")
    unknown = edges.filter("seed_kind is null").select("pattern", "value", "weight")
    for _ in range(rounds):
        known = edges.select("pattern", "value", "weight").join(confirmed, "value")
        held = known.groupBy("pattern", "kind").agg(F.sum(F.col("weight") * F.col("score")).alias("held"), F.count(F.lit(1)).alias("values"))
        of_all = edges.groupBy("pattern").agg(F.sum("weight").alias("all"))
        scored = held.filter(F.col("values") >= support).join(of_all, "pattern")
        scored = scored.withColumn("p", F.col("held") / F.col("all") * (1 - 1 / F.col("values"))).filter(F.col("p") >= pattern_score).select("pattern", "kind", "p")
        weights = unknown.groupBy("value").agg(F.sum("weight").alias("all"))
        gained = unknown.join(scored, "pattern").groupBy("value", "kind").agg(F.sum(F.col("weight") * F.col("p")).alias("gain"))
        fresh = gained.join(weights, "value").withColumn("score", F.col("gain") / F.col("all")).filter(F.col("score") >= value_score)
        fresh = fresh.filter(~_rejected(F.col("kind"), F.col("value")))
        best = fresh.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        fresh = stored(best.join(confirmed, "value", "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        confirmed = stored(confirmed.unionByName(fresh), "confirmed")
    return candidates.join(confirmed, "value").select("row", "kind", "start", "end")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts and base_sha256 are of base spans; spans adds the discovered ones. Places are code points, ends
    exclusive. A null or empty text has no spans; repeated rows have a result each; an empty table gives
    no rows. Other columns are not read.
    """
    rows, hits = occurrences(docs, id_col, text_col)
    hits = stored(hits, "hits")
    base = hits.filter("kind <> 'word'").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    both = base.unionByName(discovered(hits, **kw).withColumn("base", F.lit(False)))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = both.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "start", "end", "kind", "base"))).alias("s"),
    )

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = spans.withColumn("base_text", joined(F.filter("s", lambda s: s["base"]))).withColumn("spans", joined(F.col("s")))
    out = rows.join(spans, "row", "left")
    return out.select("doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base_text", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
