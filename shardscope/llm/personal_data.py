"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss; DataFrame operations only.

One scan of the texts takes all base matches (e-mail, IP address, card, phone) and all loose ones (forms that look like an identifier of a kind but
fail its base pattern), each with the words around it. Offsets are running sums over the pieces between the matches.

Seeds are the base matches. A lexical pattern is a pair of words around a match (the two before, or the one before and the one after),
by kind. Patterns and instances form a graph that Spark scores in rounds: a pattern by the confidence of its distinct instances, an instance by
the noisy-or of its patterns; seeds stay certain. Loose matches of no base span whose score passes the limit in the last round are added. A pattern counts
from ``SUPPORT`` distinct trusted instances on; what it matches beside them lowers it. So words that stand before anything find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardscope.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive forms of the plain ones: what follows a greedy part never gives anything back to it. A match starts at the
#: start of its run of characters or where the last one ended, which is where the plain pattern finds it too.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[\p{L}\p{N}-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\p{L}\p{N}-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++[.,:][0-9]++[.,:][0-9]++[.,:][0-9]++",
    "card": r"[0-9]++(?:[\x20./-][0-9]++)*+",
    "phone": r"(?:\G|(?<![0-9]))[(]?[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = {"card": (12, 19), "phone": (9, 15)}
#: Characters of a text that may hold a match of the kind at all.
NEEDS = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9][.,:][0-9]", "card": r"[0-9]{2}|[0-9][\x20./-][0-9]", "phone": r"[0-9]"}
ROUNDS, SUPPORT, LIMIT = 3, 3, 0.8
BEFORE, AFTER = 80, 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check: from the right, every second digit counts double, less 9 from 10 on."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    n = F.length(_digits(hit))
    part = F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    card = n.between(*DIGITS["card"]) & luhn(F.when(n.between(*DIGITS["card"]), _digits(hit)))
    return F.when(kind == "email", True).when(kind == "ip", part).when(kind == "card", card).otherwise(n.between(*DIGITS["phone"]))


def _looks(kind: Column, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return F.when(kind.isin("email", "ip"), True).when(kind == "card", n.between(*DIGITS["card"])).otherwise(n.between(*DIGITS["phone"]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and matches (row, kind, base, start, end, hit, before, after) of a table of texts."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def pieces(kind: str, pattern: str, base: bool) -> Column:
        may = F.col("text").rlike(NEEDS[kind]) if kind != "phone" or not base else F.contains(F.col("text"), F.lit("+"))
        gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0)
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.when(may, F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))).alias("z"))

    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("base"), F.array(F.struct(F.lit("").alias("gap"), F.lit("").alias("hit"))).alias("z"))
    parts = [none, *(pieces(k, p, True) for k, p in BASE.items()), *(pieces(k, p, False) for k, p in LOOSE.items())]
    rows = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", F.explode(F.array(*parts)).alias("p")).where(F.size("p.z") > F.when(F.col("p.kind").isNull(), 0).otherwise(1))
    rows = rows.select("row", "doc_id", "p.kind", "p.base", F.posexplode("p.z").alias("i", "z"))
    # a piece is the text between two matches, and the match after it (none after the last)
    rows = written(
        rows.select(
            "row", F.when(F.col("kind").isNull(), F.col("doc_id")).alias("doc_id"), "kind", "base", "i", F.col("z.hit").alias("hit"),
            F.length("z.gap").alias("gap"), F.right("z.gap", F.lit(BEFORE)).alias("before"), F.substring("z.gap", 1, AFTER).alias("after"),
        ),
        "scanned",
    )
    order = Window.partitionBy("row", "kind", "base").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    found = rows.where("kind IS NOT NULL").withColumns(
        {"end": F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(upto), "after": F.lead("after").over(order)}
    )
    found = found.where("hit IS NOT NULL").where(F.when(F.col("base"), _valid(F.col("kind"), F.col("hit"))).otherwise(_looks(F.col("kind"), F.col("hit"))))
    found = found.select("row", "kind", "base", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")
    return rows.where("kind IS NULL").select("row", "doc_id"), written(found, "matches")


def _unseen(found: DataFrame) -> DataFrame:
    """Loose matches that no base span of their text overlaps."""
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    flagged = found.withColumns({"_e": base_end, "_n": next_base})
    free = (F.coalesce("_e", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("_n") >= F.col("end"), F.lit(True))
    return flagged.where(~F.col("base") & free).drop("_e", "_n")


def edges(found: DataFrame) -> DataFrame:
    """Distinct (kind, pattern, value, seed): which instance stands in which lexical pattern."""
    word = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))
    second, first = (F.regexp_extract("before", r"(\S+)\s+(\S+)\s*$", g) for g in (1, 2))
    after = F.regexp_extract("after", r"^\s*(\S+)", 1)
    named = found.withColumns({"w2": word(second), "w1": word(first), "r1": word(after), "value": F.lower(F.regexp_replace("hit", r"[^\p{L}\p{N}@.]", ""))})
    patterns = F.array(
        F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat_ws(" ", "w2", "w1", F.lit("_"))),
        F.when((F.col("w1") != "") & (F.col("r1") != ""), F.concat_ws(" ", "w1", F.lit("_"), "r1")),
    )
    return named.select("kind", "value", F.col("base").alias("seed"), F.explode(patterns).alias("pattern")).where("pattern IS NOT NULL").distinct()


def bootstrap(links: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """kind, value, score of every instance that is no seed. ``links``: kind, pattern, value, seed.

    Every round scores the patterns and then the instances; a hot pattern or instance aggregates before its shuffle.
    """
    trust = links.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    trust = written(trust.withColumn("score", F.col("seed").cast("double")), "trust")
    links = written(links.select("kind", "pattern", "value").distinct(), "graph")
    for _ in range(rounds):
        met = links.join(trust, ["kind", "value"])
        # half of a missing instance keeps patterns of few instances below certainty
        mean = F.sum("score") / (F.count("*") + 0.5)
        patterns = met.groupBy("kind", "pattern").agg(F.sum((F.col("score") >= LIMIT).cast("int")).alias("n"), mean.alias("weight"))
        patterns = patterns.where(F.col("n") >= support)
        scored = links.join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("weight"))))).alias("new"))
        trust = trust.join(scored, ["kind", "value"], "left")
        trust = trust.select("kind", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score"))
        trust = written(trust, "trust")
    return trust.where(~F.col("seed")).select("kind", "value", "score")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all, kind:start:end joined by commas) of every row.

    Null counts as empty; a text without spans has the digest of an empty text and empty spans. Spans of different kinds may overlap, added ones overlap
    no base span. Repeated rows are rows of their own. An empty table gives no rows; other columns are not read.
    """
    rows, found = scan(docs, key, text)
    unseen = written(_unseen(found), "unseen")
    seeds = found.where("base")
    scores = bootstrap(edges(seeds.unionByName(unseen)))
    value = F.lower(F.regexp_replace("hit", r"[^\p{L}\p{N}@.]", ""))
    added = unseen.withColumn("value", value).join(scores.where(F.col("score") >= limit), ["kind", "value"], "left_semi")
    # where two kinds are added at one place, the first listed stays
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    added = added.withColumn("_rank", rank)
    first = F.row_number().over(Window.partitionBy("row", "start").orderBy("_rank", F.col("end").desc()))
    added = added.withColumn("_first", first).where("_first = 1").drop("_first", "_rank", "value")
    span = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    both = seeds.unionByName(added.select(*seeds.columns))
    counts = [F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS]
    lists = [F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("all")]
    summed = both.groupBy("row").agg(*counts, *lists)
    joined = lambda c: F.coalesce(F.concat_ws(",", F.col(f"{c}.span")), F.lit(""))
    return rows.join(summed, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans")
    )


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))
