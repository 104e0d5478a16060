"""The best passages of each claim by shared terms (S1, S5, T4), exactly, without meeting a claim's frequent terms.

A claim's terms are walked from the rarest one on. The passages that the first few terms find give a floor: the k-th best of them is
no better than the k-th best of all. The terms behind the place from which on all together cannot reach the floor are never
joined with their postings: a passage that has none of the terms before it is out. The best of the others are completed by
the remaining terms, by key, which gives a second, higher floor; what may still reach that is completed as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable, unwritten, written
from .postings import sent

#: Postings of a term that one task may hold; a term with more is dealt out over lanes.
LANE = 1 << 18


def exploded(df: DataFrame, key: str) -> DataFrame:
    """key, term, of __t. The outer form: the plain one adds a filter on the array's size, for which texts would be tokenized twice."""
    return df.select(key, F.explode_outer("__t").alias("term"))


def _counted(df: DataFrame, key: str, sets: bool) -> DataFrame:
    """key, term, n."""
    each = exploded(df, key).where("term is not null")
    return each.withColumn("n", F.lit(1).cast("long")) if sets else each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def best_shared(claims: DataFrame, passages: DataFrame, claim: tuple[str, Column], passage: tuple[str, Column], k: int | None, wanted: DataFrame | None = None, sets: bool = False) -> DataFrame:
    """(claim key, passage key, score): the k best passages of each claim (without k, all that share a term) by the share of its
    terms, as often as they stand there, that the passage has (then by passage key), and the wanted pairs of keys that share a
    term. Keys are unique, terms are arrays; sets: of distinct terms. Null and empty arrays share nothing; so does a null term,
    which counts in a claim's number of terms."""
    (ck, ct), (pk, pt) = claim, passage
    reliable(claims.sparkSession)
    claims, passages = claims.select(F.col(ck).alias("__c"), ct.alias("__t")), passages.select(F.col(pk).alias("__p"), pt.alias("__t"))
    wanted = None if wanted is None else wanted.select(F.col(ck).alias("__c"), F.col(pk).alias("__p"))
    names, ck, pk = {"__c": ck, "__p": pk}, "__c", "__p"
    total = claims.select(ck, F.size("__t").alias("total"))
    asked = sent(_counted(claims, ck, sets).withColumnRenamed("n", "qn"))
    used = sent(asked.select("term").distinct())
    words = exploded(passages, pk).join(used, "term", "left_semi")
    postings = written(words.withColumn("n", F.lit(1).cast("long")) if sets else words.groupBy(pk, "term").agg(F.count(F.lit(1)).alias("n")), "postings")
    lanes = sent(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("lanes", F.ceil(F.col("df") / LANE).cast("int")))
    walk = Window.partitionBy(ck).orderBy("df", "term")
    # walked: postings of rarer terms; left: the most that this term and all more frequent ones can add
    plan = asked.join(lanes, "term").select(
        ck, "term", "qn", "lanes", (F.sum("df").over(walk) - F.col("df")).alias("walked"),
        F.sum("qn").over(walk.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
    )
    plan = sent(plan)
    dealt = postings.join(lanes.where("lanes > 1").select("term", "lanes"), "term", "left").select(pk, "term", "n", F.coalesce(F.pmod(F.xxhash64(pk), "lanes"), F.lit(0)).cast("int").alias("lane"))

    def met(terms: DataFrame) -> DataFrame:
        turns = terms.select(ck, "term", "qn", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
        return dealt.join(turns, ["term", "lane"]).groupBy(ck, pk).agg(F.sum(F.least("qn", "n")).alias("hit"))

    def completed(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        # few pairs travel to the postings, which are shuffled only for many
        each = sent(pairs.join(terms, ck).select(ck, pk, "term", "qn"))
        more = postings.join(each, [pk, "term"]).select(ck, pk, F.least("qn", "n").alias("hit"))
        return pairs.select(ck, pk, "hit").unionByName(more).groupBy(ck, pk).agg(F.sum("hit").alias("hit"))

    def first(pairs: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(ck).orderBy(F.desc("hit"), pk))
        return pairs.withColumn("__n", rank).where(F.col("__n") <= k).drop("__n")

    if k is None:
        best = met(plan)
    else:
        early = F.col("walked") < 4 * k
        found = completed(sent(first(met(plan.where(early)))), plan.where(~early))
        floor = found.groupBy(ck).agg(F.when(F.count(F.lit(1)) >= k, F.min("hit")).otherwise(1).alias("floor"))
        # written before it meets the postings, so that it travels to them
        bound = sent(plan.join(floor, ck))
        partial = written(met(bound.where("left >= floor")), "partial")
        behind = sent(bound.where("left < floor"))
        # the best of these partial sums, completed, are a higher floor, and what reaches it is little more than the best
        full = completed(sent(first(partial)), behind)
        least = full.groupBy(ck).agg(F.when(F.count(F.lit(1)) >= k, F.min("hit")).otherwise(1).alias("least"))
        rest = sent(behind.groupBy(ck).agg(F.max("left").alias("rest")).join(least, ck, "right"))
        near = sent(partial.join(rest, ck).where("hit + coalesce(rest, 0) >= least").select(ck, pk, "hit"))
        unwritten(partial)
        best = first(completed(near, behind))
    if wanted is not None:
        asked_for = completed(wanted.select(ck, pk).distinct().withColumn("hit", F.lit(0).cast("long")), plan).where("hit > 0")
        best = best.unionByName(asked_for).groupBy(ck, pk).agg(F.max("hit").alias("hit"))
    return best.join(total, ck).select(ck, pk, F.try_divide(F.col("hit").cast("double"), F.col("total").cast("double")).alias("score")).withColumnsRenamed(names)
