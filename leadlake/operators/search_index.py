"""Keyword postings: a (token, key) table that answers token queries by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import tokens
from leadlake.operators.ranking import top_per_key

#: Tokens whose rows and queries are compared by sets of them instead of one by one.
SHARED = 10


def build_postings(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per distinct token of a row's text columns.

    The tokens of a row are made distinct inside the row; no shuffle.
    """
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return df.select(F.explode(tokens.tokens(text)).alias("token"), F.col(key))


def write_postings(postings: DataFrame, path: str, partitions: int) -> None:
    """Store postings sorted by token, so that a lookup reads few row groups.

    Range partitioning on (token, key) splits a token that is everywhere over
    several files.
    """
    key = postings.columns[1]
    postings.repartitionByRange(partitions, "token", key).sortWithinPartitions("token").write.mode(
        "overwrite"
    ).parquet(path)


def _terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, wanted): the distinct tokens of every query and their number."""
    found = queries.select("query_id", tokens.tokens(F.col("query")).alias("__tokens"))
    return found.select(
        "query_id", F.explode("__tokens").alias("token"), F.size("__tokens").alias("wanted")
    )


def match_all(postings: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key) where the row has every token of the query.

    Rows are found by the rarest token of a query only; its other tokens are
    then looked up by (token, row). Common words never meet all their rows.
    """
    terms = _terms(queries)
    postings = postings.join(terms.select("token").distinct(), "token", "left_semi")
    sizes = postings.groupBy("token").agg(F.count(F.lit(1)).alias("__rows"))
    sized = terms.join(sizes, "token", "left").fillna(0, subset=["__rows"])
    rarest = sized.groupBy("query_id", "wanted").agg(
        F.min(F.struct("__rows", "token"))["token"].alias("token")
    )
    candidates = postings.join(rarest, "token").withColumnRenamed("token", "__rarest")
    others = candidates.join(terms.drop("wanted"), "query_id").filter(F.col("token") != F.col("__rarest"))
    confirmed = others.join(postings, ["token", key], "left_semi")
    complete = confirmed.groupBy("query_id", key, "wanted").agg(F.count(F.lit(1)).alias("__hits"))
    complete = complete.filter(F.col("__hits") == F.col("wanted") - 1)
    single = candidates.filter(F.col("wanted") == 1)
    return complete.select("query_id", key).unionByName(single.select("query_id", key))


def match_any(postings: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, hits) where the row has at least one token of the query.

    Every such pair is a result row, so a token that is everywhere pairs all its
    rows with all its queries: for few queries, or through ``best_any``.
    """
    matched = postings.join(_terms(queries), "token")
    return matched.groupBy("query_id", key).agg(F.count(F.lit(1)).alias("hits"))


def best_any(postings: DataFrame, queries: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of each query with the most of its tokens, then by key.

    Queries with the same tokens among the postings are answered once. The ``SHARED`` tokens
    that would pair the most rows with queries are not joined: rows that have only such tokens
    of a query are ranked once per set of them, by the first ``n`` keys of each set that
    rows have. Rows with any other token of a query are counted whole.
    """
    asked = _terms(queries).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("__asked"))
    held = postings.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token", key).agg(F.count(F.lit(1)).alias("__held"))
    sizes = held.groupBy("token").agg(F.count(F.lit(1)).alias("__rows"))
    known = asked.join(sizes, "token")
    weight = F.struct("token", "__asked", "__rows")
    signed = known.groupBy("query_id").agg(F.sort_array(F.collect_list(weight)).alias("__tokens"))
    sets = signed.select("__tokens").distinct()
    terms = sets.select("__tokens", F.explode("__tokens").alias("t")).select("__tokens", "t.*")
    costly = terms.groupBy("token").agg((F.count(F.lit(1)) * F.max("__rows")).alias("__pairs"))
    shared = costly.orderBy(F.desc("__pairs"), "token").limit(SHARED).select("token", F.lit(1).alias("__shared"))
    token_asked = F.when(F.col("__shared") == 1, F.struct("token", "__asked"))
    commons = terms.join(shared, "token", "left").groupBy("__tokens").agg(F.sort_array(F.collect_list(token_asked)).alias("__common"))
    classes = held.join(shared.select("token"), "token", "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token", "__held"))).alias("__class"))
    kinds = classes.select("__class").distinct().withColumn("h", F.explode("__class")).select("__class", "h.*")
    wanted = commons.select("__common").distinct().withColumn("a", F.explode("__common")).select("__common", "a.*")
    scored = wanted.join(kinds, "token").groupBy("__common", "__class").agg(F.sum(F.col("__asked") * F.col("__held")).alias("__score"))
    # Only tokens that are shared: the first keys of each class stand for it.
    leaders = top_per_key(classes, ["__class"], [F.asc(key)], n)
    plain = top_per_key(scored.join(leaders, "__class"), ["__common"], [F.desc("__score"), F.asc(key)], n)
    plain = commons.join(plain, "__common").select("__tokens", key, F.col("__score").alias("hits"))
    # Any other token: all rows that have one, with what they have of the shared ones.
    others = terms.join(shared.select("token"), "token", "left_anti").select("__tokens", "token", "__asked")
    joined = held.join(others, "token")
    counted = joined.groupBy("__tokens", key).agg(F.sum(F.col("__asked") * F.col("__held")).alias("__own"))
    counted = counted.join(commons, "__tokens").withColumn("__id", F.struct(F.col(key)))
    filed = classes.select(F.struct(F.col(key)).alias("__id"), "__class")
    counted = counted.join(filed, "__id", "left").join(scored, ["__common", "__class"], "left")
    whole = counted.select("__tokens", key, (F.col("__own") + F.coalesce("__score", F.lit(0))).alias("hits"))
    best = plain.unionByName(whole).groupBy("__tokens", key).agg(F.max("hits").alias("hits"))
    best = top_per_key(best, ["__tokens"], [F.desc("hits"), F.asc(key)], n)
    return signed.select(F.struct("query_id").alias("__query"), "__tokens").join(best, "__tokens").select("__query.query_id", key, "hits")
