"""Global discovery over recorded hits: deduplicate, verify with promotion under a budget, account for it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinloom.functions.digests import git_blob_sha
from pinloom.operators.ranking import globally_ranked
from pinloom.plans.search import search
from pinloom.plans.spec import SearchSpec

IDENTITY = ["slug", "commit_sha", "path", "blob_sha"]


def verified_candidates(hits: DataFrame, blobs: DataFrame, budget: int) -> DataFrame:
    """The verified representative of each content group, within a budget of attempts.

    Hits are grouped by blob after the passes of ``dedup_hits``; a group's members are tried in order until one's bytes have
    the blob's SHA, each try costing one attempt; groups take turns in the order of their first member. Columns: the identity,
    attempts, state (verified, failed, or not_attempted where the budget ended before the group did).
    """
    pins = hits.groupBy("slug", "commit_sha", "path").agg(F.min("blob_sha").alias("blob_sha"))
    members = pins.groupBy("slug", "path").agg(F.min(F.struct(*IDENTITY)).alias("_h")).select("_h.*")
    fetched = blobs.select("slug", "commit_sha", "path", (git_blob_sha(F.encode("content", "UTF-8"))).alias("_sha"))
    tried = members.join(fetched, ["slug", "commit_sha", "path"], "left").withColumn("_ok", F.coalesce(F.col("_sha") == F.col("blob_sha"), F.lit(False)))
    order = F.struct(*IDENTITY)
    firsts = tried.groupBy("blob_sha").agg(F.min(order).alias("first"), F.min(F.when(F.col("_ok"), order)).alias("good"), F.count("*").alias("n"))
    before = tried.join(firsts.select("blob_sha", "good"), "blob_sha").groupBy("blob_sha").agg(F.count_if(F.coalesce(order < F.col("good"), F.lit(False))).alias("_b"))
    groups = firsts.join(before, "blob_sha").withColumn("attempts", F.when(F.col("good").isNotNull(), F.col("_b") + 1).otherwise(F.col("n")))
    placed = globally_ranked(groups, [F.col("first").asc()])
    # every group costs an attempt, so only the first ones can lie within the budget, and their sum is small work
    near = placed.where(F.col("rank") <= budget)
    spent = F.sum("attempts").over(Window.orderBy("rank"))
    inside = near.withColumn("_spent", spent).withColumn("state", F.when(F.col("_spent") > budget, "not_attempted").when(F.col("good").isNotNull(), "verified").otherwise("failed"))
    rest = placed.where(F.col("rank") > budget).withColumn("state", F.lit("not_attempted"))
    out = inside.drop("_spent").unionByName(rest)
    return out.select(F.coalesce("good", "first").alias("_r"), "attempts", "state").select("_r.*", "attempts", "state")


def global_search(hits: DataFrame, blobs: DataFrame, spec: SearchSpec, budget: int) -> DataFrame:
    """The matches of a query in verified candidates; must_nots drop lines too, as the index saw only parts of a file."""
    good = verified_candidates(hits, blobs, budget).where("state = 'verified'").select(*IDENTITY)
    return search(blobs.join(good, IDENTITY, "left_semi"), replace(spec, must_not_lines=True)).matches
