"""Who may see what: sessions, access rows, answers from outside as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from .catalog import mark_public


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def viewers(sessions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """(session_id, user_id, login, name) of sessions that haven't expired."""
    live = sessions.where(F.col("expires_at") > _now(as_of)).select(F.col("id").alias("session_id"), "user_id")
    return live.join(users.withColumnRenamed("id", "user_id"), "user_id").select("session_id", "user_id", "login", "name")


def purge_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Sessions that stay."""
    return sessions.where(F.col("expires_at") >= _now(as_of))


def logout(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids, "id", "left_anti")


def fresh(as_of: str) -> Column:
    return F.col("verified_at") > _now(as_of) - F.expr("INTERVAL 1 HOUR")


def latest_access(access: DataFrame) -> DataFrame:
    return access.groupBy("repo_id", "user_id").agg(F.max("verified_at").alias("verified_at"))


def visible_repos(repos: DataFrame, access: DataFrame, answers: DataFrame, as_of: str, now_public: DataFrame | None = None) -> DataFrame:
    """(repo_id, user_id) of private repos that a user may see; public repos are open to all and come as user_id null.

    A fresh access row is enough. Else the answer decides: yes opens, no closes, unknown keeps what was there and never
    opens. A private repo that is reported public by now (now_public: id) opens for all.
    """
    if now_public is not None:
        repos = mark_public(repos, now_public.select("id").distinct())
    rows = latest_access(access).join(answers, ["repo_id", "user_id"], "full_outer")
    may = F.coalesce(fresh(as_of), F.lit(False)) | (F.col("answer") == "yes") | ((F.coalesce("answer", F.lit("unknown")) == "unknown") & F.col("verified_at").isNotNull())
    private = repos.where("is_private").select(F.col("id").alias("repo_id"))
    seen = rows.where(F.coalesce(may, F.lit(False))).select("repo_id", "user_id").join(private, "repo_id", "left_semi")
    return repos.where(~F.col("is_private")).select(F.col("id").alias("repo_id"), F.lit(None).cast("long").alias("user_id")).union(seen)


def apply_access(access: DataFrame, answers: DataFrame, as_of: str) -> DataFrame:
    """Access rows after the answers: yes writes or refreshes one, no deletes it, unknown leaves it."""
    rows = latest_access(access).join(answers, ["repo_id", "user_id"], "full_outer")
    kept = rows.where((F.coalesce("answer", F.lit("unknown")) == "yes") | ((F.coalesce("answer", F.lit("unknown")) == "unknown") & F.col("verified_at").isNotNull()))
    return kept.select("repo_id", "user_id", F.when(F.col("answer") == "yes", _now(as_of)).otherwise(F.col("verified_at")).alias("verified_at"))


def upsert_users(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """An incoming row replaces all columns of the user's, nulls too."""
    new = incoming.select("id", F.struct("login", "name").alias("new"))
    df = current.join(new, "id", "full_outer")
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return df.select("id", pick("login"), pick("name"))


def open_repos(refs: DataFrame, repos: DataFrame, visible: DataFrame, requeue_errors: bool = True) -> DataFrame:
    """(ref_id, slug, outcome, status) for typed references (id, user_id, ref): existing, requeued, created or not found.

    Not found: it is no reference, or its repo is private and not in visible (repo_id, user_id) for that user. Of repos
    with one slug, that with the smallest id counts.
    """
    r = D.parse_repo_ref(F.col("ref"))
    parsed = refs.select(F.col("id").alias("ref_id"), "user_id", r.alias("r")).select("ref_id", "user_id", D.slug(F.col("r.owner"), F.col("r.name")).alias("slug"), F.col("r").isNotNull().alias("ok"))
    known = repos.groupBy(D.slug(F.col("owner"), F.col("name")).alias("slug")).agg(F.min(F.struct("id", "status", "is_private")).alias("k"))
    df = parsed.join(known, "slug", "left").withColumn("repo_id", F.col("k.id"))
    mine = visible.where("user_id is not null").select("repo_id", "user_id", F.lit(True).alias("mine")).distinct()
    all_ = visible.where("user_id is null").select("repo_id", F.lit(True).alias("open")).distinct()
    df = df.join(mine, ["repo_id", "user_id"], "left").join(all_, "repo_id", "left")
    hidden = F.col("k").isNotNull() & F.col("mine").isNull() & F.col("open").isNull()
    again = (F.col("k.status") == "error") & F.lit(requeue_errors)
    outcome = F.when(~F.col("ok") | hidden, "not found").when(F.col("k").isNull(), "created").when(again, "requeued").otherwise("existing")
    status = F.when(F.col("outcome").isin("created", "requeued"), "queued").when(F.col("outcome") == "existing", F.col("k.status"))
    return df.withColumn("outcome", outcome).select("ref_id", F.when(F.col("ok"), F.col("slug")).alias("slug"), "outcome", status.alias("status"))
