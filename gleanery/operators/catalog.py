"""Catalog of repos: listings, totals, facets, counters, upserts. Times that depend on now take it as as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions.display import slug
from ..sources.tables import materialize
from .retrieval import few

STATUSES = ("queued", "fetching", "indexing", "ready", "error")
# Shapes of ids.
UUID, DIGITS = r"^[0-9a-f-]{36}$", r"^\d+$"


def last_change() -> Column:
    return F.coalesce("indexed_at", "updated_at")


def listable_repos(repos: DataFrame, full: bool = False) -> DataFrame:
    """Public repos without errors; the full list keeps an errored one that was indexed once."""
    ok = (F.col("status") != "error") | F.col("indexed_at").isNotNull() if full else F.col("status") != "error"
    return repos.where(ok & ~F.col("is_private"))


def recent_repos(repos: DataFrame, n: int = 12) -> DataFrame:
    return listable_repos(repos).orderBy((F.col("status") == "ready").desc(), last_change().desc(), F.asc("id")).limit(n)


def all_repos(repos: DataFrame, n: int = 200) -> DataFrame:
    return listable_repos(repos, full=True).orderBy(last_change().desc(), F.asc("id")).limit(n)


def sort_repos(repos: DataFrame, mode: str) -> DataFrame:
    key = {"recent": last_change(), "searched": F.col("search_count"), "largest": F.col("total_chunks"), "stars": F.coalesce("stars", F.lit(0))}[mode]
    return repos.orderBy(key.desc(), F.asc("id"))


def positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a sorted table with their place from 1 on, without a task that has them all: places within the sort's ranges, and the rows of the ranges before (a row a range)."""
    at = F.monotonically_increasing_id()
    rows = materialize(ordered.withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def page(df: DataFrame, order: list[Column], size: int = 60, number: int = 1) -> DataFrame:
    """Rows of the pages up to the given one, as after so many clicks on "show more"."""
    return df.orderBy(*order).limit(size * number)


def site_stats(repos: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return repos.where(~F.col("is_private")).agg(F.count_if(F.col("status") == "ready").alias("ready"), total("total_chunks").alias("chunks"), total("search_count").alias("searches"), total("total_files").alias("files"))


def repo_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per repo: files, chunks, chunks with a vector."""
    f = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    c = chunks.groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count(F.when(F.col("embedded"), 1)).alias("embedded"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return f.join(c, "repo_id", "full_outer").select("repo_id", zero("files"), zero("chunks"), zero("embedded"))


def language_histogram(files: DataFrame) -> DataFrame:
    """(repo_id, languages): map of counts."""
    n = files.groupBy("repo_id", "language").agg(F.count("*").cast("int").alias("n"))
    return n.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))


def language_share(histogram: DataFrame, n: int = 5) -> DataFrame:
    """(repo_id, pos, language, files, share): the n largest languages of each repo."""
    entries = F.array_sort(F.transform(F.map_entries("languages"), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k"))))
    total = F.aggregate(F.map_values("languages"), F.lit(0), lambda a, x: a + x)
    rows = histogram.select("repo_id", F.greatest(total, F.lit(1)).alias("total"), F.posexplode(F.slice(entries, 1, n)).alias("pos", "e"))
    return rows.select("repo_id", "pos", F.col("e.k").alias("language"), (-F.col("e.m")).alias("files"), F.round(-F.col("e.m") / F.col("total"), 6).alias("share"))


def language_facets(histogram: DataFrame, n: int = 8) -> DataFrame:
    tops = histogram.select(D.top_language(F.col("languages")).alias("language")).where("language is not null")
    return tops.groupBy("language").agg(F.count("*").alias("repos")).orderBy(F.desc("repos"), F.asc("language")).limit(n)


def top_language_filter(histogram: DataFrame, language: str) -> DataFrame:
    return histogram.where(D.top_language(F.col("languages")) == language)


def tab_counts(repos: DataFrame) -> DataFrame:
    indexed = F.col("indexed_at").isNotNull()
    return repos.agg(F.count("*").alias("all_"), F.count_if("is_private").alias("private"), F.count_if(~F.col("is_private")).alias("public"), F.count_if(indexed).alias("indexed"))


def text_filter(repos: DataFrame, q: str) -> DataFrame:
    """Rows whose "owner/name description" holds the text, whatever the case; blank: all."""
    q = q.strip().lower()
    where = F.concat(F.col("owner"), F.lit("/"), F.col("name"), F.lit(" "), F.coalesce("description", F.lit("")))
    return repos.where(F.contains(F.lower(where), F.lit(q))) if q else repos


def tab_filter(repos: DataFrame, tab: str) -> DataFrame:
    return repos.where({"all": F.lit(True), "private": F.col("is_private"), "public": ~F.col("is_private"), "indexed": F.col("indexed_at").isNotNull()}[tab])


def public_repo(repos: DataFrame) -> DataFrame:
    """The fields and names that leave the catalog."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    same = ["id", "owner", "name", "description", "stars", "status"]
    named = {"statusMessage": "status_message", "commitSha": "commit_sha", "totalFiles": "total_files", "skippedFiles": "skipped_files", "totalChunks": "total_chunks", "embeddedChunks": "embedded_chunks", "searchCount": "search_count", "isPrivate": "is_private"}
    return repos.select(*same, *(F.col(v).alias(k) for k, v in named.items()), iso("indexed_at").alias("indexedAt"), iso("updated_at").alias("updatedAt"))


def repos_by_slug(repos: DataFrame, slugs: DataFrame) -> DataFrame:
    """Repos named in a table of slugs, whatever their case."""
    return repos.join(slugs.select(F.lower("slug").alias("slug")).distinct(), slug(F.col("owner"), F.col("name")) == F.col("slug"), "left_semi")


def search_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("repo_id").agg(F.count("*").alias("search_count"), F.max("ts").alias("last_searched_at"))


def requeue(repos: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """repos with those of the ids that are ready or failed put back into the queue."""
    now = F.lit(as_of).cast("timestamp")
    df = repos.join(ids.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    go = F.coalesce("asked", F.lit(False)) & F.col("status").isin("ready", "error")
    new = {"status": F.lit("queued"), "status_message": F.lit("Checking GitHub for changes"), "updated_at": now}
    return df.select(*(F.when(go, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in repos.columns))


def upsert_repos(current: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """(slug, status, status_message, is_private, updated_at): new repos are queued, failed ones again, private ones stay private."""
    now = F.lit(as_of).cast("timestamp")
    cur = current.select(slug(F.col("owner"), F.col("name")).alias("slug"), "status", "status_message", "is_private", "updated_at")
    new = incoming.select(slug(F.col("owner"), F.col("name")).alias("slug"), F.col("is_private").alias("p")).groupBy("slug").agg(F.max("p").alias("p"))
    df = cur.join(new, "slug", "full_outer")
    again = F.col("status").isNull() | (F.col("p").isNotNull() & (F.col("status") == "error"))
    return df.select("slug", F.when(again, "queued").otherwise(F.col("status")).alias("status"), F.when(~again, F.col("status_message")).alias("status_message"), (F.coalesce("is_private", F.lit(False)) | F.coalesce("p", F.lit(False))).alias("is_private"), F.when(again, now).otherwise(F.col("updated_at")).alias("updated_at"))


def mark_public(repos: DataFrame, ids: DataFrame) -> DataFrame:
    df = repos.join(ids.select("id").distinct().withColumn("open_", F.lit(True)), "id", "left")
    return df.select(*(F.when(F.col("open_").isNotNull(), False).otherwise(F.col(c)).alias(c) if c == "is_private" else F.col(c) for c in repos.columns))


def enrich_repos(repos: DataFrame, meta: DataFrame) -> DataFrame:
    """Description, stars and language from metadata where there is any; missing metadata changes nothing."""
    m = meta.select(F.col("id"), *(F.col(c).alias(f"m_{c}") for c in ("description", "stars", "language")))
    have = repos.columns
    df = repos.join(m, "id", "left")
    return df.select(*(F.coalesce(f"m_{c}", c).alias(c) if c in ("description", "stars") else F.col(c) for c in have), F.col("m_language").alias("primary_language"))


def status_violations(repos: DataFrame) -> DataFrame:
    return repos.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull())


def stale_runs(repos: DataFrame, as_of: str, minutes: int = 6) -> DataFrame:
    return repos.where((F.col("status") == "fetching") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")))


def eligible_repos(repos: DataFrame, as_of: str, most: int = 3, minutes: int = 6) -> DataFrame:
    """Repos that could start: queued or stale, and fewer than `most` others active in the last ten minutes."""
    now = F.lit(as_of).cast("timestamp")
    active = F.col("status").isin("fetching", "indexing") & (F.col("updated_at") > now - F.expr("INTERVAL 10 MINUTES"))
    total = repos.agg(F.count_if(active)).first()[0]
    stale = (F.col("status") == "fetching") & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    others = F.lit(total) - F.when(active, 1).otherwise(0)
    return repos.withColumn("others", others.cast("long")).where(((F.col("status") == "queued") | stale) & (F.col("others") < most))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def recent_opens(opens: DataFrame, n: int = 12) -> DataFrame:
    """The n repos a user opened last, newest first; a repo counts once, whatever the case of its name."""
    last = first_per_key(opens.withColumn("key", F.lower("slug")), ["user_id", "key"], [F.desc("ts"), F.desc("event_id")])
    return last.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("pos") <= n).drop("key")


def progress_rate(events: DataFrame, samples: int = 31) -> DataFrame:
    """Per event: chunks per second over the last samples of its repo; null with fewer than 3 of them or without progress."""
    w = Window.partitionBy("repo_id").orderBy("ts", "event_id").rowsBetween(-(samples - 1), 0)
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.first("ts").over(w))
    rate = (F.col("done") - F.first("done").over(w)) / F.nullif(seconds, F.lit(0))
    return events.withColumn("per_second", F.when((F.count("*").over(w) >= 3) & (rate > 0), F.round(rate, 6)))


def monotone_progress(events: DataFrame) -> DataFrame:
    """Per event: the progress shown, which never goes back."""
    w = Window.partitionBy("repo_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.max("done").over(w))


def granted_repos(pages: DataFrame) -> DataFrame:
    """(id, owner, name, is_private, pushed_at, pos): repos of listing pages (pos, repositories), the first of each id, newest push first."""
    rows = pages.select(F.col("pos").alias("page"), F.posexplode("repositories").alias("at", "r"))
    flat = rows.select("page", "at", F.col("r.id").alias("id"), F.col("r.owner.login").alias("owner"), F.col("r.name").alias("name"), F.col("r.private").alias("is_private"), F.col("r.pushed_at").alias("pushed_at"))
    once = first_per_key(flat, ["id"], [F.asc("page"), F.asc("at")])
    return once.orderBy(F.coalesce("pushed_at", F.lit("")).desc(), F.asc("page"), F.asc("at")).drop("page", "at")


def installations(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("installations").alias("i"))
    return rows.select(F.col("i.id").alias("id"), F.coalesce("i.account.login", F.lit("unknown")).alias("account"), F.coalesce("i.account.type", F.lit("User")).alias("account_type"))


def my_repos(granted: DataFrame, repos: DataFrame) -> DataFrame:
    """Granted repos with the status of their index, if they have one."""
    index = repos.select(slug(F.col("owner"), F.col("name")).alias("slug"), F.col("id").alias("index_id"), F.col("status").alias("index_status"))
    return granted.withColumn("slug", slug(F.col("owner"), F.col("name"))).join(index, "slug", "left")


def get_repo(repos: DataFrame, id: int | None = None, owner: str | None = None, name: str | None = None) -> DataFrame:
    """The repo of an id, or of an owner and name whatever their case; a plain filter that reaches the scan."""
    if id is not None:
        return repos.where(F.col("id") == id)
    return repos.where((F.lower("owner") == (owner or "").lower()) & (F.lower("name") == (name or "").lower()))


def chunk_detail(chunks: DataFrame, repos: DataFrame, visible: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk_id, user_id, repo_id, path, symbol, language, content) for asked results (chunk_id text, user_id): those whose id is a number, whose chunk and repo exist and whose repo the user may see. visible: (repo_id, user_id), user_id null for everyone."""
    ids = asked.where(F.col("chunk_id").rlike(DIGITS)).select("chunk_id", "user_id", F.expr("try_cast(chunk_id AS BIGINT)").alias("id"))
    found = chunks.select("id", "repo_id", "path", "symbol", "language", "content").join(few(ids), "id").join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    may = visible.select("repo_id", F.col("user_id").alias("who")).distinct()
    # (repo, null) opens to all, (repo, user) to one: two equi-joins
    open_ = found.join(may.where("who is null").select("repo_id"), "repo_id", "left_semi")
    own = found.join(may.where("who is not null").select("repo_id", F.col("who").alias("user_id")), ["repo_id", "user_id"], "left_semi")
    return open_.unionByName(own).distinct().select("chunk_id", "user_id", "repo_id", "path", "symbol", "language", "content")


def id_shapes(id: Column, number: Column) -> tuple[Column, Column]:
    """Whether a text looks like a UUID, and whether one is digits only."""
    return id.rlike(UUID), number.rlike(DIGITS)
