"""URL frontier as a table.

The crawl loop of the source is re-aimed as set operations over two tables:
the frontier (one row per known URL) and a table of fetched pages (one row
per fetch attempt with its status code, time and HTML).  A crawl pass is
one plan: slice → only-new filter → join outcomes → extract → merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import page_url, url_id
from . import pages as P
from .partitioning import ordered_places

# --- fixed values: frontier defaults and statuses --------------------------
STATUS_AVAILABLE = "available"
STATUS_UNAVAILABLE = "unavailable"
HTTP_OK = 200
# ---------------------------------------------------------------------------

def urls_to_frontier(df: DataFrame, url_col: str = "url", id_col: str | None = None) -> DataFrame:
    """H7: URL list → frontier rows with defaults (not crawled, available, no date).

    The id is the last 10 characters of the URL (F7) unless ``id_col`` names
    an existing key."""
    ident = F.col(id_col).cast("bigint") if id_col else url_id(url_col).try_cast("bigint")
    return df.select(
        F.col(url_col).alias("url"),
        ident.alias("id"),
        F.lit(0).alias("crawled"),
        F.lit(STATUS_AVAILABLE).alias("status"),
        F.lit(None).cast(T.TimestampType()).alias("crawlingDate"),
    )


def page_range_urls(df: DataFrame, keys, base_col: str, last_col: str, first: int = 1,
                    chunk: int = 10_000, page_col: str = "page", url_col: str = "url") -> DataFrame:
    """F13 over a table: one ``base?page=n`` row per page ``first..last`` of every row.

    A single row with a huge range (one site with a third of all pages) must
    not be expanded by one task.  Ranges are first cut into chunks of at most
    ``chunk`` pages; the chunk descriptors (few rows) are hash-distributed on
    (key, chunk) and only then expanded, so every task emits at most about
    ``chunk`` rows per descriptor it holds.  The redistribution names its
    partition count (the session's shuffle parallelism): adaptive execution
    would otherwise coalesce the tiny descriptor shuffle into one partition
    and put the whole expansion back into one task.
    """
    keys = list(keys)
    last = F.col(last_col).cast("long")
    n_chunks = F.floor((last - F.lit(first)) / F.lit(chunk)).cast("long") + F.lit(1)
    desc = (df.where(last >= F.lit(first))
            .select(*keys, base_col, last_col,
                    F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("__chunk")))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    desc = desc.repartition(n_parts, *[F.col(k) for k in keys], F.col("__chunk"))
    start = F.lit(first).cast("long") + F.col("__chunk") * F.lit(chunk)
    end = F.least(start + F.lit(chunk - 1), F.col(last_col).cast("long"))
    pages = desc.select(*keys, base_col, F.explode(F.sequence(start, end)).alias(page_col))
    return pages.select(*keys, F.col(page_col), page_url(base_col, page_col).alias(url_col))


def only_uncrawled(frontier: DataFrame, recrawl: bool = False) -> DataFrame:
    """Unless re-crawling, skip URLs already crawled."""
    return frontier if recrawl else frontier.where(F.col("crawled") == 0)


def row_range(df: DataFrame, order_cols, from_idx: int = 0, to_idx: int | None = None) -> Column | None:
    """Condition that holds for rows ``from_idx <= i < to_idx`` of ``df`` ordered by ``order_cols``
    (None for the whole table, which costs nothing).

    Only the order columns are sorted, by range over all partitions, and
    written to the shared checkpoint folder with each row's partition and
    place in it.  One count per partition tells where the two bounds lie; the
    keys found there are the condition's constants, so the wide table itself
    is filtered and neither sorted nor cached.  ``order_cols`` should be
    unique; rows that tie on all of them are in the range together.  Nulls
    come first.
    """
    if from_idx <= 0 and to_idx is None:
        return None
    names = list(order_cols)
    keys, counts = ordered_places(df.select(*names), *names)

    def key_at(idx: int):
        before = 0
        for part, n in counts:
            if idx < before + n:
                found = keys.where((F.col("__part") == part) & (F.col("__place") == idx - before))
                row = found.select(*names).first()
                return F.struct(*[F.lit(row[n]).cast(df.schema[n].dataType).alias(n) for n in names])
            before += n
        return None

    key = F.struct(*[F.col(n) for n in names])
    low, high = key_at(max(from_idx, 0)), key_at(max(to_idx, 0)) if to_idx is not None else None
    if low is None or (to_idx is not None and to_idx <= from_idx):
        return F.lit(False)
    return key >= low if high is None else (key >= low) & (key < high)


def slice_rows(df: DataFrame, order_cols, from_idx: int = 0, to_idx: int | None = None) -> DataFrame:
    """Rows ``from_idx <= i < to_idx`` of ``df`` ordered by ``order_cols`` (see ``row_range``)."""
    within = row_range(df, order_cols, from_idx, to_idx)
    return df if within is None else df.where(within)


def latest_fetches(fetches: DataFrame, time_col: str = "fetched_at", status_col: str = "status_code",
                   id_col: str | None = None) -> DataFrame:
    """The most recent attempt per URL (a fetch log may hold retries), without page bodies.

    One aggregation keyed by url (partial aggregation first, so a URL retried
    many times costs one row per map task); its output is already partitioned
    by url for the join that follows.  The ordering key is (time, status,
    ``id_col``, every other column given), so attempts only tie when they
    agree on all columns.
    """
    first = [time_col, status_col] + ([id_col] if id_col else [])
    others = first + [c for c in fetches.columns if c != "url" and c not in first]
    best = F.max(F.struct(*[F.col(c) for c in others])).alias("best")
    return fetches.groupBy("url").agg(best).select("url", *[F.col("best")[c].alias(c) for c in others])


def apply_fetch_outcomes(batch: DataFrame, fetches: DataFrame, status_col: str = "status_code",
                         time_col: str = "fetched_at") -> DataFrame:
    """H8: every attempted URL becomes crawled; 200 stamps the crawl time,
    anything else marks the URL unavailable.  URLs without a fetch row are
    left as they were.  ``fetches`` must hold at most one row per URL (see
    ``latest_fetches``)."""
    f = fetches.select("url", F.col(status_col).alias("__code"), F.col(time_col).alias("__at"))
    j = batch.join(f, "url", "inner")
    ok = F.col("__code") == F.lit(HTTP_OK)
    return j.select(
        "url", "id",
        F.lit(1).alias("crawled"),
        F.when(ok, F.col("status")).otherwise(F.lit(STATUS_UNAVAILABLE)).alias("status"),
        F.when(ok, F.col("__at").cast(T.TimestampType())).otherwise(F.col("crawlingDate")).alias("crawlingDate"),
    )


def merge_frontier(old: DataFrame, updates: DataFrame, key: str = "url") -> DataFrame:
    """Non-null update values overwrite old ones; nulls never overwrite.

    A left join keeps the frontier's row set (an update for an unknown URL is
    ignored, as in the source).  Both sides are hash-partitioned on ``key``.
    """
    u = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in updates.columns if c != key])
    j = old.join(u, key, "left")
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(key))
        elif f"__new_{c}" in u.columns:
            cols.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def new_urls(current: DataFrame, previous: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``current`` whose key is absent from ``previous`` (anti join).

    No ``distinct`` on ``previous``: duplicates cannot change an anti join,
    and keeping both sides plain shuffles lets adaptive execution split a
    skewed key.
    """
    return current.join(previous.select(key), key, "left_anti")


def crawl_pass(frontier: DataFrame, fetched: DataFrame, recrawl: bool = False, from_idx: int = 0,
               to_idx: int | None = None, order_cols=("id", "url")) -> tuple[DataFrame, DataFrame]:
    """H9: one crawl pass → (listing records, updated frontier).

    ``fetched`` holds (url, status_code, fetched_at, html), possibly several
    attempts per URL; the latest attempt decides.  The frontier update is ONE
    left join of the frontier with the latest fetch per URL and never reads a
    page body: a row is updated when it is in the row range, not yet crawled
    (unless ``recrawl``) and was fetched (the H8 rule, with the J4
    never-overwrite-with-null merge).  Records are the H1 fields of the rows
    so updated with status 200: the winning attempts are found first, on a
    hash of the body, and bodies join those only.
    """
    within = row_range(frontier, order_cols, from_idx, to_idx)
    due = F.lit(True) if within is None else within
    if not recrawl:
        due = due & (F.col("crawled") == 0)
    attempts = fetched.drop("html")
    latest = latest_fetches(attempts).select(
        "url", F.lit(True).alias("__fetched"), F.col("status_code").alias("__code"), F.col("fetched_at").alias("__at"))
    eligible = F.col("__fetched").isNotNull() & due    # any attempt counts, even one without a status
    ok = F.coalesce(F.col("__code") == F.lit(HTTP_OK), F.lit(False))
    updated = frontier.join(latest, "url", "left").select(*[
        F.when(eligible, F.lit(1)).otherwise(F.col("crawled")).alias("crawled") if c == "crawled" else
        F.when(eligible & ~ok, F.lit(STATUS_UNAVAILABLE)).otherwise(F.col("status")).alias("status")
        if c == "status" else
        F.when(eligible & ok, F.coalesce(F.col("__at").cast(T.TimestampType()), F.col("crawlingDate")))
        .otherwise(F.col("crawlingDate")).alias("crawlingDate") if c == "crawlingDate" else F.col(c)
        for c in frontier.columns])

    marked = fetched.withColumn("__body", F.xxhash64("html"))
    marks = [c for c in marked.columns if c not in ("url", "html")]
    winners = (latest_fetches(marked.drop("html")).where(F.col("status_code") == HTTP_OK)
               .join(frontier.where(due).select("url", "id"), "url")
               .select("id", F.col("url").alias("__url"), *[F.col(c).alias(f"__w_{c}") for c in marks]))
    same = F.col("url") == F.col("__url")
    for c in marks:
        same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    bodies = marked.where(F.col("status_code") == HTTP_OK).join(winners, same)
    pages = bodies.dropDuplicates(["id", "url"]).select("id", "html")      # equal attempts hold equal pages
    return P.listing_fields(pages, "html").drop("html"), updated
