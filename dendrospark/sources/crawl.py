"""Walk through stored directory listings: folders to follow, files to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

DEPTH = 3


def listing_links(listings: DataFrame) -> DataFrame:
    """(url, link): the anchors of (url, html) listings. Links that begin with "?", "/" or ".." lead out of a listing and go."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    rows = listings.select("url", F.explode(F.array_distinct(anchors)).alias("link"))
    return rows.where(~F.col("link").rlike(r"^(\?|/|\.\.)"))


def joined(base: Column, link: Column) -> Column:
    """Where a link leads: below the listing's address; absolute addresses stay."""
    return F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), link))


def cell_id(name: Column) -> Column:
    """What a file is called without its extension."""
    return F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def crawl(listings: DataFrame, seeds: DataFrame, extensions: tuple[str, ...] = (".swc",), depth: int = DEPTH) -> DataFrame:
    """(url, depth, listing, filename, cell_id): files with one of the extensions that listings lead to, from ``seeds`` (url) on.

    Links that end in "/" are folders. A folder is opened at the least depth at
    which it is met, once, and none deeper than ``depth``; so circles end. A file's
    row has the least depth, then the first listing, it is met at. Each step joins
    the frontier with the links and takes away what was visited; it ends with the
    frontier. Addresses without a listing lead nowhere; null addresses and pages go.
    """
    links = stored(listing_links(listings.where("url is not null")).select("url", joined(F.col("url"), F.col("link")).alias("to"), "link"), "links")
    folder = F.col("link").endswith("/")
    key = lambda c: F.regexp_replace(c, "/+$", "/")
    folders = links.where(folder).select(key(F.col("url")).alias("url"), key(F.col("to")).alias("to"))
    frontier = stored(seeds.where("url is not null").select(key(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct(), "frontier")
    levels = [frontier]
    for k in range(1, depth + 1):
        found = frontier.join(folders, "url").select(F.col("to").alias("url"), F.lit(k).alias("depth")).distinct()
        for level in levels:
            found = found.join(level, "url", "left_anti")
        frontier = stored(found, "frontier")
        if frontier.isEmpty():
            discard(frontier)
            break
        levels.append(frontier)
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.union(level)
    extension = F.lower(F.regexp_extract("link", r"[^/.](\.[^./]*)$", 1))
    files = links.where(~folder & extension.isin(*[e.lower() for e in extensions]))
    rows = files.select(key(F.col("url")).alias("listing"), "to", F.col("link").alias("filename")).join(visited.withColumnRenamed("url", "listing"), "listing")
    first = rows.groupBy(F.col("to").alias("url")).agg(F.min(F.struct("depth", "listing", "filename")).alias("v"))
    return first.select("url", "v.*").withColumn("cell_id", cell_id(F.col("filename")))
