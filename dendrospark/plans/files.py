"""Queries over files that Spark derives from the driver's tables: images, numbered lines, saved pages, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import crawl, images, lines, paged
from ..sources import files as written
from . import fixtures as fx
from .catalog import new_folder, query, r
from .fixtures import rounded

# Images: three channels made of a pixel's value, places without a row are 0.
_IMAGE = f"p AS ({fx.PIXELS}), v AS (SELECT DISTINCT view_id FROM p), cells AS (SELECT view_id, CAST(k // 8 AS INT) AS r, CAST(k % 8 AS INT) AS c FROM v, (SELECT unnest(range(64)) AS k)), val AS (SELECT cells.*, coalesce(val, 0) AS val FROM cells LEFT JOIN p USING (view_id, r, c))"


def image_set(spark, d):
    """(name, ...): an image of 8 x 8 pixels for each view."""
    p = fx.pixels(spark, d).groupBy("view_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") * 8 + F.col("c")).alias("k"), "val"))).alias("m"))
    byte = lambda v: F.substr(F.hex(v.cast("bigint") + 256), F.lit(2))
    value = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.concat(byte(value(k) * 40), byte(value(k) * 20 + 3), byte(255 - value(k))))
    name = F.concat(F.when(F.col("view_id") % 2 == 0, "images/").otherwise(""), F.col("view_id").cast("string"), F.lit(".png"))
    return p.select(name.alias("name"), *[F.lit(v).alias(c) for c, v in (("height", 8), ("width", 8), ("channels", 3), ("bits", 8))], F.unhex(F.concat_ws("", cells)).alias("pixels"))


@query("S16_image_read", f"WITH {_IMAGE} SELECT view_id, r, c, {r('(val * 40 + val * 20 + 3 + 255 - val) / 3.0 / 255', 'intensity', 4)} FROM val")
def _(spark, d):
    folder = new_folder(spark, "images")
    made = written.write_files(images.encoded(image_set(spark, d), (4, 3, 2, 1, 0)), folder)
    made.write.format("noop").mode("overwrite").save()
    # The manifest leaves out "images/" where the file has it, and the other way round.
    views = fx.pixels(spark, d).select("view_id").distinct()
    manifest = views.select("view_id", F.concat(F.when(F.col("view_id") % 2 == 1, "images/").otherwise(""), F.col("view_id").cast("string"), F.lit(".png")).alias("image"))
    files = images.png_files(spark, folder)
    seen = images.intensities(images.with_images(manifest, images.decoded(files), folder, "view_id", files))
    rows = seen.select("view_id", F.posexplode("values").alias("k", "intensity"))
    return rounded(rows.select("view_id", F.expr("cast(k div 8 as int)").alias("r"), F.expr("k % 8").alias("c"), "intensity"), "intensity", places=4)


@query("S7_line_numbers", "SELECT event_id, CAST(event_id % 5 AS INT) AS bucket, row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS line_no FROM events")
def _(spark, d):
    folder = new_folder(spark, "lines")
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 5).cast("int").alias("bucket"), "event_id", F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("value"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "value").write.partitionBy("bucket").text(folder)
    got = lines.numbered_lines(spark, folder)
    return got.select(F.regexp_extract("value", r"line (\d+)", 1).cast("long").alias("event_id"), F.regexp_extract("path", r"bucket=(\d+)", 1).cast("int").alias("bucket"), "line_no")


@query("S11_pages", "SELECT CAST(floor(p_partkey / 50) AS INT) AS page, p_partkey, p_name FROM part WHERE floor(p_partkey / 50) >= 2")
def _(spark, d):
    folder = new_folder(spark, "pages")
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("page", F.floor(F.col("p_partkey") / 50).cast("int"))
    total = p.agg((F.max("page") + 1).alias("n"))
    lists = p.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("items")).crossJoin(F.broadcast(total))
    body = F.to_json(F.struct(F.struct(F.col("items").alias("parts")).alias("_embedded"), F.struct(F.col("n").alias("totalPages")).alias("page")))
    saved = lists.select(F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit(".json")).alias("name"), F.encode(body, "utf-8").alias("content"))
    written.write_files(saved, folder).write.format("noop").mode("overwrite").save()
    got = paged.pages(spark, written.located(spark, folder), pages="1000000").where("page >= 2")
    item = F.from_json("item", "p_partkey long, p_name string")
    return got.select("page", item.alias("i")).select("page", "i.*")


# Listings: each page leads to two others, to itself, to the texts of its own links as files, and out of the archive.
_LISTING = """n AS (SELECT max(page_id) + 1 AS n FROM pages), t AS (SELECT page_id, n, regexp_extract_all(html, '<a href="/([A-Za-z]+)"', 1) AS names FROM pages, n),
 dirs AS (SELECT page_id, unnest([(page_id * 7 + 1) % n, (page_id * 5 + 3) % n, page_id]) AS other FROM t), names AS (SELECT DISTINCT page_id, unnest(names) AS name FROM t)"""


@query(
    "S14_crawl",
    f"""WITH RECURSIVE {_LISTING}, walk AS (SELECT page_id, 0 AS depth FROM pages WHERE page_id % 10 = 0 UNION SELECT other, depth + 1 FROM walk JOIN dirs USING (page_id) WHERE depth < 3),
 least AS (SELECT page_id, min(depth) AS depth FROM walk WHERE page_id IN (SELECT page_id FROM pages) GROUP BY 1)
 SELECT concat('https://archive/', page_id, '/', name, '.swc') AS url, depth, name AS cell_id FROM least JOIN names USING (page_id)""",
)
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    n = pages.agg((F.max("page_id") + 1).alias("n"))
    folder = lambda k: F.concat(F.lit('<a href="https://archive/'), k.cast("string"), F.lit('/">'))
    names = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]+)"'), F.lit(1)), lambda x: F.concat(F.lit('<a href="'), x, F.lit('.swc">'), F.lit('<a href="'), x, F.lit('.txt">')))
    html = F.concat(F.col("html"), folder((F.col("page_id") * 7 + 1) % F.col("n")), folder((F.col("page_id") * 5 + 3) % F.col("n")), folder(F.col("page_id")), F.lit('<a href="../up.swc">'), F.array_join(names, ""))
    address = F.concat(F.lit("https://archive/"), F.col("page_id").cast("string"), F.lit("/"))
    listings = pages.crossJoin(F.broadcast(n)).select("page_id", address.alias("url"), html.alias("html"))
    return crawl.crawl(listings.select("url", "html"), listings.where("page_id % 10 = 0").select("url")).select("url", "depth", "cell_id")
