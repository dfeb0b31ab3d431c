"""Model files and tables: navigation models, golden models, versions, classifications, records, settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

#: The columns of a navigation model and the kinds of its rows that extract data.
TARGET = ("src", "kind", "xpath", "dest_or_field", "subtype", "menu_xpath", "menu_type")
DATA_KINDS = ("string", "url", "img")


@dataclass(frozen=True)
class Seed:
    """Settings of one site, with their defaults."""

    site: str
    model_file: str = ""
    golden: str = ""
    model_pages: int = 0
    javascript: bool = False
    crawl: bool = False
    save_pages: bool = False
    wait_ms: int = 2000
    random_pause_ms: int = 1000
    max_failures: int = 1
    pages: int = 1_000_000


def seeds(spark: SparkSession, settings: list[dict]) -> DataFrame:
    """Seeds with defaults filled in, one row a site."""
    return spark.createDataFrame([asdict(Seed(**s)) for s in settings], "site string, model_file string, golden string, model_pages int, javascript boolean, crawl boolean, save_pages boolean, wait_ms int, random_pause_ms int, max_failures int, pages int")


def parse_target(lines: DataFrame) -> DataFrame:
    """Rows (line number ``ord``, text ``value``) of a navigation model as its seven columns; short rows keep empty ones."""
    cells = F.split("value", "\t", -1)
    return lines.select("ord", *[F.coalesce(F.get(cells, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(TARGET)])


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """A navigation model file; lines keep their order within the file."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))
    return parse_target(lines.filter(F.col("value") != ""))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Navigation models of many sites, as :func:`write_site_lines` writes them: site and the columns of :func:`parse_target`."""
    lines = spark.read.text(path, wholetext=True).select(F.col("site").cast("string").alias("site"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))
    cells = F.split("value", "\t", -1)
    return lines.filter(F.col("value") != "").select("site", "ord", *[F.coalesce(F.get(cells, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(TARGET)])


def target_links(target: DataFrame) -> DataFrame:
    """Class links: src, xpath, link_type (list, menu, form, singleton), anchor_text, dest, menu_xpath, menu_type."""
    kind = F.when(F.col("subtype").isin("list", "menu", "form"), F.col("subtype")).otherwise("singleton")
    return target.filter(F.col("kind") == "link").select("ord", "src", "xpath", kind.alias("link_type"), F.when(kind == "singleton", F.col("subtype")).alias("anchor_text"), F.col("dest_or_field").alias("dest"), F.nullif("menu_xpath", F.lit("")).alias("menu_xpath"), F.nullif("menu_type", F.lit("")).alias("menu_type"))


def target_data(target: DataFrame) -> DataFrame:
    """Data links: class, ord (place within the class, as an integer), xpath, data_type, field_name."""
    rows = target.filter(F.col("kind").isin(*DATA_KINDS))
    place = F.row_number().over(Window.partitionBy("src").orderBy("ord")) - 1
    return rows.select(F.col("src").alias("class_name"), place.alias("ord"), "xpath", F.col("kind").alias("data_type"), F.nullif("dest_or_field", F.lit("")).alias("field_name"))


def target_forms(target: DataFrame) -> DataFrame:
    return target.filter(F.col("kind") == "form").select(F.col("src").alias("class_name"), F.col("xpath").alias("form"))


def target_classes(target: DataFrame) -> DataFrame:
    """Classes: every source and every destination of a link; the first row's source is the root."""
    names = target.select("ord", F.col("src").alias("name")).union(target.filter("kind = 'link'").select("ord", F.col("dest_or_field")))
    first = target.agg(F.min_by("src", "ord").alias("root"))
    return names.filter("name <> ''").groupBy("name").agg(F.min("ord").alias("first")).crossJoin(F.broadcast(first)).select("name", (F.col("name") == F.col("root")).alias("is_root"))


def parse_golden(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (name, pattern) before the blank line and links (src, link_type, dest, ord) after it."""
    gap = lines.filter(F.trim("value") == "").agg(F.coalesce(F.min("ord"), F.lit(1 << 30)).alias("gap"))
    rows = lines.crossJoin(F.broadcast(gap)).withColumn("cells", F.split("value", "\t", -1))
    classes = rows.filter("ord < gap").select(F.col("cells")[0].alias("name"), F.explode(F.split(F.col("cells")[1], ",")).alias("pattern"))
    links = rows.filter("ord > gap AND trim(value) <> ''").select(F.col("cells")[0].alias("src"), F.col("cells")[1].alias("link_type"), F.col("cells")[2].alias("dest"), "ord")
    return classes, links


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    whole = spark.read.text(path, wholetext=True)
    return parse_golden(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value")))


def model_lines(links: DataFrame, forms: DataFrame | None = None, data: DataFrame | None = None) -> DataFrame:
    """A navigation model's lines, in the order of depth, class and path: links, and forms and data rows where given.

    ``links``: (depth, src, xpath, dest, subtype, menu_xpath, menu_type); ``forms``: (depth, class_name, form); ``data``:
    (depth, class_name, ord, data_type, xpath, field_name). A class's form and data follow its links, data in record order.
    """
    line = F.concat_ws("\t", "src", F.lit("link"), "xpath", "dest", F.coalesce("subtype", F.lit("")), F.coalesce("menu_xpath", F.lit("")), F.coalesce("menu_type", F.lit("")))
    trimmed = lambda c: F.regexp_replace(c, "\t+$", "").alias("value")
    kept = ["site"] if "site" in links.columns else []
    out = links.select(*kept, "depth", "src", "xpath", trimmed(line))
    if forms is None and data is None:
        return out
    out = out.withColumns({"block": F.lit(0), "ord": F.lit(0)})
    if forms is not None:
        out = out.unionByName(forms.select("depth", F.col("class_name").alias("src"), F.col("form").alias("xpath"), F.concat_ws("\t", "class_name", F.lit("form"), "form").alias("value"), F.lit(1).alias("block"), F.lit(0).alias("ord")))
    if data is not None:
        row = F.concat_ws("\t", "class_name", "data_type", "xpath", F.coalesce("field_name", F.lit("")))
        out = out.unionByName(data.select("depth", F.col("class_name").alias("src"), "xpath", trimmed(row), F.lit(2).alias("block"), "ord"))
    return out


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines as one text file in that order; a model has as many as a site has kinds of links."""
    lines.orderBy(*order).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_site_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines (site, value) in that order as a text file for each site, in a folder of its own."""
    lines.repartition("site").sortWithinPartitions("site", *order).select("site", "value").write.mode("overwrite").partitionBy("site").text(path)


def classification_lines(assignment: DataFrame) -> DataFrame:
    return assignment.select(F.concat_ws("\t", "class_name", "url", "file").alias("value"))


def next_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Versions (site, version, ts, root_class) with rows of ``new`` (site, ts, root_class) added under the next number."""
    last = versions.groupBy("site").agg(F.max("version").alias("last"))
    added = new.join(last, "site", "left").select("site", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "ts", "root_class")
    return versions.select("site", "version", "ts", "root_class").unionByName(added)


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("site").agg(F.max("version").alias("version"), F.max_by("root_class", "version").alias("root_class"))


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def delete_oldest(versions: DataFrame, n: int) -> DataFrame:
    """What stays when the ``n`` oldest versions of each site go."""
    return versions.join(oldest(versions, n).select("site", "version"), ["site", "version"], "left_anti")


def oldest(versions: DataFrame, n: int) -> DataFrame:
    """(site, version, root_class) of the ``n`` oldest versions of each site."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("ts", "version"))
    return versions.withColumn("rank", rank).filter(F.col("rank") <= n).select("site", "version", "root_class")


def delete_models(versions: DataFrame, links: DataFrame, data: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, links and data that stay when the ``n`` oldest versions of each site go, with all that their roots reach.

    ``links``: (site, version, src, dest, ...) and ``data``: (site, version, class_name, ...). Classes that a root doesn't reach,
    and classes without a version, stay as they are.
    """
    from ..operators.graph import bfs_depth

    gone = oldest(versions, n)
    model = F.concat_ws("\n", "site", F.col("version").cast("string")).alias("model")
    reached = bfs_depth(links.join(gone.select("site", "version"), ["site", "version"], "left_semi").select(model, "src", "dest"), gone.select(model, F.col("root_class").alias("name")))
    parts = F.split("model", "\n")
    reached = reached.select(parts[0].alias("site"), parts[1].cast("int").alias("version"), "name")
    keys = ["site", "version"]
    kept = [df.join(reached.withColumnRenamed("name", c), [*keys, c], "left_anti").select(df.columns) for df, c in ((links, "src"), (data, "class_name"))]
    return versions.join(gone.select(*keys), keys, "left_anti"), kept[0], kept[1]


def record_header(data: DataFrame) -> DataFrame:
    """URL and the field names of each class, or an empty array if one has no name."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("field_name", F.lit("")).alias("field_name")))), lambda f: f["field_name"])
    return data.groupBy("class_name").agg(names.alias("names")).select("class_name", F.when(F.exists("names", lambda x: x == ""), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("URL")), "names")).alias("header"))


def record_rows(records: DataFrame) -> DataFrame:
    """Records (url, class_name, record) as lines; a single field that holds tabs is a row for each part."""
    parts = F.when(F.size("record") == 1, F.split(F.col("record")[0], "\t", -1)).otherwise(F.array(F.array_join("record", "\t")))
    return records.select("class_name", "url", F.posexplode(parts).alias("nth", "field")).select("class_name", "url", "nth", F.concat_ws("\t", "url", "field").alias("value"))


def write_records(rows: DataFrame, path: str) -> None:
    """Lines (site, class_name, value) as text, a folder for each site and class."""
    rows.select("site", "class_name", "value").write.mode("overwrite").partitionBy("site", "class_name").text(path)


def url_class_index(crawled: DataFrame) -> DataFrame:
    return crawled.select("site", F.concat_ws("\t", "url", "class_name", urls.save_path(F.col("site"), F.col("url"))).alias("value"))
