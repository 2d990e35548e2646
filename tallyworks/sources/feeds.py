"""Semi-structured sources: JSON document folders, JSON-lines vaults, XML feeds, graph documents. All lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """One JSON document a file, names that begin with `_` skipped; of documents with one key the first by file name stays."""
    found = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__file", F.input_file_name())
    first = Window.partitionBy(key).orderBy("__file")
    keyed = found.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return keyed.where(~F.regexp_extract("__file", r"([^/]+)$", 1).startswith("_")).drop("__n", "__file")


def case_documents(spark: SparkSession, path: str, schema: T.StructType | str, template_titles: list[str]) -> DataFrame:
    """Case metadata without the rows that still have a template's title."""
    return spark.read.schema(schema).option("multiLine", True).json(path).where(F.col("title").isNotNull() & ~F.col("title").isin(template_titles))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Vault of JSON lines, gzip or plain."""
    return spark.read.schema(schema).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "gzip").json(path)


def feed_entries(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of RSS or Atom files: title, url, published (first date field that isn't empty), body (longest of five)."""
    text = T.StringType()
    link = T.StructType([T.StructField("_href", text), T.StructField("_VALUE", text)]) if row_tag == "entry" else text
    fields = ["title", "guid", "id", "pubDate", "published", "updated", "date", "description", "summary", "content", "encoded", "comments"]
    schema = T.StructType([T.StructField(f, text) for f in fields] + [T.StructField("link", link)])
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    url = F.coalesce("link._href", "link._VALUE") if row_tag == "entry" else F.col("link")
    return raw.select(
        F.trim("title").alias("title"),
        F.coalesce(blank_to_null(url), blank_to_null(F.col("guid")), blank_to_null(F.col("id"))).alias("url"),
        F.coalesce(*[blank_to_null(F.col(c)) for c in ("pubDate", "published", "updated", "date")]).alias("published"),
        longest(*[F.col(c) for c in ("encoded", "content", "description", "summary", "comments")]).alias("body"),
    )


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def longest(*cs: Column) -> Column:
    """The longest of several strings, the first of those of one length."""
    structs = [F.struct(F.length(F.coalesce(c, F.lit(""))).alias("n"), F.lit(-i).alias("i"), c.alias("v")) for i, c in enumerate(cs)]
    return F.greatest(*structs)["v"]


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of one JSON document {nodes: [...], links: [...]}."""
    schema = "nodes array<struct<id string, label string, type string, `group` string, gen int, mentions int>>, links array<struct<source string, target string, relation string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("links"))


#: A whole feed as one column: entries below channel (RSS) or below the root (Atom).
_ITEM = "struct<title string, guid string, id string, pubDate string, published string, updated string, description string, summary string, content string, link string>"
RSS = f"channel struct<item array<{_ITEM}>>"
ATOM = f"entry array<{_ITEM.replace('link string', 'link struct<_href string, _VALUE string>')}>"


def entries_of(df: DataFrame, xml: str, atom: bool = False) -> DataFrame:
    """Entries of feeds held as text (the answers of http_text): the other columns of df, then title, url, published, body.

    What isn't XML gives no rows. Built-in XML functions, no Python.
    """
    parsed = F.from_xml(F.col(xml), ATOM if atom else RSS, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    entry = F.explode(parsed["entry"] if atom else parsed["channel"]["item"]).alias("e")
    rows = df.select(*[c for c in df.columns if c != xml], entry)
    link = F.coalesce("e.link._href", "e.link._VALUE") if atom else F.col("e.link")
    return rows.select(
        *[c for c in df.columns if c != xml],
        F.trim("e.title").alias("title"),
        F.coalesce(blank_to_null(link), blank_to_null(F.col("e.guid")), blank_to_null(F.col("e.id"))).alias("url"),
        F.coalesce(*[blank_to_null(F.col(f"e.{c}")) for c in ("pubDate", "published", "updated")]).alias("published"),
        longest(*[F.col(f"e.{c}") for c in ("content", "description", "summary")]).alias("body"),
    )
