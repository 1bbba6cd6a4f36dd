"""Readers: texts, files, pages and structured records become documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.core import clamp01, clean_text, content_id
from .json_split import json_items

# The order in which a MIME type's words decide a reader, and file extensions.
MIME_WORDS = ("html", "json", "xml", "pdf", "csv", "markdown")
EXTENSIONS = {
    "html": "html", "htm": "html", "json": "json", "xml": "xml", "pdf": "pdf", "csv": "csv", "md": "markdown", "markdown": "markdown", "txt": "text",
}


def documents_from_text(df: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Inline documents (document_id, content, source_url, tags): texts trimmed, a url made where none is given; and the rejects without a text.

    A document without a text takes that of the page (url, content) stored for its url, where ``pages`` has one.
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    if pages is not None:
        held = pages.groupBy(F.col("url").alias("source_url")).agg(F.max("content").alias("stored"))
        df = df.join(held, "source_url", "left")
        text = F.when(text == "", F.trim(F.coalesce("stored", F.lit("")))).otherwise(text)
        rest = [c for c in df.columns if c != "stored"]
        df = df.withColumn("content", text).select(*rest)
        text = F.col("content")
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    url = F.coalesce("source_url", F.concat(F.lit("text://"), F.col("document_id").cast("string")))
    rows = df.withColumn("content", text).withColumn("source_url", url).withColumn("tags", tags).withColumn("content_length", F.length("content"))
    return rows.where("content <> ''"), rows.where("content = ''")


def documents_from_dir(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder that fits a pattern: path, title (the stem), content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("title"), F.decode("content", "UTF-8").alias("content"))


def content_type(mime: Column, name: Column) -> Column:
    """The reader for a MIME type, else for a file name's extension, else text."""
    by_mime = F.when(F.lit(False), "")
    for w in MIME_WORDS:
        by_mime = by_mime.when(F.lower(mime).contains(w), w)
    table = F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p])
    return F.coalesce(by_mime, F.when(mime.isNull(), F.element_at(table, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))), F.lit("text"))


def html_title(html: Column) -> Column:
    return clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_to_text_basic(html: Column) -> Column:
    """Text of a page by patterns: scripts and styles go, tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    return clean_text(F.regexp_replace(bare, r"<[^>]+>", " "))


def html_to_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title and main text of pages by walking their tags: furniture goes, the first main region counts, else the body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.htmltext import main_text

        for b in batches:
            got = [main_text(h or "") for h in b[html_col]]
            yield b.drop(columns=[html_col]).assign(title=[t for t, _ in got], content=[x for _, x in got])

    keep = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html_col)
    return pages.mapInPandas(run, f"{keep}, title string, content string")


def text_to_doc(text: Column) -> tuple[Column, Column]:
    """(title, body) of plain text: a first line under 100 characters without a full stop is the title.

    The body keeps the text when the title would leave it empty.
    """
    head = F.trim(F.substring_index(text, "\n", 1))
    titled = (F.length(head) > 0) & (F.length(head) < 100) & ~head.endswith(".")
    rest = clean_text(F.regexp_replace(text, r"^[^\n]*\n?", ""))
    return F.when(titled, head), F.when(titled & (rest != ""), rest).otherwise(clean_text(text))


def markdown_to_doc(text: Column) -> tuple[Column, Column]:
    """(title, body): the first top heading; the body without the signs of the notation."""
    title = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.when(title != "", F.trim(title)), clean_text(F.translate(text, "#*_`[]()", ""))


def json_title(text: Column) -> Column:
    """The first text among title, name, subject, heading."""
    return F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("title", "name", "subject", "heading")])


@F.pandas_udf(StringType())
def json_leaves(texts: pd.Series) -> pd.Series:
    """Strings, numbers and booleans of a JSON text, depth first to five levels, joined by spaces; null when it is no JSON."""
    import json

    def walk(x: object, depth: int) -> Iterator[str]:
        if isinstance(x, (dict, list)):
            if depth < 5:
                for y in x.values() if isinstance(x, dict) else x:
                    yield from walk(y, depth + 1)
        elif x is not None:
            yield str(x)

    def one(t: str | None) -> str | None:
        try:
            return " ".join(walk(json.loads(t), 0)) if t is not None else None
        except ValueError:
            return None

    return texts.map(one)


def rows_to_doc(rows: DataFrame, order: str) -> DataFrame:
    """A table as one text by ``file``: cells joined by " | ", rows by line feeds, in order; title from its first headers."""
    cells = [c for c in rows.columns if c not in ("file", order)]
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy("file").agg(held.alias("held")).select(
        "file", F.lit("CSV Data: " + ", ".join(cells[:3])).alias("title"),
        F.concat_ws("\n", F.lit(" | ".join(cells)), F.array_join("held.line", "\n")).alias("content"), F.size("held").alias("row_count"), F.lit(len(cells)).alias("column_count"),
    )


def csv_to_doc(spark: SparkSession, path: str, lines: int | None = 10_000) -> DataFrame:
    """CSV files below ``path`` as texts: file, part, title, content, row_count, column_count, by the rules of ``rows_to_doc``.

    Cells are read by Spark's CSV reader. No file is held in one row: what a task reads of it is cut every ``lines`` rows,
    each part begins with the headers, and parts rise in the file's order. Without ``lines`` each file is one whole text, part 0.
    """
    rows = spark.read.option("header", True).csv(path)
    cells = rows.columns
    at = F.monotonically_increasing_id()
    placed = rows.select(
        F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in cells]).alias("line"), F.col("_metadata.file_path").alias("file"),
        at.alias("at"),
    )
    held = F.array_sort(F.collect_list(F.struct("at", "line")))
    part = F.lit(0).cast("long") if lines is None else F.expr(f"shiftright(at, 33) * {1 << 33} + (at & {(1 << 33) - 1}) div {lines}")
    return placed.groupBy("file", part.alias("part")).agg(held.alias("held")).select(
        "file", "part", F.lit("CSV Data: " + ", ".join(cells[:3])).alias("title"),
        F.concat_ws("\n", F.lit(" | ".join(cells)), F.array_join("held.line", "\n")).alias("content"), F.size("held").alias("row_count"), F.lit(len(cells)).alias("column_count"),
    )


def xml_to_doc(xml: Column) -> tuple[Column, Column]:
    """(title, text) of XML: the first title element, else the first name; all text nodes."""
    title = F.coalesce(F.nullif(F.xpath_string(xml, F.lit("//title")), F.lit("")), F.nullif(F.xpath_string(xml, F.lit("//name")), F.lit("")))
    return title, clean_text(F.array_join(F.xpath(xml, F.lit("//text()")), " "))


def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page for each item of JSON array files: file, page_number, total_pages, text (list values joined by line feeds), in order.

    Several tasks read one file (``json_items``).
    """
    items = json_items(spark, path).withColumn("item", F.from_json("item", "map<string,string>"))
    lists = F.transform_values("item", lambda k, v: F.coalesce(F.array_join(F.from_json(v, "array<string>"), "\n"), v))
    return items.select("file", (F.col("pos") + 1).cast("int").alias("page_number"), F.col("n_items").cast("int").alias("total_pages"), F.array_join(F.map_values(lists), "\n").alias("text")).orderBy("file", "page_number")


def product_text(title: Column, keywords: Column, description: Column, specification: Column) -> Column:
    """Labelled text of a product; lists by line feeds, lists of maps as ``k: v`` lines."""
    spec = F.array_join(
        F.transform(specification, lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")),
        "\n",
    )
    parts = [("Title", title), ("Keywords", F.array_join(keywords, ", ")), ("Description", description), ("Specification", spec)]
    return F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts])


def elements_to_pages(elements: DataFrame) -> DataFrame:
    """Elements (file, page, pos, text) of one page joined in order; those without a number form one page."""
    held = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return elements.groupBy("file", F.coalesce("page", F.lit(0)).alias("page_number")).agg(
        F.array_join(F.transform(held, lambda x: x["text"]), "\n").alias("text"),
    )


def documents_from_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """Crawled pages (url, html) as documents: furniture cut, short ones skipped, title else url, tag web-crawl."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|footer|header)[^>]*>.*?</\1>", " ")
    text = clean_text(F.regexp_replace(bare, r"<[^>]+>", " "))
    title = html_title(F.col("html"))
    rows = pages.withColumn("content", text).where(F.length("content") >= least)
    return rows.select(
        F.sha1("url").alias("document_id"), "url", F.when(title != "", title).otherwise(F.col("url")).alias("title"), "content",
        F.array(F.lit("web-crawl")).alias("tags"),
    )


def _given(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a table may lack; null without it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def ingest_associations(rows: DataFrame, least_score: float = 0.0, tag: str = "associations", max_n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Disease–target associations as entities and RELATED_TO edges.

    Rows: disease_id, disease_name, target_id, symbol, target_name, biotype, score; optionally disease_description, synonyms (array), therapeutic_areas
    (array of names), functions (array: the first is a target's description). A target's name is its symbol, else its name. ``max_n`` keeps a
    disease's strongest associations (ties by target). Nodes: entity_id, name, entity_type, description, alias (a target's name beside its symbol), aliases,
    tags, annotations and properties (maps), trust; one row for each id, from its first row by name. Edges: ids, type, description, strength, trust.
    Rows with a null score, disease_id or target_id are left out; an empty table gives two empty tables.
    """
    none = F.array().cast("array<string>")
    kept = rows.where((F.col("score") >= least_score) & F.col("disease_id").isNotNull() & F.col("target_id").isNotNull())
    if max_n is not None:
        best = kept.groupBy("disease_id", "target_id").agg(F.max("score").alias("s"))
        nth = F.row_number().over(Window.partitionBy("disease_id").orderBy(F.desc("s"), "target_id"))
        best = best.withColumn("nth", nth).where(F.col("nth") <= max_n).select("disease_id", "target_id")
        kept = kept.join(best, ["disease_id", "target_id"], "left_semi")
    blank = F.create_map().cast("map<string,string>")
    areas = F.array_join(F.coalesce(_given(rows, "therapeutic_areas", "array<string>"), none), ",")
    disease = kept.select(
        content_id(F.lit("disease"), F.col("disease_id")).alias("entity_id"), F.col("disease_name").alias("name"),
        F.nullif(_given(rows, "disease_description", "string"), F.lit("")).alias("description"), F.lit(None).cast("string").alias("alias"),
        F.coalesce(_given(rows, "synonyms", "array<string>"), none).alias("aliases"), F.concat_ws(",", F.lit(tag), F.lit("disease")).alias("tags"),
        F.when(areas != "", F.create_map(F.lit("therapeutic_areas"), areas)).otherwise(blank).alias("annotations"), blank.alias("properties"),
    )
    alias = F.when(F.col("symbol") != F.col("target_name"), F.col("target_name"))
    target = kept.select(
        content_id(F.lit("target"), F.col("target_id")).alias("entity_id"), F.coalesce(F.nullif("symbol", F.lit("")), "target_name").alias("name"),
        F.get(_given(rows, "functions", "array<string>"), 0).alias("description"), alias.alias("alias"), F.array_compact(F.array(alias)).alias("aliases"),
        F.concat_ws(",", F.lit(tag), F.lit("target"), "biotype").alias("tags"), blank.alias("annotations"),
        F.map_filter(F.create_map(F.lit("biotype"), F.col("biotype"), F.lit("approved_name"), F.col("target_name")), lambda _, v: v.isNotNull()).alias("properties"),
    )
    nodes = disease.unionByName(target)
    rest = [c for c in nodes.columns if c not in ("entity_id", "name")]
    nodes = nodes.groupBy("entity_id").agg(F.min("name").alias("name"), F.min_by(F.struct(*rest), "name").alias("rest")).select(
        "entity_id", "name", "rest.*", F.lit("Concept").alias("entity_type"), F.lit("reviewed").alias("trust"),
    )
    edges = kept.groupBy("disease_id", "target_id").agg(F.max("score").alias("score")).select(
        content_id(F.lit("disease"), F.col("disease_id")).alias("source_entity_id"), content_id(F.lit("target"), F.col("target_id")).alias("target_entity_id"), F.lit("RELATED_TO").alias("relationship_type"),
        F.format_string("Association score: %.3f", "score").alias("description"), clamp01(F.col("score")).alias("strength"), F.lit("reviewed").alias("trust"),
    )
    return nodes, edges


def ingest_articles(rows: DataFrame, mesh: bool = True, keywords: bool = True, tag: str = "articles") -> tuple[DataFrame, DataFrame]:
    """Articles (pmid, title, abstract, authors, mesh_terms, keywords; optionally doi, journal, publication_date) as nodes and edges.

    Nodes: entity_id, name, entity_type (Document, Person, Concept), description, tags, properties, trust; people and concepts are one node each over all
    articles, whatever the case of their names. Edges: ids, type, description, trust. Rows with a null pmid are left out.
    """
    rows = rows.where("pmid is not null")
    none = F.array().cast("array<string>")
    terms = F.array_union(F.coalesce("mesh_terms", none) if mesh else none, F.coalesce("keywords", none) if keywords else none)
    article, pmid = content_id(F.lit("article"), F.col("pmid")), F.col("pmid").cast("string").alias("pmid")
    props = F.create_map(*[x for c in ("pmid", "journal", "publication_date", "doi") for x in (F.lit(c), _given(rows, c, "string").cast("string"))])
    docs = rows.select(
        article.alias("entity_id"), F.col("title").alias("name"), F.lit("Document").alias("entity_type"),
        F.substring("abstract", 1, 500).alias("description"), F.lit(tag).alias("tags"), F.map_filter(props, lambda _, v: v.isNotNull()).alias("properties"),
    )
    people = rows.select(pmid, article.alias("source_entity_id"), F.explode(F.array_distinct(F.coalesce("authors", none))).alias("name"))
    topics = rows.select(pmid, article.alias("source_entity_id"), F.explode(terms).alias("name"))
    nodes, edges = docs, None
    for df, kind, label, mark, said in ((people, "Person", "AUTHORED_BY", "author", "authored by"), (topics, "Concept", "CATEGORIZED_AS", "mesh", "categorised as")):
        named = df.withColumn("target_entity_id", content_id(F.lit(kind), F.lower(F.trim("name"))))
        nodes = nodes.unionByName(
            named.groupBy(F.col("target_entity_id").alias("entity_id"))
            .agg(F.min("name").alias("name"))
            .select(
                "entity_id", "name", F.lit(kind).alias("entity_type"), F.lit(None).cast("string").alias("description"), F.lit(f"{tag},{mark}").alias("tags"),
                F.create_map().cast("map<string,string>").alias("properties"),
            )
        )
        told = F.concat_ws(f" {said} ", F.min("pmid"), F.min("name")).alias("description")
        more = named.groupBy("source_entity_id", "target_entity_id").agg(told).withColumn("relationship_type", F.lit(label)).withColumn("trust", F.lit("reviewed"))
        edges = more if edges is None else edges.unionByName(more)
    return nodes.withColumn("trust", F.lit("reviewed")), edges


def read_curation_events(spark: SparkSession, path: str) -> DataFrame:
    """Curation events from JSON array files, in their order (``seq``, from 0 in each file)."""
    kind = "action string, target_id string, reason string, curator string, corrections map<string,string>"
    items = json_items(spark, path).withColumn("event", F.from_json("item", kind))
    return items.select("event.*", F.col("pos").alias("seq"))


def read_context_map(spark: SparkSession, path: str) -> DataFrame:
    """relationship_id and passage from JSON object files."""
    pair = F.from_json(F.concat(F.lit("{"), "item", F.lit("}")), "map<string,string>")
    return json_items(spark, path).select(F.explode(pair).alias("relationship_id", "context"))
