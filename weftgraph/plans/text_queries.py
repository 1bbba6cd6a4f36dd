"""Registered queries over texts: sources, chunks, scalar functions, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as N
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import pages as X
from ..sources import documents as S
from .registry import query, table

CLEAN = "trim(regexp_replace(regexp_replace({0}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0B}}]+', ' ', 'g'), '[\\x{{00}}-\\x{{08}}\\x{{0B}}\\x{{0C}}\\x{{0E}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]', '', 'g'))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))


def fixed(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_fixed(docs(spark, d), 512, 50)


WINDOW_SQL = """w AS (SELECT doc_id AS document_id, i AS chunk_index, substring(text, i * {step} + 1, {size}) AS content, i * {step} AS start_position
  FROM documents, unnest(range(0, CAST(ceil(greatest(0, length(text) - {size}) / {step}.0) AS BIGINT) + 1)) AS u(i) WHERE length(text) > 0)"""
FIXED_SQL = "WITH " + WINDOW_SQL.format(step=462, size=512) + """, t AS (SELECT document_id, start_position, regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '') AS content FROM w),
 c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY start_position) - 1 AS chunk_index, content, start_position FROM t WHERE content <> '')"""
IDENTITY_SQL = FIXED_SQL + """, i AS (SELECT *, sha1(concat_ws(':', document_id, chunk_index, content)) AS chunk_id FROM c)"""


@query("chunk_documents", FIXED_SQL + " SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, content, CAST(start_position AS BIGINT) AS start_position FROM c")
def chunk_documents(spark, d):
    return fixed(spark, d).select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content",
        F.col("start_position").cast("long").alias("start_position"),
    )


@query("chunk_streamed", FIXED_SQL + " SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, content, CAST(start_position AS BIGINT) AS start_position FROM c")
def chunk_streamed(spark, d):
    return C.chunk_streamed(docs(spark, d), C.fixed_pieces())


@query("chunk_window", "WITH " + WINDOW_SQL.format(step=900, size=1000) + " SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, content FROM w")
def chunk_window(spark, d):
    return C.chunk_window(docs(spark, d)).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("chunk_tokens", """WITH t AS (SELECT doc_id AS document_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents)
  SELECT document_id, i AS chunk_index, array_to_string(words[i * 180 + 1 : i * 180 + 200], ' ') AS content
  FROM t, unnest(range(0, CAST(ceil(greatest(0, len(words) - 200) / 180.0) AS BIGINT) + 1)) AS u(i) WHERE len(words) > 0""")
def chunk_tokens(spark, d):
    return C.chunk_tokens(docs(spark, d)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("match_rules", r"""WITH t AS (SELECT item_id AS rule_id, item_id % 2 = 0 AS exact, unnest(list_distinct(list_append(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) > 8), substring(text, 1, 12)))) AS term FROM benchmark)
  SELECT DISTINCT doc_id AS chunk_id, rule_id FROM documents JOIN t ON CASE WHEN exact THEN contains(text, term) ELSE contains(lower(text), lower(term)) END""")
def match_rules(spark, d):
    """Each benchmark item is a rule: its beginning as a pattern, its long words as keywords; every other one minds case."""
    b = table(spark, d, "benchmark")
    rules = b.select(
        F.col("item_id").alias("rule_id"), (F.col("item_id") % 2 == 0).alias("case_sensitive"), F.array(F.substring("text", 1, 12)).alias("patterns"),
        F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 8).alias("keywords"),
    )
    return G.match_rules(docs(spark, d).select(F.col("document_id").alias("chunk_id"), "content"), rules)


SENTENCE_SQL = r"""WITH s AS (SELECT doc_id AS document_id, list_filter(flatten(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)),
  lambda x: string_split_regex(x, '\n{2,}'))), lambda x: trim(x) <> '') AS sentences FROM documents)"""


@query("split_sentences", SENTENCE_SQL + " SELECT document_id, len(sentences) AS n_sentences, md5(array_to_string(sentences, '|')) AS digest FROM s")
def split_sentences(spark, d):
    s = docs(spark, d).select("document_id", C.split_sentences(F.col("content")).alias("sentences"))
    return s.select("document_id", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|")).alias("digest"))


@query("chunk_semantic")
def chunk_semantic(spark, d):
    from ..operators.vectors import hashed_embedding

    s = docs(spark, d).select("document_id", C.split_sentences(F.col("content")).alias("sentences"))
    # dealt out by document before vectors are made: texts alone travel, and the work does not hang on how the table is cut into files
    each = s.select("document_id", F.posexplode("sentences").alias("pos", "sentence")).repartition("document_id").withColumn("vector", hashed_embedding("sentence"))
    held = F.array_sort(F.collect_list(F.struct("pos", "sentence", "vector")))
    rows = (
        each.groupBy("document_id")
        .agg(held.alias("held"))
        .select("document_id", F.col("held.sentence").alias("sentences"), F.col("held.vector").alias("vectors"))
    )
    return C.chunk_semantic(rows)


@query("chunk_stats", FIXED_SQL + """, v AS (SELECT *, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS words FROM c)
  SELECT document_id, chunk_index, len(words) AS word_count, length(content) - length(translate(content, '.!?', '')) AS sentence_count,
  round(list_sum(list_transform(words, lambda x: length(x))) / len(words)::DOUBLE, 9) AS avg_word_length, round(len(words) / length(content)::DOUBLE, 9) AS content_density FROM v""")
def chunk_stats(spark, d):
    s = C.chunk_stats(fixed(spark, d))
    return s.select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("word_count").cast("long").alias("word_count"),
        F.col("sentence_count").cast("long").alias("sentence_count"), F.round("avg_word_length", 9).alias("avg_word_length"),
        F.round("content_density", 9).alias("content_density"),
    )


@query("chunk_identity", IDENTITY_SQL + """ SELECT document_id, chunk_index, chunk_id, length(content) AS length, row_number() OVER w AS position,
  CAST(coalesce(sum(length(content)) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS content_offset
  FROM i WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)""")
def chunk_identity(spark, d):
    s = C.chunk_identity(fixed(spark, d))
    return s.select("document_id", "chunk_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "length", "position", "content_offset")])


@query("chunk_links", IDENTITY_SQL + """ SELECT CAST(document_id AS VARCHAR) AS src_id, chunk_id AS dst_id, 'FIRST_CHUNK' AS edge_type FROM i WHERE chunk_index = 0
  UNION ALL SELECT * FROM (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_index) AS n, 'NEXT_CHUNK' FROM i) WHERE n IS NOT NULL""")
def chunk_links(spark, d):
    return C.chunk_links(C.chunk_identity(fixed(spark, d)))


@query("chunk_membership", IDENTITY_SQL + """ SELECT CAST(document_id AS VARCHAR) AS src_id, chunk_id AS dst_id, 'HAS_CHUNK' AS edge_type FROM i
  UNION ALL SELECT chunk_id, CAST(document_id AS VARCHAR), 'PART_OF' FROM i""")
def chunk_membership(spark, d):
    return C.chunk_membership(C.chunk_identity(fixed(spark, d)))


COMBINED_SQL = IDENTITY_SQL + """, b AS (SELECT document_id, chunk_index // 4 AS batch, string_agg(content, '' ORDER BY chunk_index) AS content, list(chunk_id ORDER BY chunk_index) AS ids FROM i GROUP BY 1, 2)"""


@query("combine_chunks", COMBINED_SQL + " SELECT document_id, batch, md5(content) AS digest, array_to_string(ids, ',') AS ids FROM b")
def combine_chunks(spark, d):
    s = C.combine_chunks(C.chunk_identity(fixed(spark, d)), 4)
    return s.select(
        "document_id", F.col("batch").cast("long").alias("batch"), F.md5("content").alias("digest"),
        F.array_join("combined_chunk_ids", ",").alias("ids"),
    )


@query("spread_combined", COMBINED_SQL + " SELECT unnest(ids) AS chunk_id, document_id, batch FROM b")
def spread_combined(spark, d):
    s = C.combine_chunks(C.chunk_identity(fixed(spark, d)), 4)
    return C.spread_combined(s).select("chunk_id", "document_id", F.col("batch").cast("long").alias("batch"))


@query("clean_text", f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", N.clean_text(F.col("text")).alias("cleaned"))


@query("search_terms", f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({', '.join(f"'{w}'" for w in N.STOP_WORDS)})) AS ws FROM documents),
  u AS (SELECT doc_id, ws[i] AS w, i FROM t, unnest(range(1, len(ws) + 1)) AS u(i)), f AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM u GROUP BY doc_id, lower(w))
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS terms FROM f GROUP BY doc_id""")
def search_terms(spark, d):
    terms = table(spark, d, "documents").select("doc_id", N.search_terms(F.col("text")).alias("t"))
    return terms.where(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"))


@query("claim_terms", f"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({', '.join(f"'{w}'" for w in N.STOP_WORDS)})) AS ws FROM benchmark)
  SELECT item_id, array_to_string(list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda x: lower(x)), lower(w)) = i), ' ') AS terms FROM t""")
def claim_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(N.search_terms(F.col("text")), " ").alias("terms"))


@query("snippets", "WITH t AS (SELECT doc_id, trim(text) AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL OR t = '' THEN NULL WHEN length(t) <= 220 THEN t ELSE regexp_replace(substring(t, 1, 219), '(?s)^(.*) [^ ]*$', '\\1') || '…' END AS snippet FROM t")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", N.snippet(F.col("text")).alias("snippet"))


@query("content_ids", "SELECT doc_id, sha1(concat_ws(':', doc_id, source)) AS id, sha256(text) AS content_hash FROM documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", N.content_id(F.col("doc_id"), F.col("source")).alias("id"), F.sha2("text", 256).alias("content_hash"),
    )


@query("negations", "SELECT doc_id, {} AS negated FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)".format(" OR ".join(f"starts_with(t, '{w.replace(chr(39), chr(39) * 2)}') OR contains(t, ' {w.replace(chr(39), chr(39) * 2)}')" for w in N.NEGATIONS)))
def negations(spark, d):
    return table(spark, d, "documents").select("doc_id", N.has_negation(F.col("text")).alias("negated"))


@query("html_to_text_basic", r"WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS h FROM pages) SELECT page_id, " + CLEAN.format("regexp_replace(h, '<[^>]+>', ' ', 'g')") + " AS content FROM t")
def html_to_text_basic(spark, d):
    return table(spark, d, "pages").select("page_id", S.html_to_text_basic(F.col("html")).alias("content"))


@query("html_to_text")
def html_to_text(spark, d):
    return S.html_to_text(table(spark, d, "pages").select("page_id", "html"))


@query("documents_from_pages", "WITH t AS (SELECT url, html, " + CLEAN.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer>', ' ', 'g'), '(?is)<header[^>]*>.*?</header>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + " AS content, " + CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title FROM pages) SELECT sha1(url) AS document_id, url, CASE WHEN title <> '' THEN title ELSE url END AS title, content FROM t WHERE length(content) >= 50")
def documents_from_pages(spark, d):
    return S.documents_from_pages(table(spark, d, "pages")).drop("tags")


@query("text_to_doc", "WITH t AS (SELECT doc_id, text, trim(string_split(text, chr(10))[1]) AS h, " + CLEAN.format("regexp_replace(text, '^[^\\n]*\\n?', '')") + " AS rest FROM documents), u AS (SELECT *, length(h) > 0 AND length(h) < 100 AND NOT ends_with(h, '.') AS titled FROM t) SELECT doc_id, CASE WHEN titled THEN h END AS title, CASE WHEN titled AND rest <> '' THEN rest ELSE " + CLEAN.format("text") + " END AS body FROM u")
def text_to_doc(spark, d):
    title, body = S.text_to_doc(F.col("text"))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), body.alias("body"))


@query("markdown_to_doc", "WITH t AS (SELECT doc_id, '# Part ' || doc_id || chr(10) || '*' || text || '*' AS m FROM documents) SELECT doc_id, trim(regexp_extract(m, '(?m)^#\\s+(.+)$', 1)) AS title, " + CLEAN.format("translate(m, '#*_`[]()', '')") + " AS body FROM t")
def markdown_to_doc(spark, d):
    m = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("# Part "), F.col("doc_id").cast("string"), F.lit("\n*"), "text", F.lit("*")).alias("m"),
    )
    title, body = S.markdown_to_doc(F.col("m"))
    return m.select("doc_id", title.alias("title"), body.alias("body"))


@query("json_to_doc", "SELECT event_id, json_extract_string(j, '$.name') AS title, event_type || ' ' || json_extract_string(props, '$.k') AS content FROM (SELECT event_id, event_type, props, json_object('name', event_type, 'inner', CAST(props AS JSON)) AS j FROM events)")
def json_to_doc(spark, d):
    j = table(spark, d, "events").select("event_id", F.concat(F.lit('{"name":"'), "event_type", F.lit('","inner":'), "props", F.lit("}")).alias("j"))
    return j.select("event_id", S.json_title(F.col("j")).alias("title"), S.json_leaves("j").alias("content"))


@query("rows_to_doc", """SELECT n_regionkey::VARCHAR AS file, 'CSV Data: n_nationkey, n_name' AS title, 'n_nationkey | n_name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS content, count(*) AS row_count FROM nation GROUP BY 1""")
def rows_to_doc(spark, d):
    rows = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("file"), F.col("n_nationkey").alias("place"), "n_nationkey", "n_name",
    )
    return S.rows_to_doc(rows, "place").select("file", "title", "content", F.col("row_count").cast("long").alias("row_count"))


@query("elements_to_pages", "SELECT conv_id::VARCHAR AS file, CAST(CASE WHEN turn > 5 THEN 0 ELSE turn // 2 END AS BIGINT) AS page_number, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def elements_to_pages(spark, d):
    t = table(spark, d, "conversations")
    page = F.when(F.col("turn") <= 5, F.floor(F.col("turn") / 2).cast("long"))
    return S.elements_to_pages(t.select(F.col("conv_id").cast("string").alias("file"), page.alias("page"), F.col("turn").alias("pos"), "text")).withColumn("page_number", F.col("page_number").cast("long"))


@query("documents_from_text", "SELECT doc_id AS document_id, trim(text) AS content, 'text://' || doc_id AS source_url, length(trim(text)) AS content_length, array_to_string(CASE WHEN trim(source) = '' THEN [] ELSE [lower(trim(source))] END, ',') AS tags FROM documents WHERE trim(coalesce(text, '')) <> ''")
def documents_from_text(spark, d):
    t = table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("source_url"),
        F.array(F.upper("source"), F.lit(" ")).alias("tags"),
    )
    ok, _ = S.documents_from_text(t)
    return ok.select(
        "document_id", "content", "source_url", F.col("content_length").cast("long").alias("content_length"), F.array_join("tags", ",").alias("tags"),
    )


@query("content_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'markdown' ELSE 'text' END AS kind FROM pages")
def content_types(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id") % 4
    mime = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "application/json")
    name = F.when(k == 2, "a.b.MD").otherwise("notes")
    return p.select("page_id", S.content_type(mime, name).alias("kind"))


HREF_SQL = """SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda h: trim(h)), lambda h: NOT regexp_matches(h, '(?i)^(#|javascript:|mailto:|$)')) AS hs FROM pages"""


@query("page_links", f"SELECT url, hs[i] AS href, CAST(i - 1 AS BIGINT) AS pos FROM ({HREF_SQL}), unnest(range(1, len(hs) + 1)) AS u(i)")
def page_links(spark, d):
    return X.extract_links(table(spark, d, "pages")).select("url", "href", F.col("pos").cast("long").alias("pos"))


#: The pages' links are all relative to their host's root.
LINK_SQL = r"""WITH h AS (SELECT url, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '(?i)^(#|javascript:|mailto:|$)')) AS hs FROM pages),
  k AS (SELECT url, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(url, '^[a-z]+://[^/?#]+') || hs[i] AS link FROM h, unnest(range(1, len(hs) + 1)) AS u(i))"""


@query("resolved_links", LINK_SQL + " SELECT * FROM k")
def resolved_links(spark, d):
    return X.extract_links(table(spark, d, "pages")).select("url", "pos", "link")


#: No link of these pages leads to a stored page, so the crawl ends one level below its seeds.
@query("crawl_order", LINK_SQL + """, s AS (SELECT url, CAST(min(page_id + 1) AS BIGINT) AS rank, 0 AS level FROM pages WHERE page_id < 5 GROUP BY 1),
  f AS (SELECT link AS url, min({'r': rank, 'p': pos}) AS via FROM s JOIN k USING (url) WHERE link NOT IN (SELECT url FROM s) GROUP BY 1),
  n AS (SELECT url, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY via, url) AS rank, 1 AS level FROM f) SELECT * FROM s UNION ALL SELECT * FROM n WHERE rank <= 100""")
def crawl_order(spark, d):
    p = table(spark, d, "pages")
    seeds = p.where("page_id < 5").select("url", (F.col("page_id") + 1).alias("rank"))
    return X.crawl_order(X.extract_links(p), seeds, [], [], 100)


@query("allowed_domains", "SELECT page_id, url FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS h FROM pages) WHERE h LIKE '%1%' OR NOT contains(h, '1')")
def allowed_domains(spark, d):
    p = table(spark, d, "pages")
    return p.where(X.domain_allowed(F.col("url"), [], ["blocked.example"])).select("page_id", "url")


@query("remaining_urls", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def remaining_urls(spark, d):
    p = table(spark, d, "pages")
    return X.remaining(p, p.where("page_id % 3 = 0").select("url").distinct())


@query("cache_stats", "SELECT count(*) AS entries, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def cache_stats(spark, d):
    from ..operators.retrieve import cache_stats as stats

    return stats(table(spark, d, "pages"))


@query("fresh_events", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) <= 864000")
def fresh_events(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("fetched_at"))
    return X.fresh_pages(e, 864000, F.lit("2024-01-31 00:00:00")).select("event_id")
