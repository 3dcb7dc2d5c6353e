"""Registered queries of the archive engine, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import authors, keywords, text
from millrace.operators import cosine, counts, fuzzy, merge, umap, vectors
from millrace.operators.bitmaps import FacetBitmaps
from millrace.operators.phrases import phrase_hits as hits_of_phrases
from millrace.operators.phrases import phrases_of
from millrace.operators.quadtree import nearest_points as nearest_of_taps
from millrace.operators.trigrams import search_many as searched
from millrace.plans.archive import submissions, texts
from millrace.plans.facets import FacetQuery, Vocabulary
from millrace.plans.labels import LexicalClassifier, classify
from millrace.sources import crawl, html
from millrace.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOPICS = Vocabulary(("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL", "Everything else"), fallback="STANDARD")
INCLUDE = FacetQuery(topics=("PROMO", "SMALL"))
EXCLUDE = FacetQuery(topics=("PROMO", "SMALL"), mode="exclude")
YEARS = FacetQuery(years=(1996, 1998))

_LINES = """
    s AS (SELECT o_orderkey AS row_ord, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS topic_area, o_custkey FROM orders),
    lines AS (SELECT l_orderkey, p_type, lower(p_brand) AS brand, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
    tt AS (SELECT l_orderkey AS row_ord, p_type AS topic, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(pos), p_type) - 1 AS place FROM lines GROUP BY 1, 2),
    kk AS (SELECT l_orderkey AS row_ord, brand AS keyword, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(pos), brand) - 1 AS place FROM lines GROUP BY 1, 2),
    st AS (SELECT s.*, tt.topic, tt.place FROM s JOIN tt USING (row_ord)),
    sel AS (SELECT row_ord FROM tt WHERE topic IN ('PROMO', 'SMALL') GROUP BY 1 HAVING count(*) = 2)
"""


def query(name: str, sql: str | None = None, lines: bool = False):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {_LINES} {sql}" if lines else sql
        return f

    return register


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- facet views


def _bitmaps(spark: SparkSession, folder: str) -> FacetBitmaps:
    return FacetBitmaps(submissions(spark, folder), ["row_ord"])


@query("bitmap_topic_counts_include", "SELECT topic, count(*) AS n FROM st JOIN sel USING (row_ord) GROUP BY topic", lines=True)
def bitmap_topic_counts_include(spark, folder):
    bits = _bitmaps(spark, folder)
    return bits.counts(bits.select(INCLUDE), "topic").withColumnRenamed("value", "topic")


@query("bitmap_topic_counts_exclude", "SELECT topic, count(*) AS n FROM st WHERE row_ord NOT IN (SELECT row_ord FROM sel) GROUP BY topic", lines=True)
def bitmap_topic_counts_exclude(spark, folder):
    bits = _bitmaps(spark, folder)
    return bits.counts(bits.select(EXCLUDE), "topic").withColumnRenamed("value", "topic")


@query("bitmap_year_topics", "SELECT year, topic, count(*) AS n FROM st JOIN sel USING (row_ord) GROUP BY 1, 2", lines=True)
def bitmap_year_topics(spark, folder):
    bits = _bitmaps(spark, folder)
    return bits.pivot(bits.select(INCLUDE))


@query("bitmap_facet_rows", "SELECT row_ord, year FROM s WHERE year IN (1996, 1998) AND row_ord NOT IN (SELECT row_ord FROM sel)", lines=True)
def bitmap_facet_rows(spark, folder):
    bits = _bitmaps(spark, folder)
    return bits.selected_rows(bits.select(FacetQuery(years=(1996, 1998), topics=EXCLUDE.topics, mode="exclude")))


@query("topic_counts", "SELECT topic, count(*) AS n FROM st GROUP BY topic", lines=True)
def topic_counts(spark, folder):
    return counts.topic_counts(submissions(spark, folder))


@query("topic_counts_include_all", "SELECT topic, count(*) AS n FROM st JOIN sel USING (row_ord) GROUP BY topic", lines=True)
def topic_counts_include(spark, folder):
    return counts.topic_counts(INCLUDE.filtered(submissions(spark, folder)))


@query("topic_counts_exclude_all", "SELECT topic, count(*) AS n FROM st WHERE row_ord NOT IN (SELECT row_ord FROM sel) GROUP BY topic", lines=True)
def topic_counts_exclude(spark, folder):
    return counts.topic_counts(EXCLUDE.filtered(submissions(spark, folder)))


@query("facet_rows", "SELECT row_ord, year FROM s WHERE year IN (1996, 1998) AND row_ord IN (SELECT row_ord FROM sel)", lines=True)
def facet_rows(spark, folder):
    both = FacetQuery(years=YEARS.years, topics=INCLUDE.topics)
    return both.filtered(submissions(spark, folder)).select("row_ord", "year")


@query("year_counts", "SELECT year, count(*) AS n FROM s GROUP BY year", lines=True)
def year_counts(spark, folder):
    return counts.year_counts(submissions(spark, folder))


@query("year_counts_zero_filled", "SELECT y AS year, count(s.year) AS n FROM (VALUES (1994), (1996), (1998), (2003)) v(y) LEFT JOIN s ON s.year = y GROUP BY y", lines=True)
def year_counts_filled(spark, folder):
    return counts.year_counts_filled(submissions(spark, folder), [1994, 1996, 1998, 2003])


_PIVOT = """
    , tot AS (SELECT year, count(*) AS year_total FROM s GROUP BY 1),
    dim AS (SELECT topic, CAST(row_number() OVER (ORDER BY count(*) DESC, topic) AS INTEGER) AS topic_rank FROM st GROUP BY 1),
    p AS (SELECT tot.year, dim.topic, count(st.row_ord) AS n, year_total, topic_rank FROM tot CROSS JOIN dim LEFT JOIN st ON st.year = tot.year AND st.topic = dim.topic GROUP BY ALL)
"""


@query("topic_year_pivot", _PIVOT + "SELECT year, topic, n, year_total, n / year_total * 100 AS share, topic_rank FROM p", lines=True)
def topic_year_pivot(spark, folder):
    return counts.topic_year_pivot(submissions(spark, folder))


@query("topic_year_stack", _PIVOT + ", e AS (SELECT year, topic, n, CAST(sum(n) OVER (PARTITION BY year ORDER BY topic_rank) AS BIGINT) AS y1 FROM p) SELECT year, topic, n, y1 - n AS y0, y1 FROM e", lines=True)
def topic_year_stack(spark, folder):
    return counts.stacked(counts.topic_year_pivot(submissions(spark, folder)))


@query(
    "topic_share_delta",
    """, t AS (SELECT count(*) FILTER (year = 1996) AS from_total, count(*) FILTER (year = 2000) AS to_total FROM s),
    c AS (SELECT topic, count(*) FILTER (year = 1996) AS from_n, count(*) FILTER (year = 2000) AS to_n FROM st WHERE year IN (1996, 2000) GROUP BY 1)
    SELECT topic, from_n, to_n, from_total, to_total, round(from_n / from_total * 100, 6) AS from_share, round(to_n / to_total * 100, 6) AS to_share,
           round(to_n / to_total * 100 - from_n / from_total * 100, 6) AS delta FROM c, t""",
    lines=True,
)
def topic_share_delta(spark, folder):
    out = counts.topic_deltas(submissions(spark, folder), 1996, 2000)
    return out.withColumns({c: F.round(c, 6) for c in ("from_share", "to_share", "delta")})


@query(
    "adjacent_year_pairs",
    """, y AS (SELECT s.year, count(DISTINCT tt.row_ord) AS k FROM s LEFT JOIN tt USING (row_ord) GROUP BY 1),
    w AS (SELECT year, k, lag(year) OVER o AS p, lead(year) OVER o AS q, coalesce(lag(k) OVER o, lead(k) OVER o) AS b FROM y WINDOW o AS (ORDER BY year))
    SELECT year, coalesce(p, year) AS from_year, CASE WHEN p IS NOT NULL THEN year ELSE q END AS to_year, k > 0 OR b > 0 AS comparable FROM w WHERE p IS NOT NULL OR q IS NOT NULL""",
    lines=True,
)
def adjacent_year_pairs(spark, folder):
    return counts.adjacent_years(submissions(spark, folder))


@query("latest_year_pair", "SELECT lag(year) OVER (ORDER BY year) AS from_year, year AS to_year FROM (SELECT DISTINCT year FROM st) ORDER BY year DESC LIMIT 1", lines=True)
def latest_year_pair(spark, folder):
    return counts.latest_comparable(submissions(spark, folder))


@query("default_year_pair", "SELECT min(year) AS from_year, max(year) AS to_year FROM s", lines=True)
def default_year_pair(spark, folder):
    return counts.default_pair(submissions(spark, folder))


@query("kpis", "SELECT (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM sel) AS filtered, (SELECT count(DISTINCT topic) FROM st JOIN sel USING (row_ord)) AS topics, (SELECT count(DISTINCT year) FROM s JOIN sel USING (row_ord)) AS years", lines=True)
def kpis(spark, folder):
    return counts.kpis(submissions(spark, folder), INCLUDE.matches())


@query("topic_trend_rows", "SELECT year, topic, count(*) AS n FROM st JOIN sel USING (row_ord) GROUP BY 1, 2", lines=True)
def topic_trend_rows(spark, folder):
    return counts.topic_counts(FacetQuery(years=(1996,), topics=INCLUDE.topics).trend_rows(submissions(spark, folder)), "year")


@query("highlighted_points", "SELECT count(*) FILTER (row_ord IN (SELECT row_ord FROM sel)) AS highlighted, count(*) AS points FROM s", lines=True)
def highlighted_points(spark, folder):
    return submissions(spark, folder).agg(F.count_if(INCLUDE.matches()).alias("highlighted"), F.count("*").alias("points"))


@query("topics_in_use", ", v(topic_id, topic) AS (VALUES (0, 'STANDARD'), (1, 'ECONOMY'), (2, 'MEDIUM'), (3, 'PROMO'), (4, 'LARGE'), (5, 'SMALL'), (6, 'Everything else')) SELECT topic_id, topic FROM v WHERE topic IN (SELECT topic FROM st)", lines=True)
def topics_in_use(spark, folder):
    return TOPICS.table(spark).join(counts.topic_rows(submissions(spark, folder)), "topic", "left_semi").select("topic_id", "topic")


@query("topic_colors", ", v(topic, k) AS (VALUES ('STANDARD', '#4e79a7'), ('ECONOMY', '#f28e2b'), ('MEDIUM', '#e15759'), ('PROMO', '#76b7b2'), ('LARGE', '#59a14f'), ('SMALL', '#edc948')) SELECT DISTINCT st.topic, v.k AS color FROM st JOIN v USING (topic)", lines=True)
def topic_colors(spark, folder):
    return counts.topic_rows(submissions(spark, folder)).select("topic").distinct().withColumn("color", TOPICS.topic_color())


# ---------------------------------------------------------------- statistics


@query("keyword_top_overall", ", f AS (SELECT keyword, count(*) AS n, min(row_ord * 1000 + place) AS o FROM kk GROUP BY 1) SELECT keyword, n, CAST(row_number() OVER (ORDER BY n DESC, o) AS INTEGER) AS rank FROM f ORDER BY n DESC, o LIMIT 100", lines=True)
def keyword_top_overall(spark, folder):
    return counts.top(counts.keyword_counts(submissions(spark, folder, keywords=True), "keywords"), 100).select("keyword", "n", "rank")


@query(
    "keyword_top_by_year",
    ", f AS (SELECT year, keyword, count(*) AS n, min(row_ord * 1000 + kk.place) AS o FROM kk JOIN s USING (row_ord) GROUP BY 1, 2), r AS (SELECT year, keyword, n, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, o) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 10",
    lines=True,
)
def keyword_top_by_year(spark, folder):
    return counts.ranked(counts.keyword_counts(submissions(spark, folder, keywords=True), "keywords", "year"), "year", k=10).select("year", "keyword", "n", "rank")


@query(
    "keyword_cooccurrence_top",
    ", f AS (SELECT least(a.keyword, b.keyword) AS source, greatest(a.keyword, b.keyword) AS target, count(*) AS n FROM kk a JOIN kk b ON a.row_ord = b.row_ord AND a.place < b.place GROUP BY 1, 2) SELECT source, target, n, CAST(row_number() OVER (ORDER BY n DESC, source, target) AS INTEGER) AS rank FROM f ORDER BY n DESC, source, target LIMIT 200",
    lines=True,
)
def keyword_cooccurrence_top(spark, folder):
    return counts.top(counts.cooccurrence(submissions(spark, folder, keywords=True), "keywords"), 200, ties=("source", "target")).select("source", "target", "n", "rank")


@query("topic_area_by_year", "SELECT year, lower(topic_area) AS topic_area, count(*) AS n FROM s GROUP BY 1, 2", lines=True)
def topic_area_by_year(spark, folder):
    rows = submissions(spark, folder).select("year", F.lower("topic_area").alias("topic_area")).where("topic_area <> ''")
    return rows.groupBy("year", "topic_area").agg(F.count("*").alias("n"))


@query("primary_secondary_stats", "SELECT CASE WHEN place = 0 THEN 'primary' ELSE 'secondary' END AS kind, topic, count(*) AS n FROM st GROUP BY 1, 2", lines=True)
def primary_secondary(spark, folder):
    return counts.primary_and_secondary(submissions(spark, folder), TOPICS.active())


@query("primary_by_year", "SELECT year, topic, count(*) AS n FROM st WHERE place = 0 GROUP BY 1, 2", lines=True)
def primary_by_year(spark, folder):
    rows = submissions(spark, folder).select("year", F.get("topics", 0).alias("topic")).where("topic is not null")
    return rows.groupBy("year", "topic").agg(F.count("*").alias("n"))


@query("years_with_keywords", "SELECT DISTINCT year FROM s JOIN kk USING (row_ord)", lines=True)
def years_with_keywords(spark, folder):
    return submissions(spark, folder, keywords=True).where(F.size("keywords") > 0).select("year").distinct()


@query(
    "first_two_topics_export",
    ", t2 AS (SELECT row_ord, string_agg(topic, ' | ' ORDER BY place) AS names FROM tt WHERE place < 2 GROUP BY 1) SELECT row_ord, CAST(year AS VARCHAR) AS year, coalesce(names, '') AS assigned_topics, c_name AS authors FROM s LEFT JOIN t2 USING (row_ord) LEFT JOIN customer ON o_custkey = c_custkey",
    lines=True,
)
def first_two_topics_export(spark, folder):
    rows = submissions(spark, folder, authors=True)
    return rows.select("row_ord", F.col("year").cast("string").alias("year"), text.join_list(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 2)).alias("assigned_topics"), "authors")


@query(
    "csv_export",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""",
)
def csv_export(spark, folder):
    return _read(spark, folder, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


@query("topic_assignment", ", l AS (SELECT row_ord, string_agg(topic, '|' ORDER BY place) AS names FROM tt WHERE topic <> 'SMALL' GROUP BY 1), n AS (SELECT row_ord, coalesce(names, 'STANDARD') AS all_names FROM s LEFT JOIN l USING (row_ord)) SELECT row_ord, array_to_string(list_slice(string_split(all_names, '|'), 1, 5), '|') AS assigned FROM n", lines=True)
def topic_assignment(spark, folder):
    rows = submissions(spark, folder)
    own = F.coalesce("topics", F.array().cast("array<string>"))
    known = [t for t in TOPICS.active() if t != "SMALL"]
    return rows.select("row_ord", F.array_join(merge.assignment(F.get(own, 0), own, known, TOPICS.fallback), "|").alias("assigned"))


@query("catch_all_removed", ", l AS (SELECT row_ord, string_agg(topic, '|' ORDER BY place) AS names FROM tt WHERE topic <> 'PROMO' GROUP BY 1) SELECT row_ord, coalesce(names, 'STANDARD') AS assigned FROM s LEFT JOIN l USING (row_ord)", lines=True)
def catch_all_removed(spark, folder):
    none = F.array().cast("array<string>")
    own = merge.without_catch_all(F.coalesce("topics", none), F.lit(""), none, "PROMO", TOPICS.fallback)
    return submissions(spark, folder).select("row_ord", F.array_join(own, "|").alias("assigned"))


# ---------------------------------------------------------------- merges


@query("dedupe_last_wins", "SELECT user_id, event_id, event_type, place FROM (SELECT user_id, event_id, event_type, min(event_id) OVER w AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY user_id)) WHERE r = 1")
def dedupe_last_wins(spark, folder):
    rows = _read(spark, folder, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("ord"))
    return merge.last_wins(rows, ["user_id"], "ord").select("user_id", "event_id", "event_type", "place")


def _scrapes(spark, folder):
    rows = submissions(spark, folder, authors=True).select("row_ord", "id", "year", "topic_area", "authors", F.concat_ws("-", "year", F.col("row_ord") % 1000).alias("title_key"))
    third = F.col("row_ord") % 3
    new = rows.where(third != 0).withColumns({"topic_area": F.when(third == 1, F.lit("")).otherwise(F.col("topic_area")), "authors": F.when(third == 1, F.col("authors")).otherwise(F.lit(""))})
    return rows, new.where(F.col("year").isin(1997, 1999))


@query(
    "merge_replace_years",
    """, f AS (SELECT s.row_ord, s.year, topic_area, c_name AS authors FROM s LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT row_ord, year, topic_area, authors FROM f WHERE year NOT IN (1997, 1999) OR row_ord % 3 <> 0""",
    lines=True,
)
def merge_replace_years(spark, folder):
    existing, incoming = _scrapes(spark, folder)
    return merge.merge_years(existing, incoming, [1997, 1999], ["topic_area", "authors"]).select("row_ord", "year", "topic_area", "authors")


@query("label_cache_migration", "WITH c AS (SELECT conv_id, max(turn) AS last, count(*) - 1 AS reopened FROM conversations GROUP BY 1) SELECT conv_id || ':' || last AS row_key, toxic, reopened FROM labels JOIN c ON doc_id = conv_id")
def label_cache_migration(spark, folder):
    rows = _read(spark, folder, "conversations").select(F.col("conv_id").alias("id"), F.concat_ws(":", "conv_id", "turn").alias("row_key"), F.col("turn").alias("row_ord"))
    return merge.migrate_cache(_read(spark, folder, "labels").select(F.col("doc_id").alias("id"), "toxic"), rows)


@query("unlabelled_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_rows(spark, folder):
    rows = _read(spark, folder, "documents").select(F.col("doc_id").alias("row_key"), F.col("doc_id").alias("row_ord"))
    return merge.unlabelled(rows, _read(spark, folder, "labels").select(F.col("doc_id").alias("row_key"))).select(F.col("row_key").alias("doc_id"))


@query("labels_applied", "SELECT d.doc_id, toxic, quality FROM documents d LEFT JOIN labels USING (doc_id)")
def labels_applied(spark, folder):
    cache = _read(spark, folder, "labels").withColumnRenamed("doc_id", "row_key")
    return merge.with_labels(_read(spark, folder, "documents").select(F.col("doc_id").alias("row_key")), cache).select(F.col("row_key").alias("doc_id"), "toxic", "quality")


@query("coords_join_with_alias", "SELECT d.doc_id, e.embedding[1] AS x, e.embedding[2] AS y FROM documents d LEFT JOIN embeddings e ON e.vec_id = CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id ELSE d.doc_id - 1 END")
def coords_join(spark, folder):
    e = _read(spark, folder, "embeddings").select("vec_id", F.get("embedding", 0).alias("x"), F.get("embedding", 1).alias("y"))
    points = e.where("vec_id % 2 = 0").select(F.concat(F.lit("d:"), "vec_id").alias("row_key"), F.lit(2026).alias("year"), F.concat(F.lit("P"), "vec_id").alias("poster_number"), F.col("vec_id").alias("row_ord"), "x", "y")
    rows = _read(spark, folder, "documents").select("doc_id", F.concat(F.lit("d:"), "doc_id").alias("row_key"), F.concat(F.lit("P"), F.col("doc_id") - F.col("doc_id") % 2).alias("poster_number"))
    return merge.with_coordinates(rows, points, alias_year=2026).select("doc_id", "x", "y")


@query("keywords_restored", ", n AS (SELECT row_ord, coalesce(string_agg(keyword, '|' ORDER BY place), '') AS names FROM s LEFT JOIN kk USING (row_ord) GROUP BY 1) SELECT row_ord, CASE WHEN row_ord % 5 = 0 THEN 'late' WHEN row_ord % 2 = 0 THEN 'early' ELSE names END AS keywords FROM n", lines=True)
def keywords_restored(spark, folder):
    rows = submissions(spark, folder, keywords=True).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    early = rows.where("row_ord % 2 = 0").select("year", "id", F.array(F.lit("early")).alias("keywords"))
    late = rows.where("row_ord % 5 = 0").select("year", "id", F.array(F.lit("late")).alias("keywords"))
    return merge.restore_keywords(rows, [early, late], only_empty=False).select("row_ord", F.array_join("keywords", "|").alias("keywords"))


# ---------------------------------------------------------------- text


@query("search_substring", "SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'the and') OR contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'theand')")
def search_substring(spark, folder):
    rows = _read(spark, folder, "documents").select("doc_id", text.search_text_ascii(F.col("text")).alias("search_text"))
    return FacetQuery(search=" The AND ").filtered(rows).select("doc_id")


@query(
    "search_folded",
    r"""WITH f AS (SELECT doc_id, lower(strip_accents(text)) AS low FROM documents)
    SELECT doc_id FROM f WHERE contains(regexp_replace(low, '[^a-z0-9]+', ' ', 'g'), 'element')
        OR len(list_filter(regexp_extract_all(low, '[a-z0-9]+(?:[^a-z0-9\s]+[a-z0-9]+)+'), lambda x: contains(regexp_replace(x, '[^a-z0-9]+', '', 'g'), 'element'))) > 0""",
)
def search_folded(spark, folder):
    rows = _read(spark, folder, "documents").select("doc_id", text.search_index(F.col("text")).alias("search_text"))
    return FacetQuery(search="élement").filtered(rows).select("doc_id")


@query(
    "request_plan",
    r"""WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, CAST(CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 2 AS INTEGER) AS lane FROM pages WHERE url <> '')
    SELECT url, host, lane, row_number() OVER (PARTITION BY host, lane ORDER BY url) - 1 AS turn, CAST((row_number() OVER (PARTITION BY host, lane ORDER BY url) - 1) * 0.5 AS DOUBLE) AS due FROM u""",
)
def request_plan(spark, folder):
    return crawl.planned(_read(spark, folder, "pages"))


@query(
    "search_many",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS search_text FROM documents),
    n AS (SELECT DISTINCT item_id, trim(regexp_replace(lower(strip_accents(left(text, 24))), '[^a-z0-9]+', ' ', 'g')) AS needle FROM benchmark)
    SELECT item_id, doc_id FROM d JOIN n ON contains(search_text, needle) OR contains(search_text, replace(needle, ' ', '')) WHERE needle <> ''""",
)
def search_many(spark, folder):
    rows = _read(spark, folder, "documents").select("doc_id", text.search_text_ascii(F.col("text")).alias("search_text"))
    searches = _read(spark, folder, "benchmark").select("item_id", F.substring("text", 1, 24).alias("search"))
    return searched(rows, searches)


@query(
    "phrase_hits",
    r"""WITH b AS (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
    v AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM b),
    d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM d)
    SELECT phrase, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM g JOIN v USING (phrase) GROUP BY phrase""",
)
def phrase_hits(spark, folder):
    folded = lambda name, key: _read(spark, folder, name).select(key, text.search_text_ascii(F.col("text")).alias("search_text"))
    found = hits_of_phrases(folded("documents", "doc_id"), phrases_of(folded("benchmark", "item_id")))
    return found.groupBy("phrase").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))


@query(
    "keyword_tops",
    ", f AS (SELECT year, keyword, count(*) AS n, min(row_ord * 1000 + kk.place) AS o FROM kk JOIN s USING (row_ord) GROUP BY 1, 2 UNION ALL SELECT NULL, keyword, count(*), min(row_ord * 1000 + kk.place) FROM kk GROUP BY 2), r AS (SELECT year, keyword, n, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, o) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= CASE WHEN year IS NULL THEN 100 ELSE 50 END",
    lines=True,
)
def keyword_tops(spark, folder):
    return counts.keyword_tops(submissions(spark, folder, keywords=True), "keywords", 100, 50)


@query("label_filter", "SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang")
def label_filter(spark, folder):
    toxic = _read(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return _read(spark, folder, "documents").select("doc_id", "lang").join(toxic, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("title_normalise", r"SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '\s+', ' ', 'g')) AS title_key FROM documents")
def title_normalise(spark, folder):
    return texts(spark, folder).select("doc_id", text.title_key(F.col("title")).alias("title_key"))


def _without_citations(column: str) -> str:
    """Word boundaries of the engine are Unicode's, those of DuckDB ASCII's: there a boundary is a character that stays."""
    for pattern in text.CITATIONS:
        bounded = pattern.startswith(r"\b")
        own = r"(^|[^\p{L}\p{N}_])" + pattern[2:] if bounded else pattern
        column = f"regexp_replace({column}, '(?i){own}', '{r'\1 ' if bounded else ' '}', 'g')"
    return column


@query("citation_strip", rf"SELECT doc_id, regexp_replace(regexp_replace({_without_citations('text')}, '\s+', ' ', 'g'), '^[ ,.;]+|[ ,.;]+$', '', 'g') AS plain FROM documents")
def citation_strip(spark, folder):
    return _read(spark, folder, "documents").select("doc_id", text.strip_citations(F.col("text")).alias("plain"))


@query("row_keys", "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ':' || CASE WHEN role <> '' AND role <> 'user' THEN role ELSE CAST(turn AS VARCHAR) END AS row_key FROM conversations")
def row_keys(spark, folder):
    role = F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role"))
    return _read(spark, folder, "conversations").select("conv_id", "turn", text.row_key(F.col("conv_id"), role, F.lit(""), F.col("turn").cast("string")).alias("row_key"))


@query("html_escaped", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages""")
def html_escaped(spark, folder):
    return _read(spark, folder, "pages").select("page_id", text.escape_html(F.col("html")).alias("safe"))


@query("embedding_texts", "SELECT doc_id, repeat(title || '. ', 2) || title || '. ' || title || '. ' || title || '. ' || lang AS body FROM (SELECT doc_id, lang, CASE WHEN string_split(text, chr(10))[1] = '' THEN NULL ELSE string_split(text, chr(10))[1] END AS title FROM documents) WHERE title IS NOT NULL")
def embedding_texts(spark, folder):
    rows = texts(spark, folder).where("title <> ''")
    return rows.select("doc_id", text.embedding_text(F.col("title"), F.col("title"), F.array("lang")).alias("body"))


@query(
    "mojibake_repaired",
    "SELECT doc_id, trim(regexp_replace(replace(regexp_replace(translate(text, '‘’‚‛“”„‟′″' || chr(160), '''''''''\"\"\"\"''\" '),"
    r" '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{00ad}\x{200e}\x{200f}]', '', 'g'), 'Â', ''), '\s+', ' ', 'g')) AS plain FROM documents",
)
def mojibake_repaired(spark, folder):
    return _read(spark, folder, "documents").select("doc_id", text.normalize_field(F.col("text")).alias("plain"))


@query(
    "author_normalise",
    r"""WITH f AS (SELECT c_custkey, c_name, lower(c_name) || ' 1 ( a@b.edu ), Jane o''neil 2 ; 1 University of ' || n_name AS field FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT *, list_transform(string_split(regexp_replace(split_part(field, ';', 1), '\([^)]*@[^)]*\)', ' ', 'g'), ','), lambda x: trim(regexp_replace(x, '[\s0-9#]+$', ''))) AS parts FROM f),
    n AS (SELECT *, list_transform(parts, lambda x: list_aggregate(list_transform(string_split(x, ' '), lambda w: list_aggregate(list_transform(string_split(w, ''''), lambda y: upper(y[1]) || lower(y[2:])), 'string_agg', '''')), 'string_agg', ' ')) AS names FROM p),
    c AS (SELECT *, len(regexp_extract_all(field, '\b[A-Z][A-Za-z''.-]*(?:\s+[A-Z][A-Za-z''.-]*){1,3}\b')) AS pairs FROM n)
    SELECT c_custkey, list_aggregate(names, 'string_agg', ', ') AS authors, names[1] AS first,
           4 + 2 + 3 + 1 + CASE WHEN pairs >= 2 THEN 5 WHEN pairs = 1 THEN 1 ELSE 0 END + CAST(least(length(field) // 40, 6) AS INTEGER) AS score, TRUE AS thin FROM c""",
)
def author_normalise(spark, folder):
    rows = spread(_read(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")).join(_read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    field = F.concat(F.lower("c_name"), F.lit(" 1 ( a@b.edu ), Jane o'neil 2 ; 1 University of "), F.col("n_name"))
    return rows.select("c_custkey", authors.normalize_authors(field).alias("authors"), authors.first_author(field).alias("first"), authors.block_score(field).alias("score"), authors.authors_are_thin(F.col("c_name")).alias("thin"))


@query("keyword_sanitise", "SELECT p_partkey, lower(p_name) || '|' || lower(p_brand) || '|' || lower(p_type) AS keywords FROM part")
def keyword_sanitise(spark, folder):
    rows = spread(_read(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"))
    return rows.select("p_partkey", F.array_join(keywords.sanitize_keywords(F.array("p_name", "p_brand", F.lower("p_type"), F.lit("the poster"))), "|").alias("keywords"))


@query("keyword_parse", "SELECT p_partkey, lower(p_name) || '|' || lower(p_brand) || '|' || lower(p_type) AS keywords FROM part")
def keyword_parse(spark, folder):
    rows = spread(_read(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"))
    return rows.select("p_partkey", F.array_join(keywords.parse_keywords(F.concat_ws("; ", "p_name", "p_brand", "p_type")), "|").alias("keywords"))


@query("fuzzy_title_match")
def fuzzy_title_match(spark, folder):
    first = lambda c: text.title_key(F.split_part(c, F.lit("."), F.lit(1)))
    left = _read(spark, folder, "benchmark").select(F.col("item_id").alias("left_id"), first("text").alias("title_key"))
    right = _read(spark, folder, "documents").select(F.col("doc_id").alias("right_id"), first("text").alias("right_key")).where("right_key <> ''")
    return fuzzy.best_titles(left, right)


@query(
    "offline_labels",
    r"""WITH t AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, length(string_split(text, chr(10))[1]) + 2) ELSE '' END AS abstract FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    w AS (SELECT doc_id, regexp_split_to_array(lower(title || ' ' || title || ' ' || abstract || ' ' || lang), '\s+') AS words FROM t),
    v(place, topic) AS (VALUES (0, 'reading thing'), (1, 'ration tion'), (2, 'elle quelle'), (3, 'keit heit')),
    s AS (SELECT doc_id, place, topic, len(list_filter(words, lambda x: list_contains(string_split(topic, ' '), x))) AS score FROM w, v)
    SELECT CAST(doc_id AS VARCHAR) AS row_key, coalesce(string_agg(topic, '|' ORDER BY score DESC, place) FILTER (score > 0), 'reading thing') AS assigned, FALSE AS failed FROM s GROUP BY doc_id""",
)
def offline_labels(spark, folder):
    rows = texts(spark, folder).select(F.col("doc_id").cast("string").alias("row_key"), F.col("doc_id").alias("row_ord"), "title", "abstract", F.array("lang").alias("keywords"))
    cache = _read(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("row_key"))
    topics = ["reading thing", "ration tion", "elle quelle", "keit heit"]
    return classify(rows, cache, LexicalClassifier(topics), topics, topics[0]).select("row_key", F.array_join("assigned_topics", "|").alias("assigned"), "failed")


# ---------------------------------------------------------------- pages


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, folder):
    return _read(spark, folder, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query("page_cache_names", "SELECT page_id, left(sha256(url), 20) || '.html' AS name FROM pages")
def page_cache_names(spark, folder):
    from millrace.sources.archive import cache_name

    return _read(spark, folder, "pages").select("page_id", cache_name(F.col("url"), ".html").alias("name"))


@query("page_main_text")
def page_main_text(spark, folder):
    return html.extracted(_read(spark, folder, "pages"), lambda page, url: [html.detail(page)], "title string, abstract string, authors string, keywords string, topic_area string")


@query(
    "page_anchors",
    r"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS site, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
    u AS (SELECT page_id, site, unnest(h) AS href, unnest(t) AS title, generate_subscripts(h, 1) AS i FROM a)
    SELECT page_id, regexp_extract(href, '/([\p{L}\p{N}_]+)$', 1) AS id, arg_max(title, i) AS title, arg_max(site || href, i) AS url
    FROM u WHERE regexp_matches(href, '/[\p{L}\p{N}_]+$') AND title <> '' GROUP BY 1, 2""",
)
def page_anchors(spark, folder):
    return html.extracted(_read(spark, folder, "pages"), lambda page, url: html.anchors(page, url, r"/(\w+)$", least=1), "id string, title string, url string")


# ---------------------------------------------------------------- vectors and points

_TERMS = r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2 AND x NOT IN (STOP)) AS words FROM documents),
    t AS (SELECT doc_id, unnest(words) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
    v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY 1),
    k AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 8000),
    r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN k USING (term)),
    z AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY 1)
""".replace("STOP", ", ".join(f"'{w}'" for w in vectors.STOP_WORDS))


@query("tfidf_terms", _TERMS + "SELECT term, count(*) AS docs, round(sum(raw / norm), 4) AS weight FROM r JOIN z USING (doc_id) GROUP BY term")
def tfidf_terms(spark, folder):
    weights = vectors.tfidf(_read(spark, folder, "documents"))
    return weights.groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "text_neighbours",
    _TERMS + """,
    u AS (SELECT doc_id, term, raw / norm AS weight FROM r JOIN z USING (doc_id)),
    p AS (SELECT a.doc_id, b.doc_id AS other, round(sum(a.weight * b.weight), 9) AS similarity FROM u a JOIN u b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, other) AS rank FROM p WHERE similarity > 0)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, other, round(similarity, 6) AS similarity FROM o WHERE rank <= 15""",
)
def text_neighbours(spark, folder):
    near = cosine.nearest_texts(vectors.tfidf_rows(_read(spark, folder, "documents")), once=True)
    return near.select("doc_id", "rank", "other", F.round("similarity", 6).alias("similarity"))


@query("embedding_layout")
def embedding_layout(spark, folder):
    return umap.spread(umap.embed(vectors.tfidf_rows(_read(spark, folder, "documents")), once=True))


def _points(spark, folder):
    return _read(spark, folder, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))


@query("nearest_point", "SELECT vec_id, round(sqrt(x * x + y * y), 6) AS distance FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) WHERE sqrt(x * x + y * y) <= 0.5 ORDER BY sqrt(x * x + y * y), vec_id LIMIT 1")
def nearest_point(spark, folder):
    return vectors.nearest(_points(spark, folder), 0.0, 0.0, 0.5, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "nearest_points",
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS tx, embedding[4]::DOUBLE AS ty FROM embeddings),
    d AS (SELECT t.vec_id AS tap_id, p.vec_id, sqrt((p.x - t.tx) * (p.x - t.tx) + (p.y - t.ty) * (p.y - t.ty)) AS distance FROM p, p t),
    r AS (SELECT *, row_number() OVER (PARTITION BY tap_id ORDER BY distance, vec_id) AS rank FROM d)
    SELECT tap_id, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
)
def nearest_points(spark, folder):
    taps = _read(spark, folder, "embeddings").select(F.col("vec_id").alias("tap_id"), F.get("embedding", 2).cast("double").alias("x"), F.get("embedding", 3).cast("double").alias("y"))
    return nearest_of_taps(taps, _points(spark, folder), 5).withColumn("distance", F.round("distance", 6))


@query("embedding_extent", "SELECT axis, round(lo - 0.06 * (hi - lo), 6) AS low, round(hi + 0.06 * (hi - lo), 6) AS high FROM (SELECT 'x' AS axis, min(embedding[1]::DOUBLE) AS lo, max(embedding[1]::DOUBLE) AS hi FROM embeddings UNION ALL SELECT 'y', min(embedding[2]::DOUBLE), max(embedding[2]::DOUBLE) FROM embeddings)")
def embedding_extent(spark, folder):
    ends = counts.extent(_points(spark, folder), "x", "y")
    return ends.select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from millrace import extraction_queries  # noqa: E402, F401 - registers its queries
