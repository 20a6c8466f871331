"""Search queries: F3 keyword search, F4 full text (documents, customers), T3 tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.functions.text import LEAF_END, tokens
from innkeep.operators import search
from innkeep.plans.catalog import register
from innkeep.plans.q_stays import page_sql
from innkeep.sources.fixtures import load_model, table

KEYWORD_QUERY = "_customer#00000012"
DOC_QUERY = 'the "of the" -die or und'
CUSTOMER_QUERY = 'machinery ort5 -herrn or "frau dr"'

_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def tok_sql(x: str) -> str:
    return _TOK.format(x=x)


@register("f3_keyword_search", page_sql(
    where="WHERE cu.keyword ILIKE '" + search.keyword_pattern(KEYWORD_QUERY) + "'"))
def f3_keyword_search(spark, sf_dir):
    """F3 + O1: keyword search (start anchored by a leading underscore), first page."""
    m = load_model(spark, sf_dir)
    return search.search_page(m.customers, m.bookings, search.keyword_filter(KEYWORD_QUERY), 0)


@register("t3_document_tokens", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct
FROM (SELECT doc_id, {tok_sql('text')} AS t FROM documents)
""")
def t3_document_tokens(spark, sf_dir):
    """Search tokens of every whole document (lower-cased letter/digit runs)."""
    d = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"),
                    F.size(F.array_distinct("t")).alias("n_distinct"))


@register("f4_fulltext_documents", f"""
SELECT doc_id, lang, CAST(len(t) AS INTEGER) AS n_tokens
FROM (SELECT doc_id, lang, {tok_sql('text')} AS t FROM documents)
WHERE (list_contains(t, 'the') AND instr(' ' || array_to_string(t, ' ') || ' ', ' of the ') > 0
       AND NOT list_contains(t, 'die'))
   OR list_contains(t, 'und')
""")
def f4_fulltext_documents(spark, sf_dir):
    """web-search query over the whole texts of ``documents``."""
    return search.search_documents(table(spark, sf_dir, "documents"), DOC_QUERY)


@register("f4_fulltext_customers", f"""
, ct AS (
  SELECT id, {tok_sql("concat_ws(' ', title, letter, given, family, company, '', street, postal_code, "
                       "city, country, country_code, phone, '', '', '', '', mail, '', '', keyword, '')")}
         AS t
  FROM (SELECT cu.*, coalesce(l.letter, '') AS letter FROM cu LEFT JOIN (VALUES
    ('Herrn', 'Sehr geehrter Herr'), ('Herrn und Frau', 'Sehr geehrte Frau, sehr geehrter Herr'),
    ('Frau', 'Sehr geehrte Frau'), ('Herrn Dr.', 'Sehr geehrter Herr Dr.'),
    ('Frau Dr.', 'Sehr geehrte Frau Dr.'), ('Familie', 'Liebe Familie')) l(title, letter)
    ON l.title = cu.title)
)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens FROM ct
WHERE (list_contains(t, 'machinery') AND list_contains(t, 'ort5') AND NOT list_contains(t, 'herrn'))
   OR instr(' ' || array_to_string(t, ' ') || ' ', ' frau dr ') > 0
""")
def f4_fulltext_customers(spark, sf_dir):
    """F4 + T3: web-search query over the customers' search tokens."""
    m = load_model(spark, sf_dir)
    hits = search.search_text(m.customers.select("id", "tokens"), CUSTOMER_QUERY)
    return hits.select("id", F.size(F.array_remove("tokens", LEAF_END)).alias("n_tokens"))


@register("t2_keywords", """
SELECT id, keyword FROM cu
""")
def t2_keywords(spark, sf_dir):
    """The generated keyword column of every customer (from the document)."""
    from innkeep.operators.stays import with_keyword
    m = load_model(spark, sf_dir)
    return with_keyword(m.customers.select("id", "data")).select("id", "keyword")


@register("t3_customer_tokens", f"""
, lt AS (SELECT * FROM (VALUES ('Herrn', 'Sehr geehrter Herr'),
    ('Herrn und Frau', 'Sehr geehrte Frau, sehr geehrter Herr'), ('Frau', 'Sehr geehrte Frau'),
    ('Herrn Dr.', 'Sehr geehrter Herr Dr.'), ('Frau Dr.', 'Sehr geehrte Frau Dr.'),
    ('Familie', 'Liebe Familie')) v(title, letter))
SELECT cu.id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT cu.id, {tok_sql("concat_ws(' ', cu.title, coalesce(lt.letter, ''), given, family, company, '', street, "
                     "postal_code, city, country, country_code, phone, '', '', '', '', mail, '', '', keyword, '')")}
        AS t
      FROM cu LEFT JOIN lt ON lt.title = cu.title) cu
""")
def t3_customer_tokens(spark, sf_dir):
    """The generated search tokens of every customer (all string leaves)."""
    m = load_model(spark, sf_dir)
    words = F.array_remove("tokens", LEAF_END)
    return m.customers.select("id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("tokens"))


@register("f4_phrase_within_leaf", """
SELECT id FROM cu WHERE regexp_matches(lower(street), '(^|[^a-z0-9])weg 7([^a-z0-9]|$)')
""")
def f4_phrase_within_leaf(spark, sf_dir):
    """a phrase matches within one field; the same words at the end of one field
    and the start of the next (family name, company) do not."""
    m = load_model(spark, sf_dir)
    inside = search.search_text(m.customers.select("id", "tokens"), '"weg 7"')
    across = search.search_text(m.customers.select("id", "tokens"), '"name7 machinery"')
    return inside.select("id").unionByName(across.select("id"))
