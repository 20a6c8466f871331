"""Customer search: keyword pattern, web-search style full text, paging.

The two *query strings* are parsed on the driver into Columns (they are user
input of a few words, not data); the data side stays a pushed-down filter.

Paging: newest-modified first with an ``id`` tie-break, 250 rows a page.  The
page is selected before anything is joined to it, so the last-stay embed only
aggregates the bookings of at most 250 customers (a broadcast semi-join with a
proven bound of one page).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.functions.text import tokens as tokens_of

PAGE_SIZE = 250
_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)   # letters and digits (driver side)


def keyword_pattern(query: str) -> str | None:
    """Case-insensitive LIKE pattern of a keyword query, or None for no filter.

    Leading ``_`` anchors the start, trailing ``_`` anchors the end; all edge
    underscores are removed; otherwise the text matches anywhere.  Inner ``%``
    and ``_`` remain wildcards.
    """
    s = query.strip()
    left, right = s.startswith("_"), s.endswith("_")
    core = s.strip("_")
    if core == "":
        return None
    return ("" if left else "%") + core + ("" if right else "%")


def keyword_filter(query: str, column: str = "keyword") -> Column | None:
    """ILIKE Column of a keyword query on ``column`` (None: no filter)."""
    p = keyword_pattern(query)
    return None if p is None else F.col(column).ilike(p)


@dataclass
class Term:
    words: list[str]      # one word, or a phrase of consecutive words
    negated: bool = False


def parse_websearch(query: str) -> list[list[Term]]:
    """Web-search syntax -> OR of AND-groups of (possibly negated) terms.

    ``a b`` -> a AND b; ``"a b"`` -> phrase; ``-a`` -> NOT a; ``a or b`` -> a OR b.
    Words are lower-cased and split into letter/digit tokens like the text.
    """
    groups: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', query):
        neg, phrase, word = m.group(1), m.group(2), m.group(3)
        if word is not None:
            if word.lower() == "or":
                if groups[-1]:
                    groups.append([])
                continue
            neg = "-" if word.startswith("-") else ""
            word = word.lstrip("-")
            toks = _TOKEN.findall(word.lower())
        else:
            toks = _TOKEN.findall(phrase.lower())
        if toks:
            groups[-1].append(Term(toks, negated=neg == "-"))
    return [g for g in groups if g]


def _term_column(term: Term, toks: Column, joined: Column) -> Column:
    if len(term.words) == 1:
        hit = F.array_contains(toks, term.words[0])
    else:
        hit = F.instr(joined, " " + " ".join(term.words) + " ") > 0
    return ~hit if term.negated else hit


def websearch(query: str, tokens: Column) -> Column | None:
    """Boolean Column for a web-search query over a token array (None: no filter)."""
    groups = parse_websearch(query)
    if not groups:
        return None
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    out = None
    for g in groups:
        conj = None
        for t in g:
            c = _term_column(t, tokens, joined)
            conj = c if conj is None else conj & c
        out = conj if out is None else out | conj
    return out


def search_text(df: DataFrame, query: str, tokens_col: str = "tokens") -> DataFrame:
    """Rows whose token array matches a web-search query."""
    cond = websearch(query, F.col(tokens_col))
    return df if cond is None else df.where(cond)


def search_documents(documents: DataFrame, query: str) -> DataFrame:
    """Full-text search over a text column, tokenising the whole texts on the fly.

    The token array is bound once per row (a single-element array fed to
    ``transform`` acts as a let-binding) and the hit test and token count come
    out of one generator (``inline`` of the filtered array), so each text is
    tokenised exactly once: a plain filter would be pushed below the projection
    and re-run the regex per term.
    """
    d = documents.select("doc_id", "lang", F.array(tokens_of("text")).alias("_t1"))

    def facts(t):
        cond = websearch(query, t)
        return F.struct((F.lit(True) if cond is None else cond).alias("hit"),
                        F.size(t).alias("n_tokens"))

    hits = F.filter(F.transform("_t1", facts), lambda s: s["hit"])
    return d.select("doc_id", "lang", F.inline(hits)).select("doc_id", "lang", "n_tokens")


def page(df: DataFrame, n: int = 0, size: int = PAGE_SIZE, extra: int = 0) -> DataFrame:
    """Page ``n``: newest modified first, id tie-break; offset ``n * size``.

    (The original offset ``n * size + 1`` skips one row per page boundary.)
    """
    ordered = df.orderBy(F.col("modified").desc(), F.col("id"))
    if n > 0:
        ordered = ordered.offset(n * size)
    return ordered.limit(size + extra)


def with_position(page_df: DataFrame, n: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Global position = index in the page + n * size (page-bounded window)."""
    w = Window.orderBy(F.col("modified").desc(), F.col("id"))
    return page_df.withColumn("position", F.row_number().over(w) - 1 + n * size)


def more_pages(df: DataFrame, n: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One row: rows on the page and whether another page exists (a full page came
    back; fetched as size + 1 rows)."""
    got = page(df, n, size, extra=1).agg(F.count(F.lit(1)).alias("fetched"))
    return got.select(F.lit(n).alias("page"), F.least("fetched", F.lit(size)).alias("rows"),
                      (F.col("fetched") > size).alias("has_more"))


def search_page(customers: DataFrame, bookings: DataFrame, cond: Column | None,
                n: int = 0) -> DataFrame:
    """Customer rows of one result page with their last stay."""
    from innkeep.operators.ordering import stable
    c = customers if cond is None else customers.where(cond)
    pg = page(c.select("id", "modified", "keyword", "data"), n)
    # the page (at most 250 rows) is materialised once: it is both the output and
    # the key set of the bookings lookup, and would otherwise be scanned and
    # top-k-sorted twice
    pg = stable(with_position(pg, n))
    ids = pg.select(F.col("id").alias("customer"))
    mine = bookings.select("customer", "arrival", "departure", "id") \
        .join(F.broadcast(ids), "customer", "left_semi")
    last = (mine.groupBy("customer")
            .agg(F.max(F.struct("arrival", "departure", "id")).alias("last"))
            .select(F.col("customer").alias("id"), F.col("last.arrival").alias("from_date"),
                    F.col("last.departure").alias("till_date")))
    return (pg.join(last, "id", "left")
            .select("position", "id", "keyword", F.col("data.name.given").alias("given"),
                    F.col("data.name.family").alias("family"),
                    F.col("data.company.name").alias("company"), "from_date", "till_date"))


def append_pages(lower: DataFrame, upper: DataFrame, key: str = "position") -> DataFrame:
    """Union of two pages; it is an error (raised on action) if the ranges of their
    keys overlap, whether or not a key occurs twice."""
    both = lower.withColumn("_upper", F.lit(False)).unionByName(upper.withColumn("_upper", F.lit(True)))
    whole = Window.partitionBy()                       # two pages: a bounded window
    last = F.max(F.when(~F.col("_upper"), F.col(key))).over(whole)
    first = F.min(F.when(F.col("_upper"), F.col(key))).over(whole)
    fits = F.when(last >= first, F.raise_error(F.lit("Overlapping key ranges")).cast("boolean")).otherwise(True)
    return both.withColumn("_fits", fits).where("_fits").drop("_upper", "_fits")


def page_after(df: DataFrame, modified=None, id=None, size: int = PAGE_SIZE) -> DataFrame:  # noqa: A002
    """Keyset paging: the ``size`` rows after the row (modified, id), newest first.

    A deep page costs as much as the first one: a pushed filter and a top-k of
    ``size`` rows, where an offset merges all rows before it in one task.
    Rows never modified come last, by id; without an id the first page is returned.
    """
    if id is not None and modified is None:
        df = df.where(F.col("modified").isNull() & (F.col("id") > id))
    elif id is not None:
        last = F.lit(modified).cast(df.schema["modified"].dataType)
        df = df.where((F.col("modified") < last) | ((F.col("modified") == last) & (F.col("id") > id))
                      | F.col("modified").isNull())
    return df.orderBy(F.col("modified").desc_nulls_last(), F.col("id")).limit(size)
