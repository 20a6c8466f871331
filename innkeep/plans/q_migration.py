"""Migration queries: S3/S4 legacy CSV, T7-T18, U1, W1, A6 + J4, A10."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.operators import migration as MG
from innkeep.plans.catalog import register
from innkeep.sources import legacy as LG
from innkeep.sources.fixtures import load_model, model_location
from innkeep.sources.shared import publish_once

# DuckDB: the legacy wide rows written from the model (same rules as legacy_rows).
_SLOT = """
  CASE WHEN {kt} THEN '4' WHEN a.art{i} IS NULL THEN '' ELSE CAST((bk.id + {i}) % 2 + 1 AS VARCHAR) END AS ANZAHL{i},
  CASE WHEN {kt} THEN 'Kurtaxe' ELSE coalesce(a.art{i}, '') END AS ART{i},
  CASE WHEN {kt} THEN '2.00' WHEN a.art{i} IS NULL THEN '0.00'
       ELSE printf('%d.%02d', a.p{i} // 100, a.p{i} % 100) END AS PREIS{i},
  CASE WHEN {kt} OR a.art{i} IS NULL THEN '' ELSE CAST(a.b{i} * 100 AS VARCHAR) END AS PROZ{i},"""

LEGACY_SQL = """
, alr AS (SELECT *, row_number() OVER (PARTITION BY booking ORDER BY ln, pk, sk, q) AS slot FROM al)
, alp AS (
  SELECT booking, max(CASE WHEN slot = 1 THEN room END) AS room1,
""" + ",\n".join(
    f"  max(CASE WHEN slot = {i} THEN description END) AS art{i}, "
    f"max(CASE WHEN slot = {i} THEN price_per_bed END) AS p{i}, "
    f"max(CASE WHEN slot = {i} THEN beds END) AS b{i}" for i in range(1, 5)) + """
  FROM alr GROUP BY booking)
, gsp AS (
  SELECT booking,
""" + ",\n".join(
    f"  max(CASE WHEN i = {i} THEN born END) AS born{i}, max(CASE WHEN i = {i} THEN given END) AS "
    f"given{i}, max(CASE WHEN i = {i} THEN family END) AS family{i}" for i in range(1, 7)) + """
  FROM gs GROUP BY booking)
, lt AS (SELECT * FROM (VALUES ('Herrn', 'Sehr geehrter Herr'),
    ('Herrn und Frau', 'Sehr geehrte Frau, sehr geehrter Herr'), ('Frau', 'Sehr geehrte Frau'),
    ('Herrn Dr.', 'Sehr geehrter Herr Dr.'), ('Frau Dr.', 'Sehr geehrte Frau Dr.'),
    ('Familie', 'Liebe Familie')) v(title, letter))
, lg AS (
  SELECT CAST(bk.id AS VARCHAR) AS RECORDID,
  CASE WHEN bk.id % 17 = 0 THEN '' ELSE CAST(bk.customer AS VARCHAR) END AS GROUPID,
  cu.title AS ANREDE, coalesce(lt.letter, '') AS ANREDEBR, cu.given AS VORNAME, cu.family AS NAME,
  cu.company AS FIRMA, '' AS ABTEILUNG, cu.keyword AS SUCH,
  'Weg ' || CAST(cu.id % 50 AS VARCHAR) AS STRASSE, CAST(cu.id % 9 + 1 AS VARCHAR) AS HNR,
  cu.postal_code AS PLZZ, CASE WHEN bk.id % 13 = 0 THEN '78401' ELSE '' END AS PLZP,
  CASE WHEN bk.id % 26 = 0 THEN '12 34' ELSE '' END AS POSTFACH,
  cu.city AS ORT, cu.country_code AS LAND, cu.country AS LAND___ausgeschrieben,
  cu.phone AS TELEFON, '' AS TELEFON2, CASE WHEN bk.id % 6 = 0 THEN '0171/' ELSE '' END AS MOBILTEL,
  CASE WHEN bk.id % 4 = 0 THEN ' 07531/ ' ELSE '' END AS TELEFAX, '' AS TELEFAX2, cu.mail AS EMAIL,
  '' AS EMAIL2, '' AS INTERNET,
  CASE WHEN bk.id % 2 = 0 THEN 'K' || CAST(bk.customer AS VARCHAR) ELSE '' END AS KUNDENNUMMER,
  CASE WHEN bk.id % 3 = 0 THEN 'Stamm' ELSE '' END AS KATEGORIE,
  CASE WHEN bk.id % 23 = 0 OR bk.id % 19 = 0 THEN '' ELSE strftime(bk.arrival, '%Y-%m-%d') END AS ANREISE,
  CASE WHEN bk.id % 23 = 0 OR bk.id % 31 = 0 THEN '' ELSE strftime(bk.departure, '%Y-%m-%d') END AS ABREISE,
  CASE WHEN bk.id % 23 = 0 OR bk.id % 19 = 0 OR bk.id % 8 = 0 THEN ''
       ELSE strftime(bk.arrival, '%Y-%m-%d') END AS AVON,
  CASE WHEN bk.id % 23 = 0 OR bk.id % 31 = 0 THEN '' ELSE strftime(bk.departure, '%Y-%m-%d') END AS ABIS,
  CASE WHEN bk.deposit_asked IS NULL THEN '0.00'
       ELSE printf('%d.%02d', bk.deposit_asked // 100, bk.deposit_asked % 100) END AS AGEF,
  CASE WHEN bk.id % 29 = 0 THEN '-5.00' WHEN bk.deposit_got IS NULL THEN '0.00'
       ELSE printf('%d.%02d', bk.deposit_got // 100, bk.deposit_got % 100) END AS AEING,
  coalesce(a.room1, '') AS ZIMMER,
  CASE WHEN bk.id % 10 = 0 THEN 'Notiz ' || CAST(bk.id AS VARCHAR) || chr(10) || 'zweite "Zeile"'
       ELSE '' END AS BEMAUFE,""" + "".join(
    _SLOT.format(i=i, kt=("bk.id % 5 = 4" if i == 4 else "false")) for i in range(1, 5)) + """
""" + ",\n".join(f"  coalesce(strftime(g.born{i}, '%Y-%m-%d'), '') AS GEB_DAT0{i}" for i in range(1, 7)) + """,
  coalesce(g.given2, '') AS P_VORNAME, coalesce(g.family2, '') AS P_NAME,
""" + ",\n".join(f"  coalesce(g.given{i}, '') AS P_VORNAME{i}, coalesce(g.family{i}, '') AS P_NAME{i}"
                 for i in range(3, 7)) + """
  FROM bk JOIN cu ON cu.id = bk.customer LEFT JOIN lt ON lt.title = cu.title
  LEFT JOIN alp a ON a.booking = bk.id LEFT JOIN gsp g ON g.booking = bk.id
)
, lgt AS (
  SELECT *, CAST(RECORDID AS BIGINT) AS recordid_n,
         coalesce(TRY_CAST(nullif(GROUPID, '') AS BIGINT), CAST(RECORDID AS BIGINT)) AS groupid_n,
         coalesce(TRY_CAST(nullif(AVON, '') AS DATE), TRY_CAST(nullif(ANREISE, '') AS DATE)) AS f,
         coalesce(TRY_CAST(nullif(ABIS, '') AS DATE), TRY_CAST(nullif(ABREISE, '') AS DATE)) AS t
  FROM lg
)
"""

WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"


def cents_sql(x: str) -> str:
    return (f"CASE WHEN trim({x}) = '' THEN NULL ELSE CAST(floor(TRY_CAST(trim({x}) AS DOUBLE) * 100 "
            f"+ 0.5) AS BIGINT) END")


def legacy_export(spark, sf_dir):
    """The legacy export of the model as a CSV file in the shared folder (written
    once: header, Latin-1, CRLF, quoted multi-line cells), read with the legacy
    reader."""
    m = load_model(spark, sf_dir)
    loc = model_location(spark, sf_dir)
    path = publish_once(spark, f"{loc}/legacy-export-v{LG.EXPORT_VERSION}",
                        lambda p: LG.write_legacy_csv(LG.legacy_rows(m.bookings, m.customers), f"{p}/rows.csv.gz"))
    return LG.read_legacy_csv(spark, f"{path}/rows.csv.gz")


def legacy_source(spark, sf_dir):
    """The staging table of the import: the export loaded once from the CSV into
    an untouched parquet copy (S4), on which every migration step runs, as the
    SQL importer loads the file into a table first."""
    loc = model_location(spark, sf_dir)
    path = publish_once(spark, f"{loc}/legacy-raw-v{LG.EXPORT_VERSION}",
                        lambda p: LG.write_raw(legacy_export(spark, sf_dir), p))
    return spark.read.schema(LG.LEGACY_SCHEMA).parquet(path)   # all text, schema known


def foreign_export(spark, sf_dir):
    """The rows of the export as another system writes them: columns in another
    order, one with another name, unknown columns between them, ``;`` and decimal
    commas, days before months; and rows that cannot be used: every 41st record id is blank, every 43rd
    is no number, every 47th row comes twice, every 53rd has an absurd count."""
    rows = legacy_source(spark, sf_dir)
    k = F.col("RECORDID").cast("bigint")
    for c in ("AGEF", "AEING", *[f"PREIS{i}" for i in range(1, 5)]):
        rows = rows.withColumn(c, F.when(k % 2 == 0, F.replace(F.col(c), F.lit("."), F.lit(","))).otherwise(F.col(c)))
    for c in ("ANREISE", "ABREISE", "AVON", "ABIS", *[g[2] for g in LG.GUEST_SLOTS]):
        rows = rows.withColumn(c, F.regexp_replace(F.col(c), r"^(\d+)-(\d+)-(\d+)$", "$3.$2.$1"))
    rows = rows.withColumn("ANZAHL2", F.when(k % 53 == 0, F.lit("99999999999")).otherwise(F.col("ANZAHL2")))
    rows = rows.withColumn("_times", F.when(k % 47 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.withColumn("_copy", F.explode("_times"))
    rows = rows.withColumn("BEMAUFE", F.when(F.col("_copy") == 2, F.lit("doppelt")).otherwise(F.col("BEMAUFE")))
    rows = rows.withColumn("RECORDID", F.when(k % 41 == 0, F.lit(" ")).when(k % 43 == 0, F.lit("n/a"))
                           .otherwise(F.col("RECORDID")))
    order = sorted(LG.COLUMNS, key=lambda c: c[::-1])
    out = [F.col(c).alias({"KUNDENNUMMER": "kundennr"}.get(c, c.lower() if i % 3 else c)) for i, c in enumerate(order)]
    return rows.select(F.lit("x").alias("FREMD1"), *out[:20], F.lit("").alias("Fremd 2"), *out[20:])


def read_foreign(spark, sf_dir):
    """The foreign export: read once from its CSV into an untouched parquet copy, as ``legacy_source`` is; the steps on it
    (ids, single rows, repeated ones) read that and not the file again."""
    loc = model_location(spark, sf_dir)
    path = publish_once(spark, f"{loc}/foreign-export-v{LG.EXPORT_VERSION}",
                        lambda p: LG.write_legacy_csv(foreign_export(spark, sf_dir), f"{p}/rows.csv.gz", sep=";"))
    raw = publish_once(spark, f"{loc}/foreign-raw-v{LG.EXPORT_VERSION}",
                       lambda p: LG.write_raw(LG.read_legacy_csv(spark, f"{path}/rows.csv.gz", sep=";"), p))
    return spark.read.schema(LG.LEGACY_SCHEMA).parquet(raw)


@register("s3_foreign_export", LEGACY_SQL + f"""
SELECT recordid_n AS id, groupid_n AS customer, SUCH AS keyword, FIRMA AS company,
       CASE WHEN {cents_sql('AGEF')} > 0 THEN {cents_sql('AGEF')} END AS deposit_asked,
       least(coalesce(f, CAST(t - 1 AS DATE)), coalesce(t, CAST(f + 1 AS DATE))) AS arrival,
       CASE WHEN recordid_n % 53 = 0 THEN 0 ELSE greatest(coalesce(TRY_CAST(ANZAHL2 AS BIGINT), 0), 0) END AS n_second
FROM lgt WHERE recordid_n % 41 <> 0 AND recordid_n % 43 <> 0
""")
def s3_foreign_export(spark, sf_dir):
    """S3 + T8 + C3 + T16: an export of another layout and dialect, found by header
    name; one row per usable record id, unbelievable counts as none."""
    typed = MG.valid_records(MG.cast_legacy(read_foreign(spark, sf_dir), "de"))
    return typed.select(F.col("recordid").alias("id"), F.col("groupid").alias("customer"),
                        F.col("SUCH").alias("keyword"), F.col("FIRMA").alias("company"),
                        F.col("agef").alias("deposit_asked"), MG.legacy_period(typed)["a"].alias("arrival"),
                        F.greatest(MG._bounded("ANZAHL2", MG.MAX_COPIES, 0), F.lit(0)).alias("n_second"))


@register("c3_import_problems", LEGACY_SQL + """
SELECT CASE WHEN recordid_n % 41 = 0 THEN ' ' ELSE 'n/a' END AS RECORDID,
       'record id missing or not a number' AS problem, sum(CASE WHEN recordid_n % 47 = 0 THEN 2 ELSE 1 END)::BIGINT AS n
FROM lgt WHERE recordid_n % 41 = 0 OR recordid_n % 43 = 0 GROUP BY 1
UNION ALL SELECT RECORDID, 'record id occurs several times', 2 FROM lgt
WHERE recordid_n % 47 = 0 AND recordid_n % 41 <> 0 AND recordid_n % 43 <> 0
UNION ALL SELECT CASE WHEN recordid_n % 41 = 0 THEN ' ' WHEN recordid_n % 43 = 0 THEN 'n/a' ELSE RECORDID END,
       'item count or percent out of range', sum(CASE WHEN recordid_n % 47 = 0 THEN 2 ELSE 1 END)::BIGINT
FROM lgt WHERE recordid_n % 53 = 0 GROUP BY 1
""")
def c3_import_problems(spark, sf_dir):
    """C3 on the import: rows of the foreign export that cannot be used, and why."""
    return MG.legacy_problems(read_foreign(spark, sf_dir))


@register("s3_legacy_csv_roundtrip", LEGACY_SQL + """
SELECT RECORDID, GROUPID, SUCH, BEMAUFE, TELEFAX, PREIS1, GEB_DAT02 FROM lg
""")
def s3_legacy_csv_roundtrip(spark, sf_dir):
    """S3: the legacy export read back (quoted multi-line cells, Latin-1, CRLF)."""
    src = legacy_export(spark, sf_dir)
    return src.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in
                        ("RECORDID", "GROUPID", "SUCH", "BEMAUFE", "TELEFAX", "PREIS1",
                         "GEB_DAT02")])


_NOTE_SQL = ("'Importiert aus Combit (' || CASE WHEN GROUPID <> '' THEN GROUPID ELSE RECORDID END "
             "|| ').' || chr(10)"
             " || CASE WHEN KUNDENNUMMER <> '' THEN 'Kunden-Nr.: ' || KUNDENNUMMER || chr(10) ELSE '' END"
             " || CASE WHEN KATEGORIE <> '' THEN 'Kategorie: ' || KATEGORIE || chr(10) ELSE '' END"
             " || CASE WHEN PLZP <> '' THEN 'Plzp: ' || PLZP || chr(10) ELSE '' END"
             " || CASE WHEN POSTFACH <> '' THEN 'Fach: ' || POSTFACH || chr(10) ELSE '' END")


@register("w1_legacy_customers", LEGACY_SQL + f"""
SELECT groupid_n AS id, SUCH AS keyword, VORNAME AS given, NAME AS family,
       trim(STRASSE || ' ' || HNR) AS street_with_num, PLZZ AS postal_code, ORT AS city,
       LAND AS country_code,
       CASE WHEN trim(TELEFON) LIKE '%/' THEN '' ELSE trim(TELEFON) END AS phone,
       CASE WHEN trim(MOBILTEL) LIKE '%/' THEN '' ELSE trim(MOBILTEL) END AS mobile,
       CASE WHEN trim(TELEFAX) LIKE '%/' THEN '' ELSE trim(TELEFAX) END AS fax,
       {_NOTE_SQL} AS note
FROM (SELECT *, row_number() OVER (PARTITION BY groupid_n ORDER BY recordid_n DESC) AS rn FROM lgt)
WHERE rn = 1
""")
def w1_legacy_customers(spark, sf_dir):
    """W1 + T8, T9, T12, T13, T14: one customer per legacy group (highest record id)."""
    customers = MG.migrate_customers(legacy_source(spark, sf_dir))
    d = F.col("data")
    return customers.select("id", d["keyword"].alias("keyword"), d["name"]["given"].alias("given"),
                            d["name"]["family"].alias("family"),
                            d["address"]["street_with_num"].alias("street_with_num"),
                            d["address"]["postal_code"].alias("postal_code"),
                            d["address"]["city"].alias("city"),
                            d["address"]["country_code"].alias("country_code"),
                            d["contact"]["phone"].alias("phone"), d["contact"]["mobile"].alias("mobile"),
                            d["contact"]["fax"].alias("fax"), d["note"].alias("note"))


_GUEST_SLOTS_SQL = " UNION ALL ".join(
    f"SELECT recordid_n, {i} AS slot, trim({g}) AS given, trim({f}) AS family, "
    f"TRY_CAST(nullif(trim({b}), '') AS DATE) AS born FROM lgt"
    for i, (g, f, b) in enumerate(LG.GUEST_SLOTS, start=1))

_ALLOC_SLOTS_SQL = " UNION ALL ".join(
    f"SELECT recordid_n, {i} AS slot, {('trim(ZIMMER)' if i == 1 else chr(39) * 2)} AS room, "
    f"{cents_sql(f'PREIS{i}')} AS price, trim(ART{i}) AS art, "
    f"coalesce(CASE WHEN regexp_matches(trim(ANZAHL{i}), '^[+-]?[0-9]+$') THEN CAST(trim(ANZAHL{i}) AS BIGINT) END, 0) AS amount, "
    f"CAST(trunc((coalesce(CASE WHEN regexp_matches(trim(PROZ{i}), '^[+-]?[0-9]+$') THEN CAST(trim(PROZ{i}) AS BIGINT) END, 100) + 99) / 100) AS INTEGER) AS beds "
    f"FROM lgt" for i in range(1, 5))

_BOOKING_NOTE_SQL = ("trim('Importiert aus Combit (' || RECORDID || ').' || chr(10) || chr(10) || " + " || ".join(
    f"CASE WHEN ART{i} = '' AND PREIS{i} = '0.00' THEN '' ELSE '- ' || ANZAHL{i} || 'x ' || ART{i} || ' à ' "
    f"|| PREIS{i} || '€ (' || PROZ{i} || '%)' || chr(10) END" for i in range(1, 5))
    + f" || chr(10) || BEMAUFE, {WS_SQL})")


@register("t11_legacy_bookings", LEGACY_SQL + f"""
, gsl AS ({_GUEST_SLOTS_SQL})
, asl AS ({_ALLOC_SLOTS_SQL})
SELECT lgt.recordid_n AS id, lgt.groupid_n AS customer,
       least(coalesce(f, CAST(t - 1 AS DATE)), coalesce(t, CAST(f + 1 AS DATE))) AS arrival,
       greatest(coalesce(f, CAST(t - 1 AS DATE)), coalesce(t, CAST(f + 1 AS DATE))) AS departure,
       CASE WHEN {cents_sql('AGEF')} > 0 THEN {cents_sql('AGEF')} END AS deposit_asked,
       CASE WHEN {cents_sql('AEING')} > 0 THEN {cents_sql('AEING')} END AS deposit_got,
       CAST((SELECT count(*) FROM gsl WHERE gsl.recordid_n = lgt.recordid_n
              AND NOT (given = '' AND family = '' AND born IS NULL)) AS INTEGER) AS n_guests,
       CAST((SELECT coalesce(sum(greatest(amount, 0)), 0) FROM asl WHERE asl.recordid_n = lgt.recordid_n
              AND art <> 'Kurtaxe' AND price IS NOT NULL AND price <> 0) AS INTEGER) AS n_allocs,
       {_BOOKING_NOTE_SQL} AS note
FROM lgt WHERE f IS NOT NULL OR t IS NOT NULL
""")
def t11_legacy_bookings(spark, sf_dir):
    """One booking per legacy row with a stay."""
    _, bookings = MG.migrate(legacy_source(spark, sf_dir))
    d = F.col("data")
    return bookings.select("id", "customer", "arrival", "departure",
                           d["deposit_asked"].alias("deposit_asked"),
                           d["deposit_got"].alias("deposit_got"),
                           F.size(d["guests"]).alias("n_guests"),
                           F.size(d["allocs"]).alias("n_allocs"), d["note"].alias("note"))


@register("u1_legacy_guests", LEGACY_SQL + f"""
, gsl AS ({_GUEST_SLOTS_SQL})
SELECT recordid_n AS id, CAST(row_number() OVER (PARTITION BY recordid_n ORDER BY slot) - 1 AS INTEGER)
         AS pos, given, family, born
FROM gsl JOIN lgt USING (recordid_n)
WHERE NOT (given = '' AND family = '' AND born IS NULL) AND (lgt.f IS NOT NULL OR lgt.t IS NOT NULL)
""")
def u1_legacy_guests(spark, sf_dir):
    """U1 + F7: guest slots of the legacy rows as guest rows (slot order kept)."""
    _, bookings = MG.migrate(legacy_source(spark, sf_dir))
    g = bookings.select("id", F.posexplode("data.guests").alias("pos", "g"))
    return g.select("id", "pos", "g.given", "g.family", "g.born")


@register("t16_legacy_allocs", LEGACY_SQL + f"""
, asl AS ({_ALLOC_SLOTS_SQL})
, valid AS (SELECT * FROM asl WHERE art <> 'Kurtaxe' AND price IS NOT NULL AND price <> 0)
, copies AS (SELECT recordid_n, slot, room, price, art, beds, unnest(range(greatest(amount, 0))) AS j
             FROM valid)
SELECT c.recordid_n AS id,
       CAST(row_number() OVER (PARTITION BY c.recordid_n ORDER BY slot, j) - 1 AS INTEGER) AS pos,
       CASE WHEN j = 0 THEN room ELSE '' END AS room, price AS price_per_bed, beds, art AS description
FROM copies c JOIN lgt ON lgt.recordid_n = c.recordid_n WHERE lgt.f IS NOT NULL OR lgt.t IS NOT NULL
""")
def t16_legacy_allocs(spark, sf_dir):
    """Legacy item slots -> room lines (copies, beds from percent, room on copy 1)."""
    _, bookings = MG.migrate(legacy_source(spark, sf_dir))
    a = bookings.select("id", F.posexplode("data.allocs").alias("pos", "a"))
    return a.select("id", "pos", "a.room", "a.price_per_bed", "a.beds", "a.description")


@register("a10_import_summary", LEGACY_SQL + """
SELECT max(groupid_n) AS max_id, count(DISTINCT groupid_n) AS n_customers FROM lgt
""")
def a10_import_summary(spark, sf_dir):
    """A10: highest imported customer id and number of imported customers."""
    customers = MG.migrate_customers(legacy_source(spark, sf_dir))
    return MG.import_summary(customers)


@register("j4_attach_guests", LEGACY_SQL + f"""
, gsl AS ({_GUEST_SLOTS_SQL})
, kept AS (SELECT * FROM gsl WHERE NOT (trim(given || family) = '' AND born IS NULL) OR slot = 1)
SELECT lgt.recordid_n AS id, CAST(count(kept.slot) AS INTEGER) AS n_guests,
       coalesce(string_agg(kept.given || '|' || kept.family || '|' || coalesce(strftime(kept.born, '%Y-%m-%d'), ''),
                           ';' ORDER BY kept.slot), '') AS guests
FROM lgt LEFT JOIN kept ON kept.recordid_n = lgt.recordid_n
GROUP BY lgt.recordid_n
""")
def j4_attach_guests(spark, sf_dir):
    """U1 (unpivot with stack, slot 1 always kept) -> A6 (guest rows to an ordered
    array per booking) -> J4 (left join back to the bookings), as the SQL importer."""
    typed = MG.cast_legacy(legacy_source(spark, sf_dir))
    stack = "stack(6, " + ", ".join(
        f"{i}, {g}, {f}, {b.lower()}" for i, (g, f, b) in enumerate(LG.GUEST_SLOTS, start=1)) + \
        ") as (slot, given, family, born)"
    rows = typed.select(F.col("recordid").alias("booking_id"), F.expr(stack))
    rows = rows.where((F.col("slot") == 1) | ~((F.concat("given", "family") == "")
                                              & F.col("born").isNull()))
    per = MG.guests_per_booking(rows)
    b = MG.attach_guests(typed.select(F.col("recordid").alias("id")), per)
    text = F.array_join(F.transform("guests", lambda g: F.concat_ws(
        "|", g["given"], g["family"], F.coalesce(g["born"].cast("string"), F.lit("")))), ";")
    return b.select("id", F.size("guests").alias("n_guests"), text.alias("guests"))


@register("s4_raw_copy", LEGACY_SQL + """
SELECT RECORDID, GROUPID, SUCH, BEMAUFE FROM lg
""")
def s4_raw_copy(spark, sf_dir):
    """An untouched copy of the raw import kept as a parquet (bronze) table."""
    raw = legacy_source(spark, sf_dir)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c)
                        for c in ("RECORDID", "GROUPID", "SUCH", "BEMAUFE")])


@register("s5_import_json", LEGACY_SQL + f"""
SELECT SUCH AS keyword, VORNAME AS given, NAME AS family, {_NOTE_SQL} AS note
FROM (SELECT *, row_number() OVER (PARTITION BY groupid_n ORDER BY recordid_n DESC) AS rn FROM lgt)
WHERE rn = 1
""")
def s5_import_json(spark, sf_dir):
    """Imported customers emitted as JSON Lines of ``{{"data": ...}}`` and read back."""
    from pyspark.sql import types as T
    from innkeep import schemas
    customers = MG.migrate_customers(legacy_source(spark, sf_dir))
    loc = model_location(spark, sf_dir)
    path = publish_once(spark, f"{loc}/import-json-v{LG.EXPORT_VERSION}",
                        lambda p: LG.write_import_json(customers, p))
    back = spark.read.schema(T.StructType([T.StructField("data", schemas.CUSTOMER_DOC)])).json(path)
    d = F.col("data")
    return back.select(d["keyword"].alias("keyword"), d["name"]["given"].alias("given"),
                       d["name"]["family"].alias("family"), d["note"].alias("note"))
