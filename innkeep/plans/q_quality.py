"""Quality, change and restore queries: C1, C3, C4, C6 (batch and stream), C7,
C8, S9, J5, S6/S7 + J3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from innkeep.functions import periods as P
from innkeep.sources import documents as DOC
from innkeep.operators import quality as Q
from innkeep.operators import restore as RS
from innkeep.plans.catalog import register
from innkeep.session import ensure_checkpoint_dir
from innkeep.sources.fixtures import load_model, model_location, table
from innkeep.sources import ids as IDS
from innkeep.sources import versions as V
from innkeep.sources.shared import publish_once
from innkeep.streaming import changes as ST

CUSTOMER_START = 1_000_000
BOOKING_START = 5_000_000


@register("c1_violations", """
SELECT 'customers' AS "table", id, 'id >= 0' AS rule FROM cu WHERE id < 0
UNION ALL SELECT 'customers', id, 'keyword not blank' FROM cu WHERE keyword IS NULL OR trim(keyword) = ''
UNION ALL SELECT 'bookings', id, 'id >= 0' FROM bk WHERE id < 0
UNION ALL SELECT 'bookings', id, 'stay dates present' FROM bk WHERE arrival IS NULL OR departure IS NULL
""")
def c1_violations(spark, sf_dir):
    """C1 + C2: constraint violations of the stored tables."""
    m = load_model(spark, sf_dir)
    return Q.violations(m.customers, m.bookings)


@register("c3_duplicate_invoice_numbers", """
SELECT invoice_no AS number, count(*) AS n FROM inv WHERE invoice_no IS NOT NULL
GROUP BY invoice_no HAVING count(*) > 1
""")
def c3_duplicate_invoice_numbers(spark, sf_dir):
    """Invoice numbers used by more than one booking."""
    return Q.duplicates(load_model(spark, sf_dir).invoice_numbers, "number")


@register("c4_referential_checks", """
SELECT 'bookings.customer' AS "check", count(*) AS n FROM bk WHERE customer NOT IN (SELECT id FROM cu)
UNION ALL
SELECT 'invoice_numbers.booking', count(*) FROM inv WHERE invoice_no IS NOT NULL
  AND booking NOT IN (SELECT id FROM bk)
UNION ALL
SELECT 'events.user_id', count(*) FROM events WHERE user_id NOT IN (SELECT id FROM cu)
""")
def c4_referential_checks(spark, sf_dir):
    """C4: orphan counts of the foreign keys (bookings, invoice numbers, change events)."""
    m = load_model(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer"))
    checks = [
        ("bookings.customer", Q.orphan_count(m.bookings.select("customer"), "customer", m.customers)),
        ("invoice_numbers.booking", Q.orphan_count(m.invoice_numbers, "booking", m.bookings)),
        ("events.user_id", Q.orphan_count(ev, "customer", m.customers)),
    ]
    out = None
    for name, df in checks:
        c = df.select(F.lit(name).alias("check"), "n")
        out = c if out is None else out.unionByName(c)
    return out


_TOUCH_SQL = """
SELECT cu.id, CASE WHEN t.ts IS NULL OR t.ts < cu.modified THEN cu.modified ELSE t.ts END AS modified
FROM cu LEFT JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) t ON t.user_id = cu.id
"""


@register("c6_touch_customers", _TOUCH_SQL)
def c6_touch_customers(spark, sf_dir):
    """C5 + C6: booking changes (the ``events`` stream) touch their customer."""
    m = load_model(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer"), "ts")
    return Q.touch_customers(m.customers.select("id", "modified"), ev)


@register("c6_touch_customers_stream", _TOUCH_SQL)
def c6_touch_customers_stream(spark, sf_dir):
    """C6 as Structured Streaming: stateful max per customer, appended per batch
    (idempotent on replay), applied to the customers table."""
    m = load_model(spark, sf_dir)
    root = ensure_checkpoint_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    return ST.touch_once(spark, m.customers.select("id", "modified"), sf_dir, schema, root, files="events.parquet")


def _new_table(spark, rows, block_rows=1000):
    """A versioned table of its own for a run that changes it."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/innkeep-versions/{uuid.uuid4().hex}"
    V.create(spark, root, rows, block_rows=block_rows)
    return root


@register("c6_touch_table_stream", _TOUCH_SQL)
def c6_touch_table_stream(spark, sf_dir):
    """C6 + S9: the change stream merged into the stored customers, a version per micro-batch."""
    root = _new_table(spark, load_model(spark, sf_dir).customers.select("id", "modified"))
    stream = ST.change_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, files="events.parquet")
    ST.run_table_stream(stream, root, f"{root}-stream").awaitTermination()
    return V.read(spark, root)


def _changes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("id"), Q.change_ops(F.col("event_type")).alias("op"),
                     "ts", F.col("event_id").alias("change_id"),
                     F.format_string("kw-%d", F.col("event_id")).alias("keyword"))


_APPLY_SQL = """
, lastc AS (
  SELECT * FROM (SELECT user_id AS id, event_id, ts,
                        CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' THEN 'delete'
                             ELSE 'update' END AS op,
                        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
                 FROM events) WHERE rn = 1
), applied AS (
  SELECT coalesce(cu.id, c.id) AS id,
         CASE WHEN c.op IN ('insert', 'update') THEN 'kw-' || CAST(c.event_id AS VARCHAR) ELSE cu.keyword END
           AS keyword,
         CASE WHEN c.op IN ('insert', 'update') THEN c.ts ELSE cu.modified END AS modified
  FROM cu FULL OUTER JOIN lastc c ON c.id = cu.id
  WHERE c.op IS NULL OR c.op <> 'delete'
)
"""


@register("s9_apply_changes", _APPLY_SQL + "SELECT id, keyword, modified FROM applied")
def s9_apply_changes(spark, sf_dir):
    """S9 + C5: apply the change batch (latest change per key; upsert or delete)."""
    m = load_model(spark, sf_dir)
    return Q.apply_changes(m.customers.select("id", "keyword", "modified"), _changes(spark, sf_dir))


@register("s9_versioned_upsert", _APPLY_SQL + "SELECT id, keyword, modified FROM applied")
def s9_versioned_upsert(spark, sf_dir):
    """S9 + C5, stored: the changes in three batches by time, the second one delivered twice, each a
    version of the customers table; the last version is read."""
    root = _new_table(spark, load_model(spark, sf_dir).customers.select("id", "keyword", "modified"))
    changes = _changes(spark, sf_dir)
    cuts = changes.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.4, 0.8]).alias("c")).first()["c"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    batches = [changes.where(at <= cuts[0]), changes.where((at > cuts[0]) & (at <= cuts[1])), changes.where(at > cuts[1])]
    for number in (0, 1, 1, 2):
        V.commit(spark, root, batches[number], Q.apply_changes, "changes", number)
    return V.read(spark, root)


@register("c7_changed_documents", """
SELECT 'customers' AS "table", id, CASE WHEN id % 13 = 0 THEN 'removed' ELSE 'changed' END AS status,
       CASE WHEN id % 13 = 0 THEN '' ELSE concat_ws(',', CASE WHEN id % 7 = 0 THEN 'address.city' END,
            CASE WHEN id % 11 = 0 THEN 'contact.phone' END, CASE WHEN id % 11 = 0 THEN 'name.given' END) END AS paths
FROM cu WHERE id % 13 = 0 OR id % 7 = 0 OR id % 11 = 0
UNION ALL SELECT 'customers', -id, 'added', '' FROM cu WHERE id % 17 = 0 AND id > 0
UNION ALL
SELECT 'bookings', bk.id, 'changed', concat_ws(',',
       CASE WHEN bk.id % 3 = 0 AND deposit_asked IS NOT NULL THEN 'deposit_asked' END,
       CASE WHEN bk.id % 5 = 1 THEN 'guests.length' END,
       CASE WHEN bk.id % 5 = 1 THEN 'guests[' || n_guests || ']' END,
       CASE WHEN bk.id % 4 = 2 THEN 'note' END)
FROM bk WHERE (bk.id % 3 = 0 AND deposit_asked IS NOT NULL) OR bk.id % 5 = 1 OR bk.id % 4 = 2
""")
def c7_changed_documents(spark, sf_dir):
    """C7 over whole documents: a second version of both tables in which towns, names and phones differ,
    customers are gone or new, deposits are gone, a guest was added (or the list of none was replaced)
    and notes changed; (table, id, status, paths)."""
    m = load_model(spark, sf_dir)
    k, d = F.col("id"), F.col("data")
    edited = d
    for cond, field in ((k % 7 == 0, "address.city"), (k % 11 == 0, "contact.phone"), (k % 11 == 0, "name.given")):
        old = d
        for part in field.split("."):
            old = old[part]
        edited = edited.withField(field, F.when(cond, F.concat(old, F.lit("*"))).otherwise(old))
    c = m.customers.select("id", "data")
    remote = c.where(k % 13 != 0).select("id", edited.alias("data")).unionByName(
        c.where((k % 17 == 0) & (k > 0)).select((-k).alias("id"), "data"))
    b = m.bookings.select("id", "data")
    guest = b.schema["data"].dataType["guests"].dataType.elementType
    none = F.lit(None).cast(guest)
    later = (d.withField("deposit_asked", F.when(k % 3 != 0, d["deposit_asked"]))
             .withField("guests", F.when(k % 5 == 1, F.concat(d["guests"], F.array(none))).otherwise(d["guests"]))
             .withField("note", F.when(k % 4 == 2, F.concat(d["note"], F.lit("!"))).otherwise(d["note"])))
    out = [Q.changed_documents(c, remote).withColumn("table", F.lit("customers")),
           Q.changed_documents(b, b.select("id", later.alias("data"))).withColumn("table", F.lit("bookings"))]
    return out[0].unionByName(out[1]).select("table", "id", "status", F.array_join("paths", ",").alias("paths"))


@register("c7_changed_customers", _APPLY_SQL + """
SELECT coalesce(cu.id, a.id) AS id FROM cu FULL OUTER JOIN applied a ON a.id = cu.id
WHERE cu.keyword IS DISTINCT FROM a.keyword
""")
def c7_changed_customers(spark, sf_dir):
    """Customers whose stored keyword differs after the change batch."""
    m = load_model(spark, sf_dir)
    before = m.customers.select("id", "keyword")
    after = Q.apply_changes(m.customers.select("id", "keyword", "modified"), _changes(spark, sf_dir))
    return Q.changed(before, after.select("id", "keyword"), "id", "keyword")


@register("c8_locked_changes", """
SELECT bk.id, CAST(p.n AS BIGINT) AS n_edits,
       CASE WHEN bk.has_invoice THEN 'rejected' ELSE 'accepted' END AS status
FROM bk JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase'
              GROUP BY user_id) p ON p.user_id = bk.customer
""")
def c8_locked_changes(spark, sf_dir):
    """Edit batch (purchase events, pre-aggregated per customer, applied to the
    customer's bookings) split into accepted and rejected (invoiced = locked)."""
    m = load_model(spark, sf_dir)
    per_user = (table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
                .groupBy(F.col("user_id").alias("customer")).agg(F.count(F.lit(1)).alias("n_edits")))
    edits = m.bookings.select("id", "customer").join(per_user, "customer").select("id", "n_edits")
    accepted, rejected = Q.locked_changes(edits, m.bookings)
    return accepted.withColumn("status", F.lit("accepted")).unionByName(
        rejected.withColumn("status", F.lit("rejected")))


@register("c1_broken_rows", """
SELECT 'customers' AS "table", CASE WHEN id % 29 = 0 THEN -id ELSE id END AS id,
       unnest(list_filter([CASE WHEN id % 29 = 0 AND id > 0 THEN 'id >= 0' END, CASE WHEN id % 31 = 0 THEN 'keyword not blank' END],
                          lambda x: x IS NOT NULL)) AS rule FROM cu WHERE (id % 29 = 0 AND id > 0) OR id % 31 = 0
UNION ALL SELECT 'bookings', id, 'stay dates present' FROM bk WHERE id % 37 = 0
""")
def c1_broken_rows(spark, sf_dir):
    """C1 + C2: constraint violations of a table in which every 29th customer has a
    negative id, every 31st a blank keyword and every 37th booking no departure."""
    m = load_model(spark, sf_dir)
    k = F.col("id")
    c = m.customers.select(F.when(k % 29 == 0, -k).otherwise(k).alias("id"),
                           F.when(k % 31 == 0, F.lit("  ")).otherwise(F.col("keyword")).alias("keyword"))
    b = m.bookings.select("id", "arrival", F.when(k % 37 != 0, F.col("departure")).alias("departure"))
    return Q.violations(c, b)


@register("c2_trimmed_keywords", """
SELECT id, keyword FROM cu
""")
def c2_trimmed_keywords(spark, sf_dir):
    """Padded keywords are stored trimmed."""
    m = load_model(spark, sf_dir)
    pad = F.concat(F.lit("  "), F.col("keyword"), F.lit(" "))
    padded = m.customers.select("id", pad.alias("keyword"), F.col("data").withField("keyword", pad).alias("data"))
    return Q.clean_keyword(padded).select("id", F.col("data.keyword").alias("keyword"))


@register("c4_orphans", """
SELECT bk.id, bk.customer FROM bk JOIN cu ON cu.id = bk.customer WHERE bk.customer % 10 = 3
""")
def c4_orphans(spark, sf_dir):
    """C4: bookings left without their customer when every tenth customer is gone."""
    m = load_model(spark, sf_dir)
    return Q.orphans(m.bookings.select("id", "customer"), "customer", m.customers.where(F.col("id") % 10 != 3)) \
        .select("id", "customer")


@register("j5_cascade_delete", """
SELECT bk.id, bk.customer, bk.has_invoice AND inv.invoice_no IS NOT NULL AS blocked
FROM bk JOIN customer c ON c.c_custkey = bk.customer
LEFT JOIN inv ON inv.booking = bk.id
WHERE c.c_acctbal < 0
""")
def j5_cascade_delete(spark, sf_dir):
    """Deleting the customers with a negative balance removes their bookings;
    bookings referenced by an invoice number block the delete."""
    m = load_model(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0) \
        .select(F.col("c_custkey").alias("id"))
    before = m.bookings.select("id", "customer")
    _, left, blocking = Q.delete_customers(m.customers.select("id"), before, m.invoice_numbers, gone)
    doomed = before.join(left.select("id"), "id", "left_anti")
    return doomed.join(blocking.select("id", F.lit(True).alias("blocked")), "id", "left").select(
        "id", "customer", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def _backup_path(spark, sf_dir):
    loc = model_location(spark, sf_dir)
    m = load_model(spark, sf_dir)
    path = publish_once(spark, f"{loc}/backup-v1",
                        lambda p: RS.backup(m.customers, m.bookings, p))
    return path, m


_RESTORE_SQL = f"""
, nc AS (SELECT id AS old_id, {CUSTOMER_START} + row_number() OVER (ORDER BY id) - 1 AS new_id FROM cu)
, nb AS (SELECT id AS old_id, customer,
                {BOOKING_START} + row_number() OVER (ORDER BY customer DESC, id DESC) - 1 AS new_id
         FROM bk)
"""


@register("j3_restore_bookings", _RESTORE_SQL + """
SELECT nb.new_id AS id, nb.old_id, nc.new_id AS customer, nb.customer AS old_customer
FROM nb JOIN nc ON nc.old_id = nb.customer
""")
def j3_restore_bookings(spark, sf_dir):
    """S6 + S7 + J3: back up both tables (JSON), restore with new ids; bookings
    follow their customer through the import key."""
    path, m = _backup_path(spark, sf_dir)
    c, b = RS.restore(spark, path, CUSTOMER_START, BOOKING_START)
    key = c.select(F.col("id").alias("customer"), F.col("data._import_key").alias("old_customer"))
    return b.join(key, "customer").select("id", "old_id", "customer", "old_customer")


def _backup_object(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return publish_once(spark, f"{model_location(spark, sf_dir)}/backup-object-v3",
                        lambda p: DOC.write_backup(m.customers, m.bookings, p))


@register("s6_backup_object", """
SELECT bk.id, bk.customer, cu.keyword AS keyword, bk.arrival, bk.departure, bk.deposit_asked, bk.deposit_got,
       bk.n_guests, bk.has_invoice, bk.modified, false AS corrupt
FROM bk JOIN cu ON cu.id = bk.customer
""")
def s6_backup_object(spark, sf_dir):
    """S6 + S7 + T4 + T5: both tables written as one backup object in the exchanged
    encoding and read back (period pairs, money in units, tax variants)."""
    c, b = DOC.read_backup(spark, _backup_object(spark, sf_dir))
    names = c.select(F.col("id").alias("customer"), F.col("data.keyword").alias("keyword"),
                     F.col("_corrupt").alias("c_corrupt"))
    d = F.col("data")
    # what is asked of a document is taken before the join: documents and their texts do not move
    asked = b.select(
        "id", "customer", P.arrival_of(d["period"]).alias("arrival"), P.departure_of(d["period"]).alias("departure"),
        d["deposit_asked"].alias("deposit_asked"), d["deposit_got"].alias("deposit_got"),
        F.size(d["guests"]).alias("n_guests"), d["invoice"].isNotNull().alias("has_invoice"), "modified",
        F.col("_corrupt").isNotNull().alias("corrupt"))
    return asked.join(names.withColumn("c_corrupt", F.col("c_corrupt").isNotNull()), "customer").select(
        "id", "customer", "keyword", *asked.columns[2:-1], (F.col("corrupt") | F.col("c_corrupt")).alias("corrupt"))


@register("s2_json_bookings", """
SELECT bk.id, bk.customer, bk.arrival, bk.departure, bk.deposit_asked,
       CASE WHEN bk.id % 7 = 0 THEN 'kept' ELSE '' END AS broken
FROM bk WHERE bk.id % 7 <> 0
UNION ALL SELECT bk.id, bk.customer, NULL, NULL, NULL, 'kept' FROM bk WHERE bk.id % 7 = 0
""")
def s2_json_bookings(spark, sf_dir):
    """S2 + T4: bookings from JSON Lines in the exchanged encoding; every seventh
    document lacks its note and stays, whole, as a corrupt one."""
    m = load_model(spark, sf_dir)

    def write(p):
        good = DOC.encode_rows(m.bookings, "bookings")
        DOC.write_lines(good.select(F.when(F.col("id") % 7 == 0, F.replace(F.col("text"), F.lit('"note":'), F.lit('"noted":')))
                                    .otherwise(F.col("text")).alias("value")), p)
    path = publish_once(spark, f"{model_location(spark, sf_dir)}/bookings-json-v2", write)
    d = F.col("data")
    return DOC.read_rows(spark, path, "bookings").select(
        "id", "customer", P.arrival_of(d["period"]).alias("arrival"), P.departure_of(d["period"]).alias("departure"),
        d["deposit_asked"].alias("deposit_asked"),
        F.when(F.col("_corrupt").contains('"noted":'), F.lit("kept")).otherwise(F.lit("")).alias("broken"))


@register("s1_json_customers", """
SELECT id, keyword, given, family, city, created, modified FROM cu
""")
def s1_json_customers(spark, sf_dir):
    """Customers from JSON Lines in the exchanged encoding."""
    m = load_model(spark, sf_dir)
    path = publish_once(spark, f"{model_location(spark, sf_dir)}/customers-json-v2",
                        lambda p: DOC.write_rows(m.customers, p, "customers"))
    d = F.col("data")
    return DOC.read_rows(spark, path, "customers").where(F.col("_corrupt").isNull()).select(
        "id", d["keyword"].alias("keyword"), d["name"]["given"].alias("given"), d["name"]["family"].alias("family"),
        d["address"]["city"].alias("city"), "created", "modified")


_SINGLE_SQL = """
SELECT -1 AS id, cu.id AS customer, bk.arrival, bk.departure, bk.n_guests, cu.modified
FROM cu JOIN bk ON bk.customer = cu.id
UNION ALL SELECT cu.id, NULL, NULL, NULL, CAST((SELECT count(*) FROM bk WHERE bk.customer = cu.id) AS INTEGER), cu.modified FROM cu
"""


def _single_lines(m, array):
    """The lines of the old export: one document per customer, as the layout has it."""
    inner = m.bookings.groupBy(F.col("customer").alias("customer_id")).agg(
        F.collect_list(DOC.encode_booking()).alias("b"))
    doc = F.concat(F.regexp_replace(DOC.encode_customer(), r"\}$", ""), F.lit(',"bookings":['),
                   F.array_join(F.coalesce("b", F.array().cast("array<string>")), ","), F.lit("]}"))
    # the size of an aggregate is estimated without its lists: unhinted, all documents would be broadcast
    rows = m.customers.withColumnRenamed("id", "customer_id").join(inner.hint("merge"), "customer_id", "left")
    lines = rows.select("customer_id", F.concat(
        F.lit('{"customer_id":'), F.col("customer_id").cast("string"),
        *[x for c in ("created", "modified") for x in
          (F.lit(f',"{c}":"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))],
        F.lit(',"data":'), doc, F.lit("}")).alias("value"))
    if array:
        # the ends are those of the customers: their documents need not be built for them
        ends = m.customers.agg(F.min("id").alias("first"), F.max("id").alias("last"))
        k = F.col("customer_id")
        lines = lines.join(F.broadcast(ends), k.isNotNull() & (k >= F.col("first")), "left").select(
            "customer_id", F.concat(F.when(k == F.col("first"), F.lit("[")).otherwise(F.lit("\n,")), "value",
                                    F.when(k == F.col("last"), F.lit("]")).otherwise(F.lit(""))).alias("value"))
        lines = lines.repartitionByRange("customer_id").sortWithinPartitions("customer_id")
    return lines


def _single_table(spark, sf_dir, array):
    """The old export written from the model: JSON Lines, or one array over several parts."""
    m = load_model(spark, sf_dir)

    def write(p):
        DOC.write_lines(_single_lines(m, array).select("value"), p)
    name = "single-array-v2" if array else "single-table-v2"
    path = publish_once(spark, f"{model_location(spark, sf_dir)}/{name}", write)
    c, b = DOC.read_single_table(spark, path, multi_line=array)
    d = F.col("data")
    per = b.groupBy("customer").agg(F.count(F.lit(1)).cast("int").alias("n"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("customer", "bigint"), ("arrival", "date"), ("departure", "date"))]
    return b.where(F.col("_corrupt").isNull()).select(
        "id", "customer", P.arrival_of(d["period"]).alias("arrival"), P.departure_of(d["period"]).alias("departure"),
        F.size(d["guests"]).alias("n_guests"), "modified").unionByName(
            c.where(F.col("_corrupt").isNull()).join(per, c.id == per.customer, "left").select(
                "id", *none, F.coalesce("n", F.lit(0)).alias("n_guests"), "modified"))


@register("s10_single_table_export", _SINGLE_SQL)
def s10_single_table_export(spark, sf_dir):
    """The old export (a customer's document holds its bookings) split into
    customers and bookings; customers are listed with their number of bookings."""
    return _single_table(spark, sf_dir, array=False)


@register("s10_single_table_array", _SINGLE_SQL)
def s10_single_table_array(spark, sf_dir):
    """S10 as the old tool wrote it, one JSON array, read in byte ranges."""
    return _single_table(spark, sf_dir, array=True)


@register("s7_restore_customers", _RESTORE_SQL + """
SELECT nc.new_id AS id, cu.id AS import_key, cu.keyword, cu.created, cu.modified
FROM nc JOIN cu ON cu.id = nc.old_id
""")
def s7_restore_customers(spark, sf_dir):
    """S6 + S7: restored customers (new ids, old id kept as import key, timestamps kept)."""
    path, m = _backup_path(spark, sf_dir)
    customers = RS.read_backup(spark, path)[0]
    c = RS.remap_customers(customers, CUSTOMER_START)
    return c.select("id", F.col("data._import_key").alias("import_key"),
                    F.col("data.keyword").alias("keyword"), "created", "modified")


@register("s8_bulk_append", """
SELECT CAST(year(arrival) AS INTEGER) AS arrival_year, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum
FROM bk GROUP BY year(arrival)
""")
def s8_bulk_append(spark, sf_dir):
    """Bulk create: the bookings appended to a fresh table in two batches
    (stays before 1998, then the rest) and read back per arrival year."""
    m = load_model(spark, sf_dir)
    b = m.bookings.select("id", "customer", "arrival", "departure")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/innkeep-append/{uuid.uuid4().hex}"
    RS.append(b.where(F.year("arrival") < 1998), path)
    RS.append(b.where(F.year("arrival") >= 1998), path)
    out = spark.read.parquet(path)
    return out.groupBy(F.year("arrival").alias("arrival_year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").cast("bigint").alias("id_sum"))


@register("s8_append_reserved", f"""
SELECT {BOOKING_START} + row_number() OVER (ORDER BY year(arrival) >= 1998, id) - 1 AS id, id AS old_id, arrival FROM bk
""")
def s8_append_reserved(spark, sf_dir):
    """S8 + A10: two appends (stays before 1998, then the rest) whose new ids come from blocks reserved for
    each; the first append is run a second time, as after a failure, and gets its block again."""
    b = load_model(spark, sf_dir).bookings.select(F.col("id").alias("old_id"), "arrival")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/innkeep-append/{uuid.uuid4().hex}"
    early, late = b.where(F.year("arrival") < 1998), b.where(F.year("arrival") >= 1998)
    for name, rows in (("early", early), ("late", late), ("early", early)):
        new = IDS.numbered(rows, f"{root}/ids", name, ["old_id"], start=BOOKING_START)
        new.write.mode("overwrite").parquet(f"{root}/rows/batch={name}")
    return spark.read.parquet(f"{root}/rows").select("id", "old_id", "arrival")


@register("c3_refused_changes", """
, ch AS (SELECT CASE WHEN event_id % 5 = 0 THEN -user_id - 1 ELSE user_id END AS id, event_id AS change_id, ts,
                CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
                CASE WHEN event_id % 7 = 0 THEN -1 ELSE user_id END AS country FROM events),
st AS (SELECT ch.*, cu.id IS NOT NULL AS stored,
              last_value(CASE WHEN op IN ('insert', 'delete') THEN op END IGNORE NULLS) OVER (
                PARTITION BY ch.id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
       FROM ch LEFT JOIN cu ON cu.id = ch.id),
th AS (SELECT *, coalesce(l = 'insert', stored) AS there FROM st)
SELECT id, change_id, 'id exists' AS rule FROM th WHERE op = 'insert' AND there
UNION ALL SELECT id, change_id, 'id unknown' FROM th WHERE op <> 'insert' AND NOT there
UNION ALL SELECT id, change_id, 'country without a parent' FROM th
WHERE op <> 'delete' AND country NOT IN (SELECT id FROM cu)
""")
def c3_refused_changes(spark, sf_dir):
    """C3 + C4 on a change batch: the changes that the stored customers (a versioned table of which only the
    batch's blocks are read) refuse; every fifth change names an unknown customer, every seventh an unknown parent."""
    root = _new_table(spark, load_model(spark, sf_dir).customers.select("id", "keyword"))
    ev = table(spark, sf_dir, "events")
    batch = ev.select(F.when(F.col("event_id") % 5 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("id"),
                      Q.change_ops(F.col("event_type")).alias("op"), "ts", F.col("event_id").alias("change_id"),
                      F.when(F.col("event_id") % 7 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("country"))
    return Q.refused_changes(batch, V.rows_of(spark, root, batch.select("id")), "id",
                             {"country": V.rows_of(spark, root, batch.select("country")).select("id")})
