"""Constraints, change propagation and quality checks over the stored tables.

All checks are joins/aggregates that return the offending rows (or counts);
nothing is collected.  Change batches are reduced to the latest change per key
with ``max_by`` (partial aggregation: a key with a third of all changes costs
one row per partition in the shuffle) before they meet the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def violations(customers: DataFrame, bookings: DataFrame) -> DataFrame:
    """C1 + C2: rows breaking the table constraints: ids >= 0, keyword present and
    not blank after trimming, both stay dates present.  Columns: table, id, rule.
    Each table is read once; a row yields one output row per broken rule."""
    def broken(df: DataFrame, table: str, rules: list[tuple[str, object]]) -> DataFrame:
        names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]),
                         lambda x: x.isNotNull())
        return (df.select(F.lit(table).alias("table"), "id", names.alias("_r"))
                .where(F.size("_r") > 0)
                .select("table", "id", F.explode("_r").alias("rule")))

    c = broken(customers.select("id", "keyword"), "customers", [
        ("id >= 0", F.col("id") < 0),
        ("keyword not blank", F.col("keyword").isNull() | (F.trim("keyword") == ""))])
    b = broken(bookings.select("id", "arrival", "departure"), "bookings", [
        ("id >= 0", F.col("id") < 0),
        ("stay dates present", F.col("arrival").isNull() | F.col("departure").isNull())])
    return c.unionByName(b)


def clean_keyword(customers: DataFrame) -> DataFrame:
    """Keywords are stored trimmed (blank ones are reported by ``violations``)."""
    return customers.withColumn("keyword", F.trim("keyword")) \
        .withColumn("data", F.col("data").withField("keyword", F.trim("data.keyword")))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Key values occurring more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """C4: child rows whose foreign key has no parent (left anti join)."""
    p = parent.select(F.col(pk).alias(fk))
    return child.join(p, fk, "left_anti")


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """C4 at scale: number of child rows without a parent.  The child is first
    counted per key (partial aggregation, so a hot key costs one row per
    partition), then anti-joined with the parent keys and summed."""
    per_key = child.groupBy(fk).agg(F.count(F.lit(1)).alias("_n"))
    lost = per_key.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n"))


def refused_changes(changes: DataFrame, stored: DataFrame, key: str = "id",
                    references: dict[str, DataFrame] | None = None) -> DataFrame:
    """C3 + C4 on a change batch: (key, change_id, rule) of the changes that would break the tables.

    ``stored`` holds the keys of the batch that the table has, ``references`` for each foreign key the parent ids
    of the batch that there are (``versions.rows_of`` reads both without the rest of the tables).
    Refused are inserts of a key that is stored or that an earlier change of the batch inserted, updates and
    deletes of a key that is neither, and inserts and updates without a parent.  Changes apply in the order of
    (ts, change_id); a delete makes room for a new insert.
    """
    writes = F.col("op").isin("insert", "update")
    known = stored.select(key).distinct().withColumn("_stored", F.lit(1))
    # what the batch itself did to a key before: its last insert or delete; a key's changes in one batch are few
    before = Window.partitionBy(key).orderBy("ts", "change_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("insert", "delete"), F.col("op")), ignorenulls=True).over(before)
    out = changes.join(known, key, "left").withColumn("_last", last)
    there = F.coalesce(F.col("_last") == "insert", F.col("_stored").isNotNull())
    rules = [F.when(F.col(key).isNull(), F.lit(f"{key} missing")),
             F.when((F.col("op") == "insert") & there, F.lit(f"{key} exists")),
             F.when(F.col("op").isin("update", "delete") & F.col(key).isNotNull() & ~there, F.lit(f"{key} unknown"))]
    for n, (column, parents) in enumerate((references or {}).items()):
        mark = f"_parent{n}"
        out = out.join(parents.select(F.col(parents.columns[0]).alias(column)).distinct().withColumn(mark, F.lit(1)), column, "left")
        rules.append(F.when(writes & F.col(mark).isNull(), F.lit(f"{column} without a parent")))
    return out.select(key, "change_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def touch_customers(customers: DataFrame, booking_changes: DataFrame,
                    customer_col: str = "customer", ts_col: str = "ts") -> DataFrame:
    """C5 + C6: every booking insert/update/delete touches its customer's
    ``modified``: modified = greatest(modified, latest change time)."""
    last = (booking_changes.groupBy(F.col(customer_col).alias("id"))
            .agg(F.max(ts_col).alias("_touched")))
    return (customers.join(last, "id", "left")
            .withColumn("modified", F.greatest("modified", F.col("_touched").cast("timestamp_ntz")))
            .drop("_touched"))


def latest_changes(changes: DataFrame, key: str = "id", order: list | None = None) -> DataFrame:
    """Latest change per key by (ts, change id); a partial ``max_by`` aggregate."""
    order = order or ["ts", "change_id"]
    cols = [c for c in changes.columns if c != key]
    return (changes.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("c"))
            .select(key, "c.*"))


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """S9 + C5: apply a batch of upserts/deletes (``op`` in insert/update/delete).

    The latest change per key wins.  Inserted/updated rows take the change's
    columns and ``modified = ts``; deleted keys disappear; untouched rows stay.
    ``changes`` carries ``key, op, ts, change_id`` and the table's value columns.
    """
    last = latest_changes(changes, key)
    value_cols = [c for c in table.columns if c not in (key, "modified")]
    j = table.alias("t").join(last.alias("c"), key, "full_outer")
    op = F.col("c.op")
    changed = op.isin("insert", "update")
    out = j.where(op.isNull() | (op != "delete")).select(
        F.col(key),
        *[F.when(changed, F.col(f"c.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
          for c in value_cols],
        F.when(changed, F.col("c.ts").cast("timestamp_ntz")).otherwise(F.col("t.modified"))
        .alias("modified"))
    return out


def changed(local: DataFrame, remote: DataFrame, key: str = "id", col: str = "data") -> DataFrame:
    """Keys whose document differs between two versions (null-safe)."""
    l = local.select(key, F.col(col).alias("_l"))
    r = remote.select(key, F.col(col).alias("_r"))
    return l.join(r, key, "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r"))).select(key)


def leaves(column: Column, kind: T.DataType, path: Column) -> Column:
    """Every leaf of a document as (path, value): fields by name, list elements by
    position; a list also gives its length, a missing struct or list a null of its own path."""
    pair = lambda p, v: F.array(F.struct(p.alias("path"), v.cast("string").alias("value")))
    if isinstance(kind, T.StructType):
        inner = F.concat(*[leaves(column[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
        return F.when(column.isNull(), pair(path, F.lit(None))).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        each = F.flatten(F.transform(column, lambda x, i: leaves(
            x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(column.isNull(), pair(path, F.lit(None))).otherwise(
            F.concat(pair(F.concat(path, F.lit(".length")), F.size(column)), each))
    return pair(path, column)


def document_digest(column: Column) -> Column:
    """128 bits of a document as JSON; null for none."""
    moment = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"      # to the last digit stored
    options = {"ignoreNullFields": "false", "timestampFormat": moment + "XXX", "timestampNTZFormat": moment}
    return F.when(column.isNotNull(), F.md5(F.to_json(column, options).cast("binary")))


def changed_documents(local: DataFrame, remote: DataFrame, key: str = "id", col: str = "data") -> DataFrame:
    """C7 over whole documents: (key, status, paths) of those that differ.

    ``status``: ``added`` (remote only), ``removed`` (local only) or ``changed``, with the paths of the
    leaves that differ.  First the digests of both sides meet; only documents whose digests differ are
    moved and compared leaf by leaf.  Keys are unique in each version.
    """
    kind = local.schema[col].dataType
    if kind != remote.schema[col].dataType:
        raise ValueError("documents of different layouts")
    mark = document_digest(F.col(col))
    marks = (local.select(key, mark.alias("_l"), F.lit(1).alias("_in_l"))
             .join(remote.select(key, mark.alias("_r"), F.lit(1).alias("_in_r")), key, "full_outer"))
    differ = marks.where(F.col("_in_l").isNull() | F.col("_in_r").isNull() | ~F.col("_l").eqNullSafe(F.col("_r")))
    one_sided = differ.where(F.col("_in_l").isNull() | F.col("_in_r").isNull()).select(
        key, F.when(F.col("_in_l").isNull(), F.lit("added")).otherwise(F.lit("removed")).alias("status"),
        F.array().cast("array<string>").alias("paths"))
    both = differ.where(F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()).select(key)
    side = lambda df, name: df.select(key, F.col(col).alias(name)).join(both, key, "left_semi")
    # the documents meet, not their leaves, which are many times as large
    pairs = side(local, "_l").join(side(remote, "_r"), key).select(
        key, *[leaves(F.col(name), kind, F.lit("")).alias(name) for name in ("_l", "_r")])
    paths = F.transform(F.concat(F.array_except("_l", "_r"), F.array_except("_r", "_l")), lambda x: F.ltrim(x["path"], F.lit(".")))
    compared = pairs.select(
        key, F.lit("changed").alias("status"), F.array_sort(F.array_distinct(paths)).alias("paths"))
    return one_sided.unionByName(compared)


def locked_changes(changes: DataFrame, bookings: DataFrame, key: str = "id"
                   ) -> tuple[DataFrame, DataFrame]:
    """Split a booking change batch into (accepted, rejected): a booking with
    an invoice is locked against edits."""
    invoiced = bookings.where(F.col("data.invoice").isNotNull()).select(F.col("id").alias(key))
    return (changes.join(invoiced, key, "left_anti"), changes.join(invoiced, key, "left_semi"))


def delete_customers(customers: DataFrame, bookings: DataFrame, invoice_numbers: DataFrame,
                     ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cascade delete.  Removing customers removes their bookings; a booking
    referenced by an invoice number may not be removed (restrict).

    Returns (remaining customers, remaining bookings, blocking bookings); the
    delete is valid only when the third frame is empty.
    """
    gone = ids.select(F.col("id").alias("customer"))
    doomed = bookings.join(gone, "customer", "left_semi")
    refs = invoice_numbers.select(F.col("booking").alias("id"))
    blocking = doomed.join(refs, "id", "left_semi")
    return (customers.join(ids.select("id"), "id", "left_anti"),
            bookings.join(gone, "customer", "left_anti"), blocking)


def change_ops(event_type: Column) -> Column:
    """Map change-stream event types to operations (signup -> insert,
    error -> delete, everything else -> update)."""
    return (F.when(event_type == "signup", F.lit("insert"))
            .when(event_type == "error", F.lit("delete"))
            .otherwise(F.lit("update")))
