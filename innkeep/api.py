"""One object over the stored tables: the questions of the business as methods.

    from innkeep.api import Lodging
    lodging = Lodging.open(spark, "/shared/lodging")          # tables written by write_tables
    lodging.month_stats("2024-02-01").show()
    lodging.agenda("2024-02-14").show()
    lodging.search_keyword("_muster").show()
    lodging.tax_table().write.parquet(...)

Every method returns a DataFrame (nothing is collected) built from the
operators of this package; the object only carries the three tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from innkeep.operators import exports, invoices, quality, search, stats, stays
from innkeep.sources import tables


@dataclass
class Lodging:
    customers: DataFrame
    bookings: DataFrame
    invoice_numbers: DataFrame | None = None
    max_nights: int | None = None                 # bound stored with the tables: date filters skip years

    # ------------------------------------------------------------ construction
    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Lodging":
        customers, bookings = tables.open_tables(spark, path)
        try:
            numbers = spark.read.parquet(f"{path}/invoice_numbers")
        except Exception:  # noqa: BLE001 - the table is optional
            numbers = None
        return cls(customers, bookings, numbers, tables.longest_stay(spark, path))

    @classmethod
    def from_legacy_csv(cls, spark: SparkSession, path: str, sep: str = ",",
                        dialect: str = "iso") -> "Lodging":
        from innkeep.operators.migration import migrate
        from innkeep.sources.legacy import read_legacy_csv
        customers, bookings = migrate(read_legacy_csv(spark, path, sep), dialect, materialize=True)
        return cls(customers, bookings)

    def save(self, path: str) -> None:
        tables.write_tables(self.customers, self.bookings, path, self.invoice_numbers)

    # ------------------------------------------------------------ stays
    def agenda(self, day) -> DataFrame:
        return stays.agenda(self.bookings, self.customers, day, self.max_nights).drop("room_key")

    def overlapping(self, start, end) -> DataFrame:
        return stays.overlapping(self.bookings, start, end, self.max_nights)

    def last_stays(self) -> DataFrame:
        return stays.last_stays(self.bookings)

    def customer_bookings(self) -> DataFrame:
        return stays.embedded_bookings(self.customers, self.bookings)

    def rebook_templates(self, today) -> DataFrame:
        return stays.rebook_template(self.bookings, today)

    # ------------------------------------------------------------ statistics
    def month_stats(self, month, with_total: bool = True) -> DataFrame:
        return stats.month_stats(self.bookings, self.customers, month, with_total, self.max_nights)

    def month_invoice_rows(self, month) -> DataFrame:
        return stats.statistics_rows(self.bookings, self.customers, month, self.max_nights)

    def all_months_stats(self) -> DataFrame:
        return stats.all_months_stats(self.bookings, self.customers)

    # ------------------------------------------------------------ search
    def search_keyword(self, query: str, page: int = 0) -> DataFrame:
        return search.search_page(self.customers, self.bookings, search.keyword_filter(query), page)

    def search_text(self, query: str, page: int = 0) -> DataFrame:
        from pyspark.sql import functions as F
        cond = search.websearch(query, F.col("tokens"))
        return search.search_page(self.customers, self.bookings, cond, page)

    # ------------------------------------------------------------ invoices
    def generate_invoices(self, invoice_date=None) -> DataFrame:
        return invoices.generate_invoices(self.bookings, self.customers, invoice_date)

    def invoice_totals(self) -> DataFrame:
        return invoices.invoice_totals(self.bookings)

    def tax_table(self) -> DataFrame:
        return invoices.tax_table(self.bookings)

    def summaries(self) -> DataFrame:
        return invoices.summarise(self.bookings)

    # ------------------------------------------------------------ quality and changes
    def violations(self) -> DataFrame:
        return quality.violations(self.customers, self.bookings)

    def apply_customer_changes(self, changes: DataFrame) -> DataFrame:
        return quality.apply_changes(self.customers, changes)

    def touch_customers(self, booking_changes: DataFrame) -> DataFrame:
        return quality.touch_customers(self.customers, booking_changes)

    # ------------------------------------------------------------ documents
    def interchange(self) -> DataFrame:
        return exports.interchange(self.bookings, self.customers)

    def registrations(self) -> DataFrame:
        return exports.registration_forms(self.bookings, self.customers)

    def confirmation_letters(self, letter_date: str) -> DataFrame:
        return exports.confirmation_letters(self.bookings, self.customers, letter_date)

    def invoice_letters(self) -> DataFrame:
        return exports.invoice_letters(self.bookings)
