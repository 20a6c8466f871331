"""Batch jobs over stored tables.

python -m innkeep.cli migrate  CSV OUT [--sep ;] [--dialect de]
python -m innkeep.cli backup   TABLES OUT
python -m innkeep.cli restore  BACKUP OUT --customer-start N --booking-start M
python -m innkeep.cli stats    TABLES MONTH OUT          (month summary with total row)
python -m innkeep.cli agenda   TABLES DAY OUT
python -m innkeep.cli registrations TABLES OUT            (XML)
python -m innkeep.cli interchange   TABLES OUT            (text)

Results are written (parquet unless noted); nothing is collected to the driver.
"""

from __future__ import annotations

import argparse

from innkeep.operators import exports, migration, restore, stats, stays
from innkeep.session import get_session
from innkeep.sources import legacy, tables


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="innkeep")
    sub = ap.add_subparsers(dest="cmd", required=True)
    m = sub.add_parser("migrate")
    m.add_argument("csv")
    m.add_argument("out")
    m.add_argument("--sep", default=",")
    m.add_argument("--dialect", default="iso", choices=["iso", "de"])
    b = sub.add_parser("backup")
    b.add_argument("tables")
    b.add_argument("out")
    r = sub.add_parser("restore")
    r.add_argument("backup")
    r.add_argument("out")
    r.add_argument("--customer-start", type=int, required=True)
    r.add_argument("--booking-start", type=int, required=True)
    s = sub.add_parser("stats")
    s.add_argument("tables")
    s.add_argument("month")
    s.add_argument("out")
    a = sub.add_parser("agenda")
    a.add_argument("tables")
    a.add_argument("day")
    a.add_argument("out")
    for name in ("registrations", "interchange"):
        x = sub.add_parser(name)
        x.add_argument("tables")
        x.add_argument("out")
    args = ap.parse_args(argv)
    spark = get_session()
    run(spark, args)


def run(spark, args) -> None:
    if args.cmd == "migrate":
        raw = legacy.read_legacy_csv(spark, args.csv, args.sep)
        customers, bookings = migration.migrate(raw, args.dialect, materialize=True)
        tables.write_tables(customers, bookings, args.out)
    elif args.cmd == "backup":
        c, b = tables.open_tables(spark, args.tables)
        restore.backup(c, b, args.out)
    elif args.cmd == "restore":
        c, b = restore.restore(spark, args.backup, args.customer_start, args.booking_start)
        tables.write_tables(c, b.drop("old_id"), args.out)
    elif args.cmd == "stats":
        c, b = tables.open_tables(spark, args.tables)
        bound = tables.longest_stay(spark, args.tables)
        stats.month_stats(b, c, args.month, max_nights=bound).write.mode("overwrite").parquet(args.out)
    elif args.cmd == "agenda":
        c, b = tables.open_tables(spark, args.tables)
        bound = tables.longest_stay(spark, args.tables)
        stays.agenda(b, c, args.day, bound).drop("room_key").write.mode("overwrite").parquet(args.out)
    elif args.cmd == "registrations":
        c, b = tables.open_tables(spark, args.tables)
        exports.write_registration_xml(exports.registration_forms(b, c), args.out)
    elif args.cmd == "interchange":
        c, b = tables.open_tables(spark, args.tables)
        exports.interchange(b, c).select("text").write.mode("overwrite").text(args.out)


if __name__ == "__main__":
    main()
