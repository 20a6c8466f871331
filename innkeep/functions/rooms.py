"""Room tokens.

A room text parses to a token: a number (after trimming), an empty token for
blank text, else the trimmed text.  Tokens are STRUCT<kind, num, txt> with
kind 0 = number, 1 = text, 2 = empty, so struct ordering gives
number < text < empty, numbers by value and texts byte-wise.  A booking's rooms
are the distinct sorted tokens of its allocations; arrays of tokens compare
lexicographically, which is the agenda's sort order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def room_token(room) -> Column:
    """Room text -> token STRUCT<kind, num, txt> (0 number, 1 text, 2 empty)."""
    s = F.trim(_c(room))
    num = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
    kind = (F.when(s == "", F.lit(2)).when(num.isNotNull(), F.lit(0)).otherwise(F.lit(1))
            ).cast("tinyint")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == 0, num).alias("num"),
        F.when(kind == 1, s).alias("txt"),
    )


def rooms_of(allocs="data.allocs") -> Column:
    """Distinct sorted room tokens of a booking."""
    return F.array_sort(F.array_distinct(F.transform(_c(allocs), lambda a: room_token(a["room"]))))


def token_text(tok: Column) -> Column:
    return (F.when(tok["kind"] == 0, tok["num"].cast("string"))
            .when(tok["kind"] == 1, tok["txt"]))


def rooms_text(rooms: Column) -> Column:
    """Non-empty tokens joined by ', '; null when there is none."""
    txt = F.array_join(F.transform(F.filter(rooms, lambda t: t["kind"] < 2), token_text), ", ")
    return F.when(txt != "", txt)


def first_room(rooms: Column) -> Column:
    """Smallest token as text (null if none or if it is the empty token)."""
    return token_text(F.try_element_at(rooms, F.lit(1)))
