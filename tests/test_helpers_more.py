"""Smaller operators: page append errors, payload round trip, import JSON."""

import base64
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from innkeep.operators import exports as EX
from innkeep.operators import quality as Q
from innkeep.operators import search as S
from innkeep.sources import legacy as LG
from innkeep.sources import tables as TB
from tests.helpers import customer_doc, customers_df


def test_append_pages_rejects_overlap(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "position int, id string")
    b = spark.createDataFrame([(2, "c")], "position int, id string")
    assert sorted(r.position for r in S.append_pages(a, b).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="Overlapping key ranges"):
        S.append_pages(a, a.where("position = 1")).collect()


def test_letter_payload_round_trip(spark):
    cust = customers_df(spark, [(1, "m", customer_doc(family="Müller"))])
    letters = EX.mailing(cust, "1.1.2020", "blank")
    row = letters.select(EX.letter_payload(F.col("letter")).alias("p"), "letter").first()
    doc = json.loads(base64.b64decode(row.p).decode("utf-8"))
    assert list(doc) == ["sender", "recipient", "sidebar", "subject", "body", "attachments"]
    assert doc["subject"] == "Betreff" and "Müller" in doc["body"]
    assert "\n" not in row.p


def test_import_json_lines(spark):
    cust = customers_df(spark, [(1, "kw", customer_doc(keyword="kw"))])
    out = os.path.join(tempfile.mkdtemp(prefix="import-"), "json")
    LG.write_import_json(cust, out)
    lines = [json.loads(ln) for f in os.listdir(out) if f.endswith(".json")
             for ln in open(os.path.join(out, f), encoding="utf-8") if ln.strip()]
    assert len(lines) == 1 and list(lines[0]) == ["data"] and lines[0]["data"]["keyword"] == "kw"


def test_clean_keyword(spark):
    cust = customers_df(spark, [(1, "  kw ", customer_doc(keyword="  kw "))])
    r = Q.clean_keyword(cust).first()
    assert r.keyword == "kw" and r.data.keyword == "kw"
