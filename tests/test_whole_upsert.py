"""The whole-table upsert queries take every document, on one side or both."""

from leafquarry.plans import ingest
from leafquarry.plans.catalogue import QUERIES
from leafquarry.plans.domain import Tables

FOLDER = "/root/testdata/sf0.01"


def test_every_document_takes_part(spark):
    t = Tables(spark, FOLDER)
    ids = {r.id for r in t.docs.select("id").collect()}
    current, new = {r.id for r in ingest.base(t).select("id").collect()}, {r.seq for r in ingest.batch(t).select("seq").collect()}
    assert len(ids) == 1000 and current | new == ids and current & new
    counted = QUERIES["k01_reject_reasons"](spark, FOLDER).collect()
    assert sum(r.cnt for r in counted) == len(new) > 400
