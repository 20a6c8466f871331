"""The old single-table export at size."""

import pytest

from innkeep.plans.q_quality import _single_lines
from innkeep.sources.fixtures import Model
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df


@pytest.mark.parametrize("array", [False, True])
def test_documents_are_not_broadcast(spark, array):
    """the lists of documents are merged with their customers whatever their estimated size."""
    c = customers_df(spark, [(1, "a", customer_doc()), (2, "b", customer_doc())])
    b = bookings_df(spark, [(1, 1, booking_doc("2020-01-01", "2020-01-03"))])
    lines = _single_lines(Model(c, b, None), array)
    assert "strategy=merge" in lines._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count() == 2
