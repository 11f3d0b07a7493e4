"""Views as Spark plans them."""

import pytest

from ledgerloom.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["participant", "expense_share", "expense_payment", "line_item_assignment"])
def test_people_are_joined_by_group_and_place(spark, name):
    """No expense meets all members of its group before the place in the group is compared."""
    plan = getattr(Views(spark, SF), name)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
