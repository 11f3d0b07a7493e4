"""Shares and payments in the base currency in one pass; rates as of a day."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import balances, fx, split


def test_parts_in_base_are_those_of_two_passes(spark):
    shares = spark.createDataFrame([(1, "a", 50), (1, "b", 51), (2, "a", -5), (2, "b", 15), (3, "a", 0), (3, "b", 0), (4, "c", 7), (5, "a", -3), (5, "b", -4), (9, "a", 1)], "expense_id int, person_id string, share_minor long")
    paid = spark.createDataFrame([(1, "a", "m1", 101), (2, "a", None, 10), (3, "a", None, 1), (4, "c", "m2", 3), (4, "d", None, 4), (5, "a", None, -7), (6, "a", "m1", 2)], "expense_id int, person_id string, payment_method_id string, amount_minor long")
    expense = spark.createDataFrame([(1, "g", 33), (2, "g", 10), (3, "g", 1), (4, "h", 100), (5, "h", -7), (6, "h", 4)], "expense_id int, group_id string, total_base_minor long")
    parts = split.parts_in_base(shares, paid, expense)
    got = {(r.expense_id, r.kind, r.person_id, r.payment_method_id): r.base_minor for r in parts.collect()}
    # 2 has shares of both signs, 3 nothing but zeros, 9 no expense; 6 has payments alone
    assert got == {
        (1, "consumed", "a", None): 16, (1, "consumed", "b", None): 17, (1, "paid", "a", "m1"): 33, (4, "consumed", "c", None): 100, (4, "paid", "c", "m2"): 43, (4, "paid", "d", None): 57,
        (5, "consumed", "a", None): -3, (5, "consumed", "b", None): -4, (5, "paid", "a", None): -7, (6, "paid", "a", "m1"): 4,
    }
    two = {("consumed", r.expense_id, r.person_id): r.base_minor for r in split.in_base(shares, expense, "share_minor").collect() if r.expense_id not in (2, 3)}
    two |= {("paid", r.expense_id, r.person_id): r.base_minor for r in split.in_base(paid, expense, "amount_minor").collect() if r.expense_id not in (2, 3)}
    assert two == {(k[1], k[0], k[2]): m for k, m in got.items()}
    none = spark.createDataFrame([("h", "c", "d", 5)], "group_id string, from_person string, to_person string, amount_minor long")
    found = {(r.group_id, r.person_id): r.balance for r in balances.balances_of_parts(parts, none, ["group_id"]).collect()}
    assert found == {("g", "a"): 17, ("g", "b"): -17, ("h", "a"): 0, ("h", "b"): 4, ("h", "c"): -52, ("h", "d"): 52}


def test_rates_as_of_a_day(spark):
    day = lambda n: dt.date(2024, 3, n)
    rows = [("EUR", "USD", 1, 11, "a", day(5), 1, "s"), ("EUR", "USD", 1, 12, "b", day(5), 2, "s"), ("EUR", "USD", 1, 13, "c", day(9), 1, "s"), ("EUR", "JPY", 1, 14, "d", day(9), 1, "s")]
    legs = spark.createDataFrame(rows, "base string, quote string, num long, den long, id string, rate_date date, fetched_at long, source string")
    asked = [(i, "EUR", to, d) for i, (to, d) in enumerate([("USD", day(4)), ("USD", day(5)), ("USD", day(8)), ("USD", day(8)), ("USD", day(9)), ("USD", day(30)), ("JPY", day(1)), ("GBP", day(9)), ("USD", None), (None, day(9))])]
    wanted = spark.createDataFrame(asked, "n int, from_cur string, to_cur string, day date")
    on = fx.rate_on(wanted, legs)
    assert on.columns == [*wanted.columns, "num", "den", "id", "rate_date", "fetched_at"]
    assert [r.id for r in on.orderBy("n").collect()] == [None, "b", "b", "b", "c", "c", None, None, None, None]
    assert [(r.id, r.later) for r in fx.rate_near(wanted, legs).orderBy("n").collect()][:8] == [("b", True), ("b", False), ("b", False), ("b", False), ("c", False), ("c", False), ("d", True), (None, False)]
    assert fx.rate_on(wanted, legs.limit(0)).where("id IS NOT NULL").count() == 0


def test_large_and_small_products_share_alike(spark):
    """Products beyond a bigint are made as decimals, others as bigints, with one result."""
    big = 9 * 10**17
    rows = [(1, "a", big, 7 * 10**11), (1, "b", big, 2 * 10**11), (1, "c", big, 1), (2, "a", -11, 1), (2, "b", -11, 1), (2, "c", -11, 5), (3, "a", 5, 0), (3, "b", 5, 0)]
    df = spark.createDataFrame(rows, "g int, p string, t long, w long")
    want = {}
    for g in (1, 2):
        mine = [r for r in rows if r[0] == g]
        t, every = abs(mine[0][2]), sum(r[3] for r in mine)
        base = {r[1]: t * r[3] // every for r in mine}
        turn = sorted(mine, key=lambda r: (-(t * r[3] % every), r[1]))
        for r in turn[: t - sum(base.values())]:
            base[r[1]] += 1
        want |= {(g, p): b if mine[0][2] > 0 else -b for p, b in base.items()}
    for whole in (False, True):
        got = {(r.g, r.p): r.share_minor for r in split.allocate(df, ["g"], F.col("t"), F.col("w"), ["p"], whole=whole).collect()}
        assert got == want | {(3, "a"): None, (3, "b"): None}


def test_shares_of_whole_amounts_are_sorted_as_bigints(spark):
    """Rescaled parts need no decimals: neither their remainders nor their sums."""
    df = spark.createDataFrame([(1, "a", 3 * 10**12, 10), (1, "b", 10**12, 10)], "expense_id int, person_id string, part long, target long")
    out = split.rescale(df, ["expense_id"], F.col("target"), F.col("part"), ["person_id"])
    assert {r.person_id: r.base_minor for r in out.collect()} == {"a": 8, "b": 2}  # 7.5 and 2.5: the tie goes to a


def test_converted_column_by_column_is_convert(spark):
    rows = [(i, m, n, d, a, b) for i, (m, n, d, a, b) in enumerate([(5, 1, 2, 2, 2), (15, 1, 2, 2, 2), (-5, 1, 2, 2, 2), (10**16, 12345678901, 10**10, 0, 2), (7, 10**10, 3 * 10**9, 3, 2), (0, 1, 3, 2, 2), (None, 1, 3, 2, 2), (9, None, 3, 2, 2)])]
    df = spark.createDataFrame(rows, "i int, minor long, num long, den long, a int, b int").withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("num", "den")})
    columns = [F.col(c) for c in ("minor", "num", "den", "a", "b")]
    out = money.with_converted(df, "there", *columns).withColumn("here", money.convert(*columns))
    got = [(r.there, r.here) for r in out.orderBy("i").collect()]
    assert [a for a, _ in got] == [b for _, b in got] and got[:3] == [(2, 2), (8, 8), (-2, -2)] and got[-2:] == [(None, None)] * 2
