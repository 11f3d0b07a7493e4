"""Hand-calculated cases."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import balances as bal
from ledgerloom.operators import debt_circles, split


def model_allocate(total, weights):
    scaled = [int(w * 10**6) for w in weights]
    s = sum(scaled)
    base = [abs(total) * w // s for w in scaled]
    rem = [abs(total) * w % s for w in scaled]
    for i in sorted(range(len(base)), key=lambda i: (-rem[i], i))[: abs(total) - sum(base)]:
        base[i] += 1
    return [b if total >= 0 else -b for b in base]


def test_allocation_equals_the_model_and_sums_up(spark):
    rng = random.Random(1)
    cases = [(rng.choice([0, 1, -1, 100, -997, 10**15 + 7, rng.randrange(-10**6, 10**6)]), [rng.choice([0.0, 0.5, 1.0, 1.25, 3.0]) for _ in range(rng.randrange(1, 7))]) for _ in range(300)]
    cases = [c for c in cases if sum(c[1])]
    rows = [(i, f"p{k}", t, str(w)) for i, (t, ws) in enumerate(cases) for k, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "e int, p string, t long, w string")
    got = {(r.e, r.p): r.share_minor for r in split.allocate(df, ["e"], F.col("t"), F.col("w").cast("decimal(12,6)"), ["p"]).collect()}
    for i, (t, ws) in enumerate(cases):
        shares = [got[i, f"p{k}"] for k in range(len(ws))]
        assert shares == model_allocate(t, ws) and sum(shares) == t


def test_rounding_ties_go_to_even(spark):
    df = spark.createDataFrame([("0.005", 0), ("0.015", 2), ("0.025", 2), ("-0.025", -2), ("1.2349", 123)], "a string, want long")
    assert all(r.m == r.want for r in df.select("want", money.from_major(F.col("a").cast("decimal(24,10)"), F.lit(2)).alias("m")).collect())


def test_conversion_between_exponents(spark):
    # 3000 yen at 0.00561 = 16.83 EUR; 1 dinar = 1000 fils at 3.0 = 3.00
    rows = [(3000, 56100000, 10**10, 0, 2, 1683), (1000, 3 * 10**10, 10**10, 3, 2, 300), (-5, 10**10, 2 * 10**10, 2, 2, -2), (7, 10**10, 2 * 10**10, 2, 2, 4), (1683, 10**10, 56100000, 2, 0, 3000)]
    df = spark.createDataFrame(rows, "m long, n long, d long, eb int, eq int, want long")
    got = df.select("want", money.convert(F.col("m"), F.col("n"), F.col("d"), F.col("eb"), F.col("eq")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(9 * 10**17,)], "m long")
    with pytest.raises(Exception):
        df.select(money.convert(F.col("m"), F.lit(10**12), F.lit(1), F.lit(0), F.lit(2))).collect()


def golden(spark):
    expense = spark.createDataFrame(
        [("hotel", "g", 9000, 9000, "EUR", "equal"), ("ramen", "g", 3000, 1683, "EUR", "equal"), ("taxi", "g", 1000, 1000, "EUR", "weights"), ("snack", "g", 500, 500, "USD", "equal")],
        "expense_id string, group_id string, total_minor long, total_base_minor long, base_currency string, split_mode string",
    )
    share = [(e, p, None) for e in ("hotel", "ramen", "snack") for p in ("anna", "ben", "cleo")] + [("taxi", "anna", "2"), ("taxi", "cleo", "1")]
    share = spark.createDataFrame(share, "expense_id string, person_id string, weight string").select("expense_id", "person_id", F.col("weight").cast("decimal(12,6)").alias("weight"), F.lit(None).cast("decimal(12,6)").alias("percent"), F.lit(None).cast("long").alias("amount_minor"))
    paid = spark.createDataFrame([("hotel", "anna", 9000), ("ramen", "ben", 3000), ("taxi", "cleo", 1000), ("snack", "anna", 500)], "expense_id string, person_id string, amount_minor long")
    return expense, share, paid


def test_golden_group(spark):
    expense, share, paid = golden(spark)
    group = spark.createDataFrame([("g", "EUR")], "group_id string, base_currency string")
    totals = bal.group_totals(group, expense).first()
    assert (totals.total, totals.counted, totals.skipped) == (11683, 3, 1)
    counted = expense.where("base_currency = 'EUR'")
    consumed = split.in_base(split.by_mode(counted, share), counted, "share_minor").withColumn("group_id", F.lit("g"))
    payments = split.in_base(paid, counted, "amount_minor").withColumn("group_id", F.lit("g"))
    none = spark.createDataFrame([], "group_id string, from_person string, to_person string, amount_minor long")
    member = spark.createDataFrame([("g", p) for p in ("anna", "ben", "cleo", "dan")], "group_id string, person_id string")
    found = bal.with_members(bal.balances(payments, consumed, none, ["group_id"]), member)
    assert {(r.person_id, r.paid, r.consumed, r.balance) for r in found.collect()} == {("anna", 9000, 4228, 4772), ("ben", 1683, 3561, -1878), ("cleo", 1000, 3894, -2894), ("dan", 0, 0, 0)}
    debts = bal.simplified_debts(found).orderBy("seq").collect()
    assert [(r.from_person, r.to_person, r.amount_minor) for r in debts] == [("cleo", "anna", 2894), ("ben", "anna", 1878)]


def test_transfers_settle_everyone_with_few_payments():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(2, 9)
        amounts = [rng.randrange(-500, 500) for _ in range(n - 1)]
        amounts.append(-sum(amounts))
        people = [f"p{i}" for i in range(n)]
        rows = bal.settle(people, amounts)
        left = dict(zip(people, amounts))
        for a, b, m in rows:
            assert m > 0
            left[a] += m
            left[b] -= m
        assert not any(left.values()) and len(rows) <= n - 1
    with pytest.raises(ValueError):
        bal.settle(["a"], [1])


def test_flows_keep_rows_and_columns(spark):
    rng = random.Random(9)
    share, paid = [], []

    def cut(total, k):
        ends = [0, *sorted(rng.randrange(total + 1) for _ in range(k - 1)), total]
        return [b - a for a, b in zip(ends, ends[1:])]

    for e in range(120):
        total = rng.randrange(1, 10_000)
        share += [(e, f"p{i}", x) for i, x in enumerate(cut(total, rng.randrange(1, 5)))]
        paid += [(e, f"p{i}", x) for i, x in enumerate(cut(total, rng.randrange(1, 4)))]
    kind = "expense_id int, person_id string, base_minor long"
    got = bal.expense_flows(spark.createDataFrame(share, kind), spark.createDataFrame(paid, kind)).collect()
    rows, cols = {}, {}
    for r in got:
        assert r.amount_minor > 0
        rows[r.expense_id, r.from_person] = rows.get((r.expense_id, r.from_person), 0) + r.amount_minor
        cols[r.expense_id, r.to_person] = cols.get((r.expense_id, r.to_person), 0) + r.amount_minor
    assert rows == {(e, p): x for e, p, x in share if x} and cols == {(e, p): x for e, p, x in paid if x}


def test_circles_are_cancelled(spark):
    kind = "group_id string, from_person string, to_person string, amount_minor long"
    net = spark.createDataFrame([("g", "a", "b", 10), ("g", "b", "c", 7), ("g", "c", "a", 5), ("h", "x", "y", 3)], kind)
    assert {tuple(r) for r in debt_circles.cancel_cycles(net).collect()} == {("g", "a", "b", 5), ("g", "b", "c", 2), ("h", "x", "y", 3)}


def test_itemised_split_pools_equal_holders(spark):
    expense = spark.createDataFrame([(1, 1000, "items"), (2, 900, "items")], "expense_id int, total_minor long, split_mode string")
    items = spark.createDataFrame([(1, 1, "a", 1, 101, "article", False), (1, 2, "b", 1, 101, "article", False), (1, 3, "c", 1, 300, "article", False), (1, 4, "d", 1, 25, "deposit", True)], "expense_id int, position int, text string, quantity int, total_minor long, kind string, attached boolean")
    assigned = spark.createDataFrame([(1, 1, "x", 1.0), (1, 1, "y", 1.0), (1, 2, "x", 1.0), (1, 2, "y", 1.0), (1, 3, "z", 1.0)], "expense_id int, position int, person_id string, weight double")
    people = spark.createDataFrame([(e, p, 1.0) for e in (1, 2) for p in ("x", "y", "z")], "expense_id int, person_id string, weight double")
    got = {(r.expense_id, r.person_id): r.share_minor for r in split.itemised(expense, items, assigned, people).collect()}
    # x and y share 202 evenly, z holds 325; the rest of 473 goes by 101:101:325
    assert got == {(1, "x"): 192, (1, "y"): 191, (1, "z"): 617, (2, "x"): 300, (2, "y"): 300, (2, "z"): 300}
