"""Balances, rankings, debts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .debt_circles import cancel_cycles


def balances_of_parts(parts: DataFrame, settlements: DataFrame, keys: list[str]) -> DataFrame:
    """paid, consumed, settled_out, settled_in and balance per ``keys`` and person.

    ``parts`` has (keys, person_id, kind, base_minor), ``kind`` being ``paid`` or ``consumed``;
    ``settlements`` (keys, from_person, to_person, amount_minor). One union, one shuffle,
    partial sums first.
    """
    kinds = ("paid", "consumed", "settled_out", "settled_in")

    def side(person: str, kind: str) -> DataFrame:
        return settlements.select(*keys, F.col(person).alias("person_id"), F.lit(kind).alias("kind"), F.col("amount_minor").cast("bigint").alias("base_minor"))

    every = parts.select(*keys, "person_id", "kind", F.col("base_minor").cast("bigint").alias("base_minor")).unionByName(side("from_person", "settled_out")).unionByName(side("to_person", "settled_in"))
    zero = F.lit(0).cast("bigint")
    out = every.groupBy(*keys, "person_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("base_minor")).otherwise(zero)).alias(k) for k in kinds])
    return out.withColumn("balance", F.col("paid") - F.col("consumed") + F.col("settled_out") - F.col("settled_in"))


def balances(paid: DataFrame, consumed: DataFrame, settlements: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`balances_of_parts` where paid and consumed are two tables of (keys, person_id,
    base_minor)."""
    part = lambda df, kind: df.select(*keys, "person_id", F.lit(kind).alias("kind"), "base_minor")
    return balances_of_parts(part(paid, "paid").unionByName(part(consumed, "consumed")), settlements, keys)


def with_members(found: DataFrame, member: DataFrame) -> DataFrame:
    """All members, also those without spending, and spenders who left."""
    zeros = {c: 0 for c in ("paid", "consumed", "settled_out", "settled_in", "balance")}
    return found.join(member.select("group_id", "person_id"), ["group_id", "person_id"], "full_outer").fillna(zeros)


def group_totals(group: DataFrame, expense: DataFrame) -> DataFrame:
    """(group_id, total, counted, skipped): expenses in another base currency are skipped
    and counted, never converted again."""
    df = group.select("group_id", F.col("base_currency").alias("own")).join(expense.select("group_id", "base_currency", "total_base_minor"), "group_id", "left")
    same = F.col("base_currency") == F.col("own")
    return df.groupBy("group_id").agg(
        F.coalesce(F.sum(F.when(same, F.col("total_base_minor"))), F.lit(0)).alias("total"),
        F.count(F.when(same, 1)).alias("counted"), F.count(F.when(F.col("base_currency").isNotNull() & ~same, 1)).alias("skipped"),
    )


def rankings(found: DataFrame) -> DataFrame:
    """Add ``paid_rank`` (paid most first) and ``owes_rank`` (lowest balance first), ties by person."""
    w = Window.partitionBy("group_id")
    return found.withColumn("paid_rank", F.row_number().over(w.orderBy(F.desc("paid"), "person_id"))).withColumn("owes_rank", F.row_number().over(w.orderBy("balance", "person_id")))


# ------------------------------------------------------------------ debts
def settle(people: list[str], amounts: list[int]) -> list[tuple[str, str, int]]:
    """Transfers that settle all: the largest debtor pays the largest creditor, ties by
    person, until nothing is owed; at most one fewer than people."""
    import heapq

    if sum(amounts):
        raise ValueError("balances don't sum to zero")
    owed = [(-a, p) for p, a in zip(people, amounts, strict=True) if a > 0]
    owes = [(a, p) for p, a in zip(people, amounts, strict=True) if a < 0]
    heapq.heapify(owed)
    heapq.heapify(owes)
    out = []
    while owed:
        (c, creditor), (d, debtor) = heapq.heappop(owed), heapq.heappop(owes)
        pay = min(-c, -d)
        out.append((debtor, creditor, pay))
        if -c > pay:
            heapq.heappush(owed, (c + pay, creditor))
        if -d > pay:
            heapq.heappush(owes, (d + pay, debtor))
    return out


TRANSFERS = "{0}, seq int, from_person string, to_person string, amount_minor long"


def simplified_debts(found: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, seq, from_person, to_person, amount_minor). One group is one task's work: what
    arrives is already one row per person with a balance."""
    kind = dict(found.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = settle(pdf["person_id"].tolist(), [int(x) for x in pdf["balance"]])
        return pd.DataFrame([(pdf[key].iloc[0], i, *r) for i, r in enumerate(rows)], columns=[key, "seq", "from_person", "to_person", "amount_minor"])

    return found.where("balance <> 0").select(key, "person_id", "balance").groupBy(key).applyInPandas(run, TRANSFERS.format(f"{key} {kind}"))


def expense_flows(share: DataFrame, payment: DataFrame) -> DataFrame:
    """(expense_id, from_person, to_person, amount_minor): each share owed to the payers in
    proportion to what they paid.

    Whole units first; the cents left over by rows (sharers) meet those left over by
    columns (payers) in person order, as overlaps of their cumulative ranges. ``share``
    and ``payment`` have (expense_id, person_id, base_minor), all >= 0 with equal sums > 0.
    """
    part = lambda df, kind: df.select("expense_id", "person_id", F.lit(kind).alias("kind"), "base_minor")
    return flows_of_parts(part(share, "consumed").unionByName(part(payment, "paid")), ["expense_id"])


FITS = (1 << 63) - 1


def _cells(owed: np.ndarray, paid: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sharer, payer, amount) of every cell of expenses with ``n`` sharers and ``m`` payers,
    whose amounts stand in ``owed`` and ``paid`` one after the other."""
    count = n * m
    of, begin = np.repeat(np.arange(len(n)), count), np.cumsum(count) - count
    at, s0, p0 = np.arange(len(of)) - begin[of], np.cumsum(n) - n, np.cumsum(m) - m
    total = np.add.reduceat(paid, p0) if len(m) else paid
    whole = lambda s, p: owed[s] * paid[p] // total[of]
    # cells by sharer, and by payer, for the sums of rows and columns
    s, p = s0[of] + at // m[of], p0[of] + at % m[of]
    cell = whole(s, p)
    row_left = owed - np.add.reduceat(cell, np.cumsum(per := np.repeat(m, n)) - per)
    by_payer = whole(s0[of] + at % n[of], p0[of] + at // n[of])
    col_left = paid - np.add.reduceat(by_payer, np.cumsum(per := np.repeat(n, m)) - per)

    def ends(left: np.ndarray, first: np.ndarray, k: np.ndarray) -> np.ndarray:
        run = np.cumsum(left)
        return run - np.repeat(run[first] - left[first], k)

    row_end, col_end = ends(row_left, s0, n), ends(col_left, p0, m)
    extra = np.minimum(row_end[s], col_end[p]) - np.maximum((row_end - row_left)[s], (col_end - col_left)[p])
    return s, p, cell + np.maximum(extra, 0)


def _people(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(people of each list, who they are, their amounts); lists are in order of people, one
    who comes again is counted together."""
    n, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    who, minor = flat.field("person_id"), flat.field("base_minor").to_numpy(zero_copy_only=False)
    code, of = who.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    if len(new) == len(of):
        return n, who, minor
    return np.bincount(of[new], minlength=len(n)), who.take(pa.array(new)), np.add.reduceat(minor, new)


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        (n, who, owed), (m, to, paid) = (_people(batch.column(k)) for k in ("owes", "pays"))
        if int(owed.max()) * int(paid.max()) > FITS:
            owed, paid = owed.astype(object), paid.astype(object)
        s, p, amount = _cells(owed, paid, n, m)
        keep = np.flatnonzero(amount != 0)
        of, s, p = np.repeat(np.arange(len(n)), n * m)[keep], pa.array(s[keep]), pa.array(p[keep])
        names = [k for k in batch.schema.names if k not in ("owes", "pays")]
        columns = [batch.column(k).take(pa.array(of)) for k in names] + [who.take(s), to.take(p), pa.array(amount[keep].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, [*names, "from_person", "to_person", "amount_minor"])


def flows_of_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`expense_flows` of parts(``keys``, person_id, kind, base_minor), ``kind`` being
    ``paid`` or ``consumed``; ``keys`` are expense_id and columns that hang on it. Expenses that
    have no proportions (a part that is negative or NULL, or nothing but zeros) have no flows.

    People of one expense are few: they meet as two lists, with one shuffle, and the cells of
    a batch of expenses are worked out side by side.
    """
    minor = F.col("base_minor").cast("bigint")
    entry = F.struct("person_id", minor.alias("base_minor"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    lists = parts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(of("consumed", entry))).alias("owes"), F.sort_array(F.collect_list(of("paid", entry))).alias("pays"), F.max(minor.isNull()).alias("lost"),
        F.min(minor).alias("low"), F.sum(of("consumed", minor)).alias("owed"), F.sum(of("paid", minor)).alias("paid"),
    ).where("NOT lost AND low >= 0 AND owed > 0 AND paid > 0").select(*keys, "owes", "pays")
    kinds = dict(lists.dtypes)
    return lists.mapInArrow(_flows, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "from_person string, to_person string, amount_minor long"]))


def flow_fallback(share: DataFrame, payment: DataFrame) -> DataFrame:
    """Flows of expenses that have no proportions (total <= 0 or a negative part): the
    simplified transfers of that one expense. Few people share an expense, so the expenses
    of a batch are settled in one call."""
    net = share.select("expense_id", "person_id", (-F.col("base_minor")).alias("b")).unionByName(payment.select("expense_id", "person_id", F.col("base_minor").alias("b")))
    found = net.groupBy("expense_id", "person_id").agg(F.sum("b").alias("balance")).where("balance <> 0")
    lists = found.groupBy("expense_id").agg(F.collect_list("person_id").alias("people"), F.collect_list("balance").alias("amounts"))
    kind = dict(found.dtypes)["expense_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(e, *r) for e, people, amounts in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in settle(people, amounts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.string(), pa.string(), pa.int64()), strict=True)], ["expense_id", "from_person", "to_person", "amount_minor"])

    return lists.mapInArrow(run, f"expense_id {kind}, from_person string, to_person string, amount_minor long")


def pairwise_net(flows: DataFrame, settlements: DataFrame) -> DataFrame:
    """(group_id, from_person, to_person, amount_minor): opposite debts netted; a settlement
    from A to B counts as B owing A."""
    owed = flows.select("group_id", "from_person", "to_person", "amount_minor").unionByName(
        settlements.select("group_id", F.col("to_person").alias("from_person"), F.col("from_person").alias("to_person"), "amount_minor")
    )
    low, high = F.least("from_person", "to_person"), F.greatest("from_person", "to_person")
    sign = F.when(F.col("from_person") == low, F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    net = owed.where("from_person <> to_person").groupBy("group_id", low.alias("low"), high.alias("high")).agg(F.sum(sign).alias("net")).where("net <> 0")
    up = F.col("net") > 0
    return net.select("group_id", F.when(up, F.col("low")).otherwise(F.col("high")).alias("from_person"), F.when(up, F.col("high")).otherwise(F.col("low")).alias("to_person"), F.abs("net").alias("amount_minor"))


def pairwise_debts(flows: DataFrame, settlements: DataFrame) -> DataFrame:
    return cancel_cycles(pairwise_net(flows, settlements))
