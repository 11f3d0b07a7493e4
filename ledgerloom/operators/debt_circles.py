"""Debts that run in a circle cancel out.

The rule fixes which circle goes first: people start in order, everyone's creditors are
followed in order, and the first circle met is lowered by its smallest debt, until none is
left. A walk from the beginning after each circle would meet the same people again; the
walk here goes on from the first debt that a circle used up, with the same result.

Debts that lie on no circle are set aside before the walk, in one task by arrays. Groups of more
than ``split_above`` debts are cut up over all tasks first, without changing any result:

* A debt to someone who owes nothing leads to no circle. A person whom nobody owes is met
  only as a start, after all smaller people, so that their debts to smaller people lead the
  walk nowhere new. Both kinds are set aside, round by round; setting fewer of them aside
  would be right as well, so rounds end when they find little.
* What is left falls into parts that no debt connects, and a walk in one part never depends
  on another. Each part is one task's work, linear in its debts and the circles' lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import shared_path

#: A group up to this is one task's work: as numbers its debts take some 24 bytes each, and only
#: those that may lie on a circle become Python objects.
SPLIT_ABOVE = 1_000_000
#: Debts that go in a round in one task, at least, of those left.
TOO_FEW = 0.0005
#: Rounds of setting aside, at most, and the part of the debts that is worth a further one.
ROUNDS, WORTH = 20, 0.01
PAIR = ["from_person", "to_person", "amount_minor"]


def without_circles(debts: dict[str, dict[str, int]]) -> None:
    """Lower ``debts[debtor][creditor]`` in place until nothing runs in a circle."""
    creditors = {p: sorted(to) for p, to in debts.items()}
    nxt = dict.fromkeys(debts, 0)
    done: set[str] = set()  # people from whom no circle can be reached any more
    for start in sorted(debts):
        path, place = [start], {start: 0}
        while path:
            person = path[-1]
            if person not in debts or person in done:
                done.add(person)
                del place[path.pop()]
                continue
            line, i = creditors[person], nxt[person]
            while i < len(line) and (line[i] in done or line[i] not in debts[person]):
                i += 1
            nxt[person] = i
            if i == len(line):
                done.add(person)
            elif line[i] not in place:
                place[line[i]] = len(path)
                path.append(line[i])
            else:
                begin = place[line[i]]
                ring = list(zip(path[begin:], [*path[begin + 1 :], line[i]], strict=True))
                least = min(debts[a][b] for a, b in ring)
                for a, b in ring:
                    debts[a][b] -= least
                cut = next(k for k, (a, b) in enumerate(ring) if not debts[a][b])
                for a, b in ring:
                    if not debts[a][b]:
                        del debts[a][b]
                for p in path[begin + cut + 1 :]:
                    del place[p]
                del path[begin + cut + 1 :]


def coded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(debtors, creditors, amounts, people): people as numbers in their order."""
    code, people = pd.factorize(pd.concat([pdf["from_person"], pdf["to_person"]]), sort=True)
    return code[: len(pdf)], code[len(pdf) :], pdf["amount_minor"].to_numpy(np.int64), np.asarray(people, object)


def core(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which debts are left when those go that lie on no circle and don't steer the walk, by
    the rule of the module, until none goes or a round finds too few."""
    at, n = np.arange(len(a)), int(max(a.max(), b.max())) + 1 if len(a) else 0
    while len(at):
        owes, owed = (np.bincount(v[at], minlength=n) > 0 for v in (a, b))
        stays = owes[b[at]] & (owed[a[at]] | (b[at] > a[at]))
        found = len(at) - int(stays.sum())
        at = at[stays]
        if found < TOO_FEW * len(at) or not found:
            break
    return np.isin(np.arange(len(a)), at, assume_unique=True)


def _cancelled(df: DataFrame, keys: list[str]) -> DataFrame:
    """The debts of each ``keys`` without circles; one key is one task's work."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, amount, people = coded(pdf)
        left = core(a, b)
        debts: dict[int, dict[int, int]] = {}
        for x, y, m in zip(*(v[left].tolist() for v in (a, b, amount)), strict=True):
            debts.setdefault(x, {})[y] = m
        without_circles(debts)
        rest = np.array([(x, y, m) for x, out in debts.items() for y, m in out.items()], np.int64).reshape(-1, 3).T
        a, b, amount = (np.concatenate([v[~left], r]) for v, r in zip((a, b, amount), rest, strict=True))
        return pd.DataFrame({"group_id": pdf["group_id"].iloc[0], "from_person": people[a], "to_person": people[b], "amount_minor": amount})

    return df.groupBy(*keys).applyInPandas(run, f"group_id {kinds['group_id']}, from_person string, to_person string, amount_minor long")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def set_aside(debts: DataFrame, rounds: int = ROUNDS, worth: float = WORTH) -> tuple[list[DataFrame], DataFrame]:
    """Tables of debts on no circle that don't steer the walk either, and the debts left."""
    aside: list[DataFrame] = []
    left, n = debts, debts.count()
    for _ in range(rounds):
        owing = left.select("group_id", F.col("from_person").alias("to_person")).distinct().withColumn("__on", F.lit(True))
        owed = left.select("group_id", F.col("to_person").alias("from_person")).distinct().withColumn("__met", F.lit(True))
        marked = left.join(owing, ["group_id", "to_person"], "left").join(owed, ["group_id", "from_person"], "left")
        goes = F.col("__on").isNull() | (F.col("__met").isNull() & (F.col("to_person") < F.col("from_person")))
        marked = _written(marked.select("group_id", *PAIR, goes.alias("__goes")), "debts")
        found = marked.where("__goes").count()
        if found:
            aside.append(marked.where("__goes").drop("__goes"))
            left = marked.where("NOT __goes").drop("__goes")
        n -= found
        if not n or found < worth * n:
            break
    return aside, left


def parts(debts: DataFrame) -> DataFrame:
    """(group_id, person_id, part): people whom debts connect, whatever way they run, have one
    ``part``. Every round each person joins the smallest neighbour, and each such set of
    people becomes one person, until no debts between sets are left."""
    links = debts.select("group_id", F.col("from_person").alias("a"), F.col("to_person").alias("b"))
    both = lambda df: df.unionByName(df.select("group_id", F.col("b").alias("a"), F.col("a").alias("b")))
    links = _written(both(links).distinct(), "links")
    of = links.select("group_id", F.col("a").alias("person_id")).distinct().withColumn("part", F.col("person_id"))
    while not links.isEmpty():
        near = links.groupBy("group_id", "a").agg(F.min("b").alias("b")).select("group_id", F.col("a").alias("part"), F.least("a", "b").alias("to"))
        then = near.select("group_id", F.col("part").alias("to"), F.col("to").alias("__then"))
        step = _written(near.join(then, ["group_id", "to"], "left").select("group_id", "part", F.coalesce("__then", "to").alias("to")), "steps")
        of = _written(of.join(step, ["group_id", "part"], "left").select("group_id", "person_id", F.coalesce("to", "part").alias("part")), "parts")
        for end in ("a", "b"):
            links = links.join(step.withColumnRenamed("part", end), ["group_id", end]).drop(end).withColumnRenamed("to", end)
        links = _written(links.where("a <> b").select("group_id", "a", "b").distinct(), "links")
    return of


def cancel_cycles(net: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(group_id, from_person, to_person, amount_minor): ``net``, one row per pair of people,
    without circles.

    Rows of one pair in both directions must be netted before (``balances.pairwise_net``).
    ``net`` is written to the shared folder once. Groups of fewer than three debts pass by;
    groups above ``split_above`` are cut up as the module says. An empty table stays empty.
    """
    net = _written(net.select("group_id", *PAIR), "net")
    counted = net.withColumn("n", F.count("*").over(Window.partitionBy("group_id")))
    few = counted.where("n < 3").drop("n")
    small = _cancelled(counted.where(f"n >= 3 AND n <= {int(split_above)}").drop("n"), ["group_id"])
    out = few.unionByName(small)
    large = net.groupBy("group_id").agg(F.count("*").alias("n")).where(f"n >= 3 AND n > {int(split_above)}").select("group_id")
    if large.isEmpty():
        return out
    aside, left = set_aside(_written(net.join(large, "group_id", "left_semi"), "large"))
    for df in aside:
        out = out.unionByName(df.select("group_id", *PAIR))
    named = left.join(parts(left).withColumnRenamed("person_id", "from_person"), ["group_id", "from_person"])
    return out.unionByName(_cancelled(named, ["group_id", "part"]))
