"""Circles of debts against a walk that begins anew after each circle."""

import random

import pandas as pd
import pytest

from ledgerloom.operators import debt_circles

KIND = "group_id int, from_person string, to_person string, amount_minor long"


def first_circle(debts):
    done = set()

    def walk(person, path):
        if person in path:
            return path[path.index(person) :]
        if person in done:
            return None
        for to in sorted(debts.get(person, {})):
            if found := walk(to, [*path, person]):
                return found
        done.add(person)
        return None

    for start in sorted(debts):
        if found := walk(start, []):
            return found
    return None


def model(rows):
    debts = {}
    for a, b, m in rows:
        debts.setdefault(a, {})[b] = m
    while ring := first_circle(debts):
        pairs = list(zip(ring, [*ring[1:], ring[0]]))
        least = min(debts[a][b] for a, b in pairs)
        for a, b in pairs:
            debts[a][b] -= least
            if not debts[a][b]:
                del debts[a][b]
    return {(a, b, m) for a, out in debts.items() for b, m in out.items()}


def random_debts(rng, people, links, most=9, apart=1):
    """One debt per pair; people of different rests modulo ``apart`` owe each other nothing."""
    pairs = {}
    for _ in range(links):
        a, b = rng.sample(range(people), 2)
        b = b - b % apart + a % apart
        if a != b and (b, a) not in pairs and b < people:
            pairs[a, b] = rng.randrange(1, most)
    return [(f"p{a:03}", f"p{b:03}", m) for (a, b), m in pairs.items()]


def test_the_walk_goes_on_where_a_new_one_would_arrive():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randrange(3, 14)
        rows = random_debts(rng, n, rng.randrange(2, 4 * n), rng.choice([2, 4, 50]))
        debts = {}
        for a, b, m in rows:
            debts.setdefault(a, {})[b] = m
        debt_circles.without_circles(debts)
        assert {(a, b, m) for a, out in debts.items() for b, m in out.items()} == model(rows), rows


def test_long_circles_end_in_time():
    n = 20_000
    debts = {f"p{i:06}": {f"p{(i + 1) % n:06}": 3} for i in range(n)}
    debts["p000000"]["p000500"] = 1  # a way across
    debt_circles.without_circles(debts)
    left = {(a, b): m for a, out in debts.items() for b, m in out.items()}
    assert len(left) == 1 and left["p000000", "p000500"] == 1


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_large_groups_are_cut_up_and_nothing_changes(spark, monkeypatch, rounds):
    rng = random.Random(rounds)
    groups = {g: random_debts(rng, 60, 150, 30, apart) for g, apart in enumerate((1, 1, 3, 4, 20))}
    groups[7] = [("a", "b", 1), ("b", "c", 1)]
    # a chain, and starts that decide where a circle is met first
    groups[8] = [("a", "d", 5), ("d", "b", 4), ("b", "c", 3), ("c", "d", 2), ("c", "b2", 1), ("b2", "b", 1), ("z", "c", 1), ("d", "y", 6)]
    rows = [(g, *r) for g, found in groups.items() for r in found]
    aside = debt_circles.set_aside
    monkeypatch.setattr(debt_circles, "set_aside", lambda df: aside(df, rounds, 0.0001))
    got = debt_circles.cancel_cycles(spark.createDataFrame(rows, KIND), split_above=2).collect()
    assert len(got) == len({tuple(r) for r in got})
    want = {(g, *r) for g, found in groups.items() for r in model(found)}
    assert {tuple(r) for r in got} == want


def test_parts_and_what_is_set_aside(spark):
    rows = [(1, "a", "b", 1), (1, "b", "c", 1), (1, "c", "a", 1), (1, "x", "y", 1), (1, "y", "w", 1), (1, "w", "x", 1), (1, "z", "x", 9), (1, "c", "q", 9), (2, "a", "y", 1)]
    aside, left = debt_circles.set_aside(spark.createDataFrame(rows, KIND))
    assert {(r.group_id, r.from_person, r.to_person) for df in aside for r in df.collect()} == {(1, "z", "x"), (1, "c", "q"), (2, "a", "y")}
    found = {(r.group_id, r.person_id): r.part for r in debt_circles.parts(left).collect()}
    assert found == {(1, p): ("a" if p in "abc" else "w") for p in "abcwxy"}
    assert debt_circles.cancel_cycles(spark.createDataFrame([], KIND)).count() == 0


def test_a_group_of_many_debts_is_one_walk(spark, monkeypatch):
    """60,000 debts need no rounds over written tables; what is on no circle never meets the walk."""
    monkeypatch.setattr(debt_circles, "set_aside", lambda *_: pytest.fail("cut up"))
    rows = [("g", f"p{i:06}", f"p{i + 1:06}", i % 7 + 1) for i in range(60_000)] + [("g", "p000003", "p000001", 2), ("g", "p000900", "p000700", 5)]
    net = spark.createDataFrame(rows, "group_id string, from_person string, to_person string, amount_minor long")
    got = {(r.from_person, r.to_person): r.amount_minor for r in debt_circles.cancel_cycles(net).collect()}
    want = {(a, b): m for _, a, b, m in rows}
    for low, high, least in ((1, 3, 2), (700, 900, 1)):
        ring = [(f"p{i:06}", f"p{i + 1:06}") for i in range(low, high)] + [(f"p{high:06}", f"p{low:06}")]
        assert min(want[k] for k in ring) == least
        want |= {k: want[k] - least for k in ring}
    assert got == {k: m for k, m in want.items() if m}


def test_debts_set_aside_in_a_task_change_nothing():
    rng = random.Random(5)
    for people, links in [(4, 6), (8, 12), (12, 20), (12, 60), (30, 40)] * 12:
        rows = random_debts(rng, people, links)
        pdf = pd.DataFrame([("g", *r) for r in rows], columns=["group_id", "from_person", "to_person", "amount_minor"])
        a, b, amount, names = debt_circles.coded(pdf)
        left = debt_circles.core(a, b)
        debts = {}
        for x, y, m in zip(a[left].tolist(), b[left].tolist(), amount[left].tolist()):
            debts.setdefault(x, {})[y] = m
        debt_circles.without_circles(debts)
        got = {(names[x], names[y], m) for x, out in debts.items() for y, m in out.items()} | {(names[x], names[y], m) for x, y, m in zip(a[~left], b[~left], amount[~left])}
        assert got == model(rows)
