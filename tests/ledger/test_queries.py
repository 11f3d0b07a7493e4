"""Registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["MON1_from_major", "FX3_chain", "FX9_money_text", "FXR4_rate_near", "FXR6_resolve", "FXR7_crossed_history", "FXR8_convert_expenses", "SPL2_rescale", "SPL9_itemised", "SPL15_split_line", "BAL2_summary", "BAL5_expense_flows", "AGG1_by_category", "AGG5_arcs", "TL1_timeline", "TL3_search", "CASH2_counterpart", "WIN6_count_corrections", "JN10_full_outer", "SET5_toggle", "VAL1_payments", "TM1_lookup", "SRC2_rate_rows", "SRC5_fragments_tsv", "SRC7_truth", "SRC8_records", "ST1_rate_ingest", "ST2_live_conversion", "JN7_self_join", "JN8_as_of", "JN12_shared_elements", "WIN4_nearest_above", "ST3_cash_balances", "SNK1_archive", "RC9_lines", "RC10_receipts", "RC11_added_tax", "RC12_yen_marks", "RC12_counts_as_yen", "RC12_misread_price", "RC12_above_date", "RC13_item_kind", "RC14_attach", "RC15_lone_amounts", "RC17_vat_lines", "FLT2_own_methods", "FLT7_card_fits", "FLT3_active_group", "SRT6_methods", "SRT6_all_methods", "SRT7_categories", "WIN3_method_by_kind", "WIN10_time_of_dated_row", "TL7_method_statement", "TL7_method_payments", "FXR7_history", "FXR7_all_pairs", "VAL7_foreign_participants", "VAL7_dead_categories", "VAL7_receipts_held_twice"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(_key(r[n] for n in names) for r in df.collect()) == sorted(_key(r) for r in want.fetchall())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)


def test_invariants_of_debts(spark):
    q = entry.queries()
    balance = {(r.group_id, r.person_id): r.balance for r in q["BAL1_balances"](spark, SF).collect()}
    for name in ("BAL4_simplified_debts", "BAL8_pairwise_debts"):
        left = dict(balance)
        for r in q[name](spark, SF).collect():
            assert r.amount_minor > 0
            left[r.group_id, r.from_person] += r.amount_minor
            left[r.group_id, r.to_person] -= r.amount_minor
        assert not any(left.values())
