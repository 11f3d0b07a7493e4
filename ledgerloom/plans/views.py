"""Ledger tables derived from a star schema of orders.

Each view is one SELECT that Spark and DuckDB both read; only integer division (``//``
here), day numbers and short lists crossed with a view are spelt differently. Views are lazily planned DataFrames; nothing
is cached or collected. Queries that stand on a view many times have it written once
(:meth:`Views.keep`).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import shared_path

PRICE = "cast(cast({0} as decimal(18,2)) * 100 as bigint)"
PERSON = "lpad(cast({0} as varchar(20)), 8, '0')"

SQL: dict[str, str] = {
    "currency": """
SELECT * FROM (VALUES ('EUR', 2, 'Euro', true), ('USD', 2, 'US dollar', true), ('JPY', 0, 'Yen', true), ('GBP', 2, 'Pound sterling', true), ('KWD', 3, 'Kuwaiti dinar', true), ('XAU', 0, 'Gold', false)) AS t(code, exponent, name, selectable)""",
    "grp": "SELECT n_nationkey AS group_id, 'EUR' AS base_currency, n_name AS name, n_nationkey % 6 = 5 AS archived FROM nation",
    "person": f"SELECT {PERSON.format('c_custkey')} AS person_id, c_name AS name, c_custkey = 0 AS is_me, c_custkey % 17 = 3 AS deleted, c_mktsegment AS color FROM customer",
    "member": f"""
SELECT c_nationkey AS group_id, {PERSON.format('c_custkey')} AS person_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx,
       count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer""",
    "line_item": f"""
SELECT l_orderkey AS expense_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_discount, l_tax) AS position,
       p_name AS text, cast(l_quantity AS decimal(12,6)) AS quantity,
       CASE WHEN l_returnflag = 'R' THEN -({PRICE.format('l_extendedprice')} // 10) ELSE {PRICE.format('l_extendedprice')} END AS total_minor,
       CASE l_returnflag WHEN 'A' THEN 'article' WHEN 'N' THEN 'deposit' ELSE 'discount' END AS kind,
       l_returnflag <> 'A' AND l_linenumber % 2 = 0 AS attached
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "expense": f"""
SELECT expense_id, group_id, payer, payer_idx, n, currency, occurred_date, occurred_at, category_id, placed,
       CASE WHEN mode_no = 4 AND items_total > 0 THEN items_total ELSE plain END AS total_minor,
       CASE mode_no WHEN 0 THEN 'equal' WHEN 1 THEN 'weights' WHEN 2 THEN 'percent' WHEN 3 THEN 'exact' ELSE CASE WHEN items_total > 0 THEN 'items' ELSE 'equal' END END AS split_mode
FROM (
  SELECT o_orderkey AS expense_id, m.group_id, m.person_id AS payer, m.idx AS payer_idx, m.n, {PRICE.format('o_totalprice')} AS plain, o_orderstatus AS placed,
         i.items + (o_orderkey % 7) * 100 AS items_total, (o_orderkey // 5) % 5 AS mode_no, cast(o_orderdate AS date) AS occurred_date,
         CASE o_orderkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' WHEN 3 THEN 'GBP' ELSE 'KWD' END AS currency,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS category_id,
         concat(cast(cast(o_orderdate AS date) AS varchar(10)), 'T', lpad(cast(o_orderkey % 24 AS varchar(20)), 2, '0'), ':00:00+0', cast(o_orderkey % 10 AS varchar(20)), ':00') AS occurred_at
  FROM orders JOIN [member] m ON m.person_id = {PERSON.format('o_custkey')}
  LEFT JOIN (SELECT expense_id, sum(total_minor) AS items FROM [line_item] li GROUP BY expense_id) i ON i.expense_id = o_orderkey
) x""",
    "participant": """
SELECT e.expense_id, e.group_id, m.person_id, k.k, cast(1 + ((e.expense_id + k.k) % 4) * 0.5 AS decimal(12,6)) AS weight
FROM [expense] e CROSS JOIN (VALUES (0), (1), (2)) AS k(k) JOIN [member] m ON m.group_id = e.group_id AND m.idx = (e.payer_idx + k.k) % e.n""",
    "expense_share": """
SELECT p.expense_id, p.person_id, CASE WHEN e.split_mode = 'weights' THEN p.weight END AS weight,
       CASE WHEN e.split_mode = 'percent' THEN cast(CASE p.k WHEN 0 THEN 50 WHEN 1 THEN 30 ELSE 20 END AS decimal(12,6)) END AS percent,
       CASE WHEN e.split_mode = 'exact' THEN CASE p.k WHEN 0 THEN e.total_minor - 2 * (e.total_minor // 3) ELSE e.total_minor // 3 END END AS amount_minor
FROM [participant] p JOIN [expense] e ON e.expense_id = p.expense_id""",
    "expense_payment": """
SELECT e.expense_id, m.person_id, CASE e.expense_id % 3 WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' END AS payment_method_id,
       CASE WHEN e.expense_id % 2 = 0 THEN e.total_minor WHEN k.k = 0 THEN e.total_minor - e.total_minor // 3 ELSE e.total_minor // 3 END AS amount_minor
FROM [expense] e CROSS JOIN (VALUES (0), (1)) AS k(k) JOIN [member] m ON m.group_id = e.group_id AND m.idx = (e.payer_idx + k.k) % e.n
WHERE k.k = 0 OR e.expense_id % 2 = 1""",
    "line_item_assignment": """
SELECT l.expense_id, l.position, p.person_id, cast(1 + l.position % 2 AS decimal(12,6)) AS weight
FROM [line_item] l JOIN [participant] p ON p.expense_id = l.expense_id AND p.k = l.position % 3 WHERE l.position % 3 <> 0""",
    "exchange_rate": """
SELECT concat(quote, '-', cast(rate_date AS varchar(10)), '-', cast(f.f AS varchar(20))) AS id, 'EUR' AS base, quote, rate_date,
       cast(cast(rate_num + f.f * step AS decimal(18,0)) * cast(0.0000000001 AS decimal(11,10)) AS decimal(28,10)) AS rate,
       day_no * 86400000 + f.f * 3600000 AS fetched_at, CASE WHEN day_no % 7 = 3 THEN 'backup' ELSE 'main' END AS source
FROM (
  SELECT quote, rate_date, day_no, step, start_num + ((day_no * 37) % 101) * step AS rate_num
  FROM (SELECT DISTINCT cast(o_orderdate AS date) AS rate_date, cast(DAYNO(cast(o_orderdate AS date)) AS bigint) AS day_no FROM orders WHERE o_orderkey % 3 = 0 AND cast(o_orderdate AS date) > date '1995-02-10') d
  CROSS JOIN (VALUES ('USD', 10500000000, 10000000), ('JPY', 1200000000000, 5000000000), ('GBP', 8000000000, 10000000), ('KWD', 3000000000, 5000000)) AS q(quote, start_num, step)
) r JOIN (VALUES (0), (1)) AS f(f) ON f.f = 0 OR day_no % 5 = 0""",
    "settlement": """
SELECT e.expense_id AS settlement_id, e.group_id, e.payer AS from_person, m.person_id AS to_person, e.total_minor // 10 AS amount_minor,
       CASE WHEN e.expense_id % 21 = 0 THEN 'USD' ELSE 'EUR' END AS currency, e.occurred_at, e.occurred_date
FROM [expense] e JOIN [member] m ON m.group_id = e.group_id AND m.idx = (e.payer_idx + 1) % e.n
WHERE e.placed = 'F' AND e.expense_id % 7 = 0""",
    "cash_movement": """
SELECT event_id AS id, lpad(cast(user_id AS varchar(20)), 8, '0') AS person_id,
       CASE event_id % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' WHEN 3 THEN 'GBP' ELSE 'KWD' END AS currency,
       CASE event_type WHEN 'signup' THEN 'withdrawal' WHEN 'view' THEN 'deposit' WHEN 'error' THEN 'correction' ELSE 'expense' END AS kind,
       CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END * cast(cast(value AS decimal(18,2)) * 100 AS bigint) AS amount_minor, ts AS occurred_ts
FROM events""",
    "method": """
SELECT * FROM (VALUES ('m1', 'card', 'Visa', 1.75, 50, 'EUR', false), ('m2', 'cash', 'Cash', NULL, NULL, NULL, false), ('m3', 'card', 'Old', 2.00, 0, 'USD', true)) AS t(method_id, kind, name, foreign_percent, fixed_minor, fixed_currency, archived)""",
    "wallet": f"""
SELECT concat('w', {PERSON.format('c_custkey')}) AS method_id, CASE c_custkey % 3 WHEN 0 THEN 'cash' ELSE 'card' END AS kind, concat(c_mktsegment, ' ', cast(c_custkey % 4 AS varchar(20))) AS name,
       CASE WHEN c_custkey % 29 = 4 THEN NULL ELSE {PERSON.format('c_custkey - c_custkey % 4')} END AS owner, c_custkey % 5 = 2 AS archived, c_custkey % 23 = 6 AS deleted FROM customer""",
    "category": """
SELECT p_partkey AS category_id, p_name AS name, p_size % 7 AS sort_order, p_partkey % 3 = 0 AS is_default, p_partkey % 13 = 4 AS deleted FROM part""",
    "withdrawal": """
SELECT c.id, c.person_id, c.currency, c.amount_minor, c.occurred_ts, CASE c.id % 3 WHEN 0 THEN 'm2' ELSE 'm1' END AS payment_method_id, r.id AS fx_rate_id
FROM [cash_movement] c LEFT JOIN (SELECT id, quote, row_number() OVER (PARTITION BY quote ORDER BY id) - 1 AS nth FROM [exchange_rate] x) r
ON r.nth = c.id % 40 AND c.id % 4 <> 1 AND r.quote = CASE WHEN c.currency = 'EUR' OR c.id % 8 = 3 THEN 'USD' ELSE c.currency END
WHERE c.kind = 'withdrawal'""",
    "translation": """
SELECT source_lang, target_lang, source_text, translated_text, from_user, updated_at FROM (
  SELECT CASE WHEN p_partkey % 5 < 3 THEN 'de' WHEN p_partkey % 5 = 3 THEN 'fr' ELSE 'und' END AS source_lang, 'en' AS target_lang, p_name AS source_text, concat(p_type, '-', cast(p_partkey AS varchar(20))) AS translated_text, p_partkey % 3 = 0 AS from_user, p_partkey AS updated_at,
         row_number() OVER (PARTITION BY p_partkey % 5, p_name ORDER BY p_partkey) AS r FROM part) x WHERE r <= 3""",
}
#: Written views of few bytes and much work per row: as many files as a shuffle has parts.
SPREAD = {"expense": "expense_id", "parts": "expense_id"}
#: Tables whose rows are sorted by a key, and rows that one task sorts, about.
DEALT, TASK_ROWS = {"lineitem": "l_orderkey"}, 400_000
#: Shares and payments of an expense, about.
PER_ROW = 5
PARTS = "{lineitem} JOIN {part} ON l_partkey = p_partkey"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def _spark_body(name: str) -> str:
    """A view as Spark reads it. A short list crossed with a view is exploded from it: Spark
    would put the cross join last, after a join on the group alone, which pairs each expense
    with all members of its group."""
    body = re.sub(r"//", " div ", SQL[name])
    body = re.sub(r"DAYNO\((cast\(.*? AS date\))\)", r"datediff(\1, date '1995-01-01')", body)
    if crossed := re.search(r"FROM (\[\w+\]) e CROSS JOIN \(VALUES ([^)]*\)(?:, \(\d+\))*)\) AS k\(k\)", body):
        listed = ", ".join(re.findall(r"\d+", crossed[2]))
        body = body.replace(crossed[0], f"FROM (SELECT *, explode(array({listed})) AS k FROM {crossed[1]}) e").replace("k.k", "e.k")
    return re.sub(r"\[(\w+)\]", r"{\1}", body)


def _needs(name: str) -> list[str]:
    """``name`` and all views below it, lowest first, each once."""
    out: list[str] = []
    for below in re.findall(r"\[(\w+)\]", SQL[name]):
        out += [x for x in _needs(below) if x not in out]
    return [*out, name]


def duck_with(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    order: list[str] = []
    for n in names:
        order += [x for x in _needs(n) if x not in order]
    parts = []
    for n in order:
        body = re.sub(r"\[(\w+)\]", r"\1", SQL[n])
        body = re.sub(r"DAYNO\((cast\(.*? AS date\))\)", r"date_diff('day', date '1995-01-01', \1)", body)
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts)


class Views:
    """The views over the tables of one folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._made, self._kept = spark, sf_dir, {}, set()

    def once(self, name: str, build) -> DataFrame:
        """A derived table, planned once, so that its exchanges can be reused in a query."""
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    def keep(self, *names: str) -> None:
        """Write views or derived tables to the shared folder, each once, and read them from
        there: what many parts of a query stand on is then computed and planned once. Name a
        view before those above it."""
        for name in names:
            if name not in self._kept:
                df = self._made[name] if name in self._made else getattr(self, name)
                if name in SPREAD:
                    df = df.repartition(int(self._spark.conf.get("spark.sql.shuffle.partitions")), SPREAD[name])
                path = shared_path(self._spark, name)
                df.write.parquet(path)
                self._made[name] = self._spark.read.parquet(path)
                self._kept.add(name)

    def keep_narrow(self, name: str, columns: list[str]) -> None:
        """:meth:`keep` of some columns of a view, for queries that ask for no others."""
        if name not in self._kept:
            self._made[name] = getattr(self, name).select(*columns)
            self.keep(name)

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(os.path.join(self._dir, f"{name}.parquet"))

    def dealt(self, name: str, joined: DataFrame | None = None) -> DataFrame:
        """A table, or what was ``joined`` to it, by its key, in more parts than a shuffle has
        where it is large, so that the rows a task sorts don't grow with the table. Its rows are
        counted from the footers."""
        df = self.table(name)
        parts = df.count() // TASK_ROWS
        df = df if joined is None else joined
        return df.repartition(parts, DEALT[name]) if parts > int(self._spark.conf.get("spark.sql.shuffle.partitions")) else df

    def tasks(self, name: str) -> int:
        """In how many parts the rows of a written view are sorted, some five for each of its own;
        0 where those of a shuffle are enough."""
        parts = PER_ROW * getattr(self, name).count() // TASK_ROWS
        return parts if parts > int(self._spark.conf.get("spark.sql.shuffle.partitions")) else 0

    def _small(self, df: DataFrame) -> bool:
        """Whether Spark sends ``df`` to every task for a join."""
        limit = int(self._spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        if name not in self._made:
            body = _spark_body(name)
            for t in TABLES:
                body = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", body)
            used = {k: (getattr(self, k) if k in SQL else self.dealt(k) if k in DEALT else self.table(k)) for k in set(re.findall(r"\{(\w+)\}", body))}
            if PARTS in body and not self._small(used["part"].select("p_partkey", "p_name")):
                # rows are dealt by another key for this join: they are dealt by their own after it, not twice
                body = body.replace(PARTS, "{lineitem}")
                used["lineitem"] = self.dealt("lineitem", self.table("lineitem").join(used.pop("part").select("p_partkey", "p_name"), F.expr("l_partkey = p_partkey")))
            self._made[name] = self._spark.sql(body, **used)
        return self._made[name]
