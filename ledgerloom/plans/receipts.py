"""Queries: rows, marks, keywords, context, shop and repairs of receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import receipt_marks as marks
from ..functions.money import amount_text
from ..operators import receipt_quality as quality
from ..operators import receipt_rows
from .registry import query
from .views import Views


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (1 + at % len(words)).cast("int"))


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: A name and a price for each line, 30 apart; in every fourth receipt the price column has
#: slipped by 23, which is nearer to the next name.
def _boxes(v: Views) -> DataFrame:
    p, slip = F.col("position"), F.when(F.col("expense_id") % 4 == 1, 23).otherwise(0)
    top = p * 30
    name = F.struct((p * 2).alias("idx"), F.lit(0).alias("left"), top.alias("top"), (F.lit(300) + p % 9).alias("right"), (top + 24).alias("bottom"), F.concat(F.lit("  "), "text").alias("text"))
    amount = F.struct((p * 2 + 1).alias("idx"), (F.lit(600) - p % 7).alias("left"), (top + slip + p % 3).alias("top"), F.lit(700).alias("right"), (top + slip + p % 3 + 22).alias("bottom"), amount_text(F.abs("total_minor"), F.lit(2), ",").alias("text"))
    return v.line_item.select(F.col("expense_id").alias("receipt_id"), F.explode(F.array(name, amount)).alias("b")).select("receipt_id", "b.*")


LINES = "line AS (SELECT *, count(*) OVER (PARTITION BY expense_id) AS n, expense_id % 4 = 1 AND count(*) OVER (PARTITION BY expense_id) = 1 AS apart FROM line_item)"


@query("RC1_printed_rows", "SELECT expense_id AS receipt_id, position - 1 AS row_no, 0 AS place, position * 2 AS idx FROM line UNION ALL SELECT expense_id, CASE WHEN apart THEN 1 ELSE position - 1 END, CASE WHEN apart THEN 0 ELSE 1 END, position * 2 + 1 FROM line", "line_item", LINES)
def rc1(v: Views) -> DataFrame:
    return receipt_rows.printed_rows(_boxes(v)).select("receipt_id", "row_no", "place", "idx")


@query("RC3_text_rows", "SELECT expense_id AS receipt_id, position - 1 AS row_no, trim(text) || CASE WHEN apart THEN '' ELSE ' ' || price END AS text FROM (SELECT *, (abs(total_minor) // 100) || ',' || lpad((abs(total_minor) % 100)::VARCHAR, 2, '0') AS price FROM line) UNION ALL SELECT expense_id, 1, (abs(total_minor) // 100) || ',' || lpad((abs(total_minor) % 100)::VARCHAR, 2, '0') FROM line WHERE apart", "line_item", LINES)
def rc3(v: Views) -> DataFrame:
    return receipt_rows.text_rows(_boxes(v)).select("receipt_id", "row_no", "text")


TOKENS = ("1,000込", "ロールパン200※", "2022年03月01日", "担当6", "外2¥150", "外8", "(2個)", "1中華そば", "500円", "AW", "EUR/kg", "EUR*", "不", "9,99-A", "Brot")


@query(
    "RC6_marks",
    """SELECT expense_id, position, t AS token, regexp_matches(t, '^[A-Z]{1,2}$|^(€|EUR)?/(stück|stk|st|kg|pcs|pc)$|^(€|EUR)[*]?$|^[^\\x00-\\x7F]$') AS trailing, CASE WHEN glued THEN regexp_extract(t, '[0-9][0-9.,]*') END AS amount, CASE WHEN t LIKE '外%¥%' THEN split_part(t, '¥', 2) END AS unclassed, regexp_matches(t, '^外[0-9]{0,2}$') AS class_word, CASE WHEN t LIKE '(%' THEN regexp_extract(t, '[0-9]+') WHEN regexp_matches(t, '^[0-9]{1,2}中') THEN regexp_extract(t, '^[0-9]+') END::BIGINT AS counted
FROM (SELECT *, regexp_matches(t, '^[0-9][0-9.,]*[^\\x00-\\x7F]+$') OR regexp_matches(t, '^[ァ-ヶー]+[0-9]{2,}') AS glued FROM (SELECT expense_id, position, """
    + _sql_list(TOKENS)
    + f"[1 + (expense_id + position) % {len(TOKENS)}] AS t FROM line_item))",
    "line_item",
)
def rc6(v: Views) -> DataFrame:
    t = F.col("token")
    df = v.line_item.select("expense_id", "position", _pick(TOKENS, F.col("expense_id") + F.col("position")).alias("token"))
    counted = F.coalesce(marks.bracket_count(t), marks.glued_count(t)["count"])
    return df.select("expense_id", "position", "token", marks.trailing_mark(t, F.lit("EUR")).alias("trailing"), marks.glued_amount(t)["amount"].alias("amount"), F.regexp_replace(marks.without_class(t), "^¥", "").alias("unclassed"), marks.class_word(t).alias("class_word"), counted.alias("counted"))


@query("RC7_context", """SELECT receipt_id, p < 2 OR 2 * m <= p AS trailing_minus_negates, CASE WHEN a >= 2 AND b >= 2 THEN 'A BW' WHEN a >= 2 THEN 'A' WHEN b >= 2 THEN 'BW' ELSE '' END AS tax_classes FROM (SELECT expense_id AS receipt_id, count(*) AS p, count(*) FILTER (WHERE expense_id % 3 = 0 OR position % 3 = 0) AS m, count(*) FILTER (WHERE position % 2 = 0) AS a, count(*) FILTER (WHERE position % 4 = 1) AS b FROM line_item GROUP BY 1)""", "line_item")
def rc7(v: Views) -> DataFrame:
    p, e = F.col("position"), F.col("expense_id")
    amount = F.concat(amount_text(F.abs("total_minor"), F.lit(2), ","), F.when((e % 3 == 0) | (p % 3 == 0), "-").otherwise(""))
    mark = F.when(p % 2 == 0, " A").when(p % 4 == 1, " BW").otherwise(" St")
    return marks.context(v.line_item.select(e.alias("receipt_id"), p.alias("row_no"), F.concat("text", F.lit(" "), amount, mark).alias("text")))


LEADS = {"Summe": "total", "E SUMME[": "total", "zu zahlen": "total", "Zw.-Summe": "subtotal", "Sub Total": "subtotal", "BAR:": "payment", "nanaco支払": "payment", "PayPay等": "payment", "お釣り": "change", "小 計": "subtotal", "合計 ¥330": "total", "合計点数 3点": None, "zu": None, "Zurück": "change", "言 十": "total", "": None}


@query("RC8_row_keyword", f"SELECT expense_id, position, ({_sql_list(tuple(k or '' for k in LEADS.values()))})[1 + turn] AS kind_or_none FROM (SELECT *, (expense_id + position) % {len(LEADS)} AS turn FROM line_item)", "line_item")
def rc8(v: Views) -> DataFrame:
    text = F.concat(_pick(tuple(LEADS), F.col("expense_id") + F.col("position")), F.lit(" "), "text", F.lit(" 1,99"))
    return v.line_item.select("expense_id", "position", F.coalesce(marks.row_keyword(text), F.lit("")).alias("kind_or_none"))


@query("RC12_returns", "SELECT i.expense_id AS receipt_id, position, CASE WHEN flip AND back THEN 'discount' ELSE kind END AS kind, CASE WHEN flip AND back THEN -total_minor ELSE total_minor END AS total_minor FROM (SELECT *, kind = 'article' AND total_minor > 0 AND position % 4 = 1 AS back FROM line_item) i JOIN (SELECT expense_id, expense_id % 2 = 0 AND sum(CASE WHEN kind = 'article' AND total_minor > 0 AND position % 4 = 1 THEN total_minor END) IS NOT NULL AS flip FROM line_item GROUP BY 1) f ON f.expense_id = i.expense_id", "line_item")
def rc12(v: Views) -> DataFrame:
    p, back = F.col("position"), (F.col("kind") == "article") & (F.col("total_minor") > 0) & (F.col("position") % 4 == 1)
    text = F.concat("text", F.when(p % 4 == 1, _pick((" Leergut", " GUTSCHEIN:", " Pfandrückgabe"), p)).otherwise(""))
    items = v.line_item.select(F.col("expense_id").alias("receipt_id"), "position", "kind", text.alias("text"), "total_minor", F.col("total_minor").alias("unit_minor"))
    # even receipts print what is left after returns, odd ones something else
    paid = F.sum("total_minor") - 2 * F.sum(F.when(back, F.col("total_minor")).otherwise(0))
    header = items.groupBy("receipt_id").agg(F.when(F.col("receipt_id") % 2 == 0, paid).otherwise(paid + 1).alias("total"))
    return marks.repaired_returns(items, header).select("receipt_id", "position", "kind", "total_minor")


@query("RC20_merchant", "SELECT c_custkey AS receipt_id, CASE WHEN k = 0 THEN 'Laden ' || w WHEN k = 1 THEN 'Haus ' || w WHEN k = 2 THEN w ELSE 'Großer ' || w END AS merchant FROM (SELECT c_custkey, c_custkey % 4 AS k, ['Hornung', 'Aurich', 'Kessler'][1 + c_custkey % 3] AS w FROM customer)")
def rc20(v: Views) -> DataFrame:
    k, name = F.col("c_custkey") % 4, _pick(("Hornung", "Aurich", "Kessler"), F.col("c_custkey"))
    phone = F.concat(F.lit("Tel 04941 "), F.lpad("c_custkey", 7, "0"))
    said = [
        F.array(F.lit("Frische Welt"), F.concat(F.lit("Laden  "), name), F.lit("Kiliansgraben 26"), F.lit("37355 Ort"), phone),
        F.array(phone, F.lit("Herzlich"), F.concat(F.lit("Haus "), name, F.lit(" AG & Co")), F.lit("www.haus.de")),
        F.array(F.lit("Logo"), F.concat(name, F.lit(" GmbH")), F.lit("Hauptstraße 115")),
    ]
    rows = F.when(k == 0, said[0]).when(k == 1, said[1]).when(k == 2, said[2]).otherwise(F.array(phone, F.lit("Klein"), F.concat(F.lit("Großer "), name), F.lit("Danke"), F.lit("Brot 1,99"), F.lit("Riesig")))
    df = v.table("customer").select(F.col("c_custkey").alias("receipt_id"), F.posexplode(rows).alias("row_no", "text"))
    return marks.merchants(df.withColumn("height", F.when(F.col("text").rlike("^(Gro|Ries|Danke)"), 40).otherwise(20)).withColumn("other", ~F.col("text").rlike("1,99")))


@query("RC26_quality_report", """SELECT * FROM (
SELECT 'total right' AS measure, count(*) FILTER (WHERE expense_id % 5 > 1) AS right, count(*) AS total FROM expense UNION ALL SELECT 'date right', count(*) FILTER (WHERE expense_id % 3 > 0), count(*) FROM expense
UNION ALL SELECT 'time right', 0, 0 UNION ALL SELECT 'store right', count(*), count(*) FROM expense UNION ALL SELECT 'tax right', 0, 0 UNION ALL SELECT 'items add up', count(*) FILTER (WHERE expense_id % 2 = 0), count(*) FROM expense
UNION ALL SELECT 'items found', count(*) FILTER (WHERE position % 4 > 0), count(*) FROM line_item UNION ALL SELECT 'items right', count(*) FILTER (WHERE position % 4 > 0), count(*) FROM line_item
UNION ALL SELECT 'total not found', count(*) FILTER (WHERE expense_id % 5 = 0), NULL FROM expense UNION ALL SELECT 'total wrong', count(*) FILTER (WHERE expense_id % 5 = 1), NULL FROM expense
UNION ALL SELECT 'items missed', count(DISTINCT expense_id), NULL FROM line_item WHERE position % 4 = 0 UNION ALL SELECT 'extra items', count(DISTINCT expense_id), NULL FROM line_item WHERE position % 4 = 0)""", "expense line_item")
def rc26(v: Views) -> DataFrame:
    e, p = F.col("expense_id"), F.col("position")
    truth = v.expense.select(e.alias("receipt_id"), F.col("total_minor").alias("total"), F.col("occurred_date").cast("string").alias("date"), F.lit("").alias("time"), F.lit("Haus Hornung").alias("store"), F.lit(0).cast("bigint").alias("tax"))
    parsed = v.expense.select(e.alias("receipt_id"), F.when(e % 5 == 1, F.col("total_minor") + 1).when(e % 5 > 1, F.col("total_minor")).alias("total"), F.when(e % 2 == 0, "matches").otherwise("differs").alias("check"), F.when(e % 3 > 0, F.col("occurred_date").cast("string")).alias("date"), F.lit(None).cast("string").alias("time"), F.lit("Hornung").alias("store"), F.lit(None).cast("bigint").alias("tax"))
    price = 1000 + p
    known = v.line_item.select(e.alias("receipt_id"), p.alias("item_no"), price.cast("bigint").alias("price"))
    # every fourth price is misread, every second of the others stands as the unit price
    total = F.when(p % 4 == 0, -price).when(p % 2 == 0, 2 * price + 100_000).otherwise(price)
    read = v.line_item.select(e.alias("receipt_id"), p.alias("item_no"), F.lit("article").alias("kind"), total.cast("bigint").alias("total_minor"), F.when((p % 2 == 0) & (p % 4 > 0), price).cast("bigint").alias("unit_minor"))
    return quality.quality_report(quality.receipt_scores(truth, known, parsed, read))


@query("RC27_recognition", "SELECT CASE WHEN e.expense_id % 2 = 0 THEN 'one' ELSE 'two' END AS engine, CASE WHEN e.expense_id % 3 = 0 THEN 'ja' ELSE 'de' END AS lang, sum(coalesce(i.r, 0))::BIGINT AS items_right, sum(coalesce(i.k, 0))::BIGINT AS n_items, count(*) FILTER (WHERE e.expense_id % 5 > 0 AND i.k IS NOT NULL) AS totals_right, count(*) FILTER (WHERE e.expense_id % 7 > 0 OR i.k IS NOT NULL) AS n_totals FROM expense e LEFT JOIN (SELECT expense_id, count(*) AS k, count(*) FILTER (WHERE position % 4 > 0) AS r FROM line_item GROUP BY 1) i ON i.expense_id = e.expense_id GROUP BY 1, 2", "expense line_item")
def rc27(v: Views) -> DataFrame:
    e, p = F.col("expense_id"), F.col("position")
    price = F.concat((p + 10).cast("string"), F.lit(",95"))
    items = v.line_item.select(e.alias("receipt_id"), p.alias("item_no"), F.concat("text", F.lit(" im Glas")).alias("name"), price.alias("price"))
    lines = v.line_item.select(e.alias("receipt_id"), p.alias("row_no"), F.concat("text", F.lit(" im Glas "), F.when(p % 4 == 0, "?").otherwise(F.concat(F.regexp_replace(price, ",", ", "), F.lit(" A")))).alias("text"))
    sums = v.line_item.select(e.alias("receipt_id")).distinct().select("receipt_id", F.lit(0).alias("row_no"), F.when(F.col("receipt_id") % 5 > 0, "SUMME ¥1,234円").otherwise("SUMME").alias("text"))
    lined = v.line_item.select(e.alias("receipt_id"), F.lit(True).alias("lined")).distinct()
    header = v.expense.select(e.alias("receipt_id"), F.when(e % 2 == 0, "one").otherwise("two").alias("engine"), F.when(e % 3 == 0, "ja").otherwise("de").alias("lang")).join(lined, "receipt_id", "left")
    header = header.select("receipt_id", "engine", "lang", F.when((F.col("receipt_id") % 7 > 0) | F.col("lined"), "1,234").alias("total"))
    return quality.recognition_score(lines.unionByName(sums), items, header).drop("name_similarity")
