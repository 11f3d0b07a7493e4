"""How well receipts were read: against what is known of them, and row by row.

Odd input: a null or empty known value is not counted; a receipt that was not read counts
as read wrongly; one without known values is left out of every share.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may go wrong with a receipt, each at most once.
MISSES = ("total not found", "total wrong", "items missed", "extra items")
NOT_ARTICLES = ("discount", "tax")
#: A name on a row must be this similar; beside the row that is most like name and price, this.
SIMILAR, SURE = 0.5, 0.8


def matched(known: list[int], read: list[tuple[int, int | None]]) -> int:
    """How many known prices, in order, find a free item by its total, else by its unit
    price."""
    free, found = list(read), 0
    for price in known:
        hit = next((i for i, (total, _) in enumerate(free) if total == price), None)
        if hit is None:
            hit = next((i for i, (_, unit) in enumerate(free) if unit == price), None)
        if hit is not None:
            del free[hit]
            found += 1
    return found


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # lists of numbers side by side: no dict for each item
        known, total, unit = (batch.column(c).to_pylist() for c in ("known", "total", "unit"))
        n = [matched(k or [], list(zip(t or [], u or [], strict=True))) for k, t, u in zip(known, total, unit, strict=True)]
        sizes = [pa.array([len(x or []) for x in xs], pa.int64()) for xs in (known, total)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(n, pa.int64())], ["receipt_id", "known_items", "read_items", "found"])


def receipt_scores(truth: DataFrame, truth_items: DataFrame, parsed: DataFrame, items: DataFrame) -> DataFrame:
    """One row per receipt of truth(receipt_id, total, date, time, store, tax): what is known
    (has_*), what of it was read rightly (*_right), items known, read and found, and what
    went wrong. ``truth_items``: (receipt_id, item_no, price). ``parsed``: (receipt_id, total,
    check, date, time, store, tax). ``items``: (receipt_id, item_no, kind, total_minor,
    unit_minor)."""
    known = truth_items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("item_no", "price"))).alias("known"))
    read = items.where(~F.col("kind").isin(*NOT_ARTICLES)).groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("item_no", "total_minor", "unit_minor"))).alias("read"))
    both = truth.select("receipt_id").join(known, "receipt_id", "left").join(read, "receipt_id", "left")
    both = both.select("receipt_id", F.col("known.price").alias("known"), F.col("read.total_minor").alias("total"), F.col("read.unit_minor").alias("unit"))
    counts = both.mapInArrow(_match, "receipt_id long, known_items long, read_items long, found long")
    t, p = truth.alias("t"), parsed.alias("p")
    df = t.join(p, F.col("t.receipt_id") == F.col("p.receipt_id"), "left")
    squeezed = lambda c: F.coalesce(F.regexp_replace(c, r"\s", ""), F.lit(""))
    said, shop = squeezed("t.store"), squeezed("p.store")

    def right(has: Column, same: Column) -> Column:
        return has & F.coalesce(same, F.lit(False))

    has = {"total": F.col("t.total").isNotNull(), "date": squeezed("t.date") != "", "time": squeezed("t.time") != "", "store": said != "", "tax": F.coalesce(F.col("t.tax") > 0, F.lit(False))}
    same = {k: F.col(f"t.{k}") == F.col(f"p.{k}") for k in ("total", "date", "time")} | {"store": (shop != "") & (said.contains(shop) | shop.contains(said)), "tax": F.col("t.tax") == F.coalesce("p.tax", F.lit(0))}
    df = df.select("t.receipt_id", (F.coalesce(F.col("p.check") == "matches", F.lit(False))).alias("sums_match"), F.col("p.total").isNull().alias("__none"), *[h.alias(f"has_{k}") for k, h in has.items()], *[right(has[k], same[k]).alias(f"{k}_right") for k in has])
    df = df.join(counts, "receipt_id")
    wrong = F.filter(F.array(
        F.when(F.col("has_total") & ~F.col("total_right"), F.when(F.col("__none"), MISSES[0]).otherwise(MISSES[1])),
        F.when(F.col("found") < F.col("known_items"), MISSES[2]), F.when(F.col("read_items") > F.col("found"), MISSES[3]),
    ), lambda x: x.isNotNull())
    return df.withColumn("misses", wrong).drop("__none")


def quality_report(scores: DataFrame) -> DataFrame:
    """(measure, right, total) over :func:`receipt_scores`, in one pass; classes of misses have
    no total, and no row where nothing went wrong that way."""
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    kinds = ("total", "date", "time", "store", "tax")
    pairs = [(f"{k} right", n(f"{k}_right"), n(f"has_{k}")) for k in kinds] + [("items add up", n("sums_match"), F.count("*")), ("items found", n("found"), n("known_items")), ("items right", n("found"), n("read_items"))]
    said = [F.struct(F.lit(m).alias("measure"), F.coalesce(a, F.lit(0)).alias("right"), F.coalesce(b, F.lit(0)).alias("total")) for m, a, b in pairs]
    said += [F.struct(F.lit(m).alias("measure"), F.count_if(F.array_contains("misses", m)).alias("right"), F.lit(None).cast("bigint").alias("total")) for m in MISSES]
    return scores.agg(F.array(*said).alias("m")).select(F.explode("m").alias("m")).select("m.*").where("total IS NOT NULL OR right > 0")


# ------------------------------------------------------------------ rows as recognised
@lru_cache(1 << 14)
def plain(text: str) -> str:
    return re.sub(r"\s", "", unicodedata.normalize("NFKC", text)).lower()


def similarity(a: str, b: str) -> float:
    return _ratio(plain(a), plain(b))


@lru_cache(1 << 10)
def _against(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)


@lru_cache(1 << 16)
def _ratio(a: str, b: str) -> float:
    match = _against(b)
    match.set_seq1(a)
    return match.ratio()


def highest(a: str, others: list[str]) -> float:
    """The similarity of ``a`` to what is most like it, all plain; what its length alone keeps
    from being more like it is not compared."""
    most = 0.0
    for b in others:
        if 2 * min(len(a), len(b)) > most * (len(a) + len(b)) or not a + b:
            most = max(most, _ratio(a, b))
    return most


@lru_cache(1 << 14)
def shows_price(line: str, price: str) -> bool:
    """Whether the price is a word of the row; a blank behind a decimal mark is no gap, a tax
    class or minus may follow, up to three characters but no digit may stand in front."""
    want = plain(price)
    joined = re.sub(r"(?<=\d)([,.]) (?=\d)", r"\1", unicodedata.normalize("NFKC", line))
    for word in re.split(r"[\s円込]+", joined):
        word = plain(word).rstrip("abd-*").lstrip("¥")
        front = word[: len(word) - len(want)]
        if word.endswith(want) and len(front) <= 3 and not front[-1:].isdigit():
            return True
    return False


def name_similarity(item: str, lines: list[str]) -> float:
    """The name against each row, or against its beginning where the row is longer."""
    size = len(plain(item)) + 2
    return highest(plain(item), [p if len(p := plain(x)) <= size else plain(x[: len(item) + 4]) for x in lines])


def most_like(lines: list[str], text: str) -> str:
    """The first of the rows that is most like ``text``."""
    return max(lines, key=lambda x: similarity(x, text), default="")


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            lines, right, near = r["lines"] or [], 0, 0.0
            for i in r["items"] or []:
                name = name_similarity(i["name"], lines)
                priced = [x for x in lines if shows_price(x, i["price"])]
                right += any(similarity(i["name"], x) >= SIMILAR for x in priced) or (bool(priced) and name >= SURE and shows_price(most_like(lines, f"{i['name']} {i['price']}"), i["price"]))
                near += name
            known = r["total"] is not None and r["total"] != ""
            out.append({"receipt_id": r["receipt_id"], "n_items": len(r["items"] or []), "items_right": right, "has_total": int(known), "total_right": int(known and any(shows_price(x, r["total"]) for x in lines)), "names": near})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("receipt_id", pa.int64()), ("n_items", pa.int64()), ("items_right", pa.int64()), ("has_total", pa.int64()), ("total_right", pa.int64()), ("names", pa.float64())]))


def recognition_score(rows: DataFrame, items: DataFrame, header: DataFrame) -> DataFrame:
    """(engine, lang, items_right, n_items, totals_right, n_totals, name_similarity) of what an
    engine read, rows(receipt_id, row_no, text), against items(receipt_id, item_no, name,
    price) and header(receipt_id, engine, lang, total) as printed."""
    lines = rows.where("text IS NOT NULL").groupBy("receipt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]).alias("lines"))
    known = items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("item_no", "name", "price"))).alias("items"))
    whole = header.select(F.col("receipt_id").cast("long").alias("receipt_id"), "total").join(lines, "receipt_id", "left").join(known, "receipt_id", "left")
    scored = whole.mapInArrow(_score, "receipt_id long, n_items long, items_right long, has_total long, total_right long, names double")
    per = header.select(F.col("receipt_id").cast("long").alias("receipt_id"), "engine", "lang").join(scored, "receipt_id").groupBy("engine", "lang")
    s = per.agg(F.sum("items_right").alias("items_right"), F.sum("n_items").alias("n_items"), F.sum("total_right").alias("totals_right"), F.sum("has_total").alias("n_totals"), F.sum("names").alias("names"))
    return s.select("engine", "lang", "items_right", "n_items", "totals_right", "n_totals", (F.col("names") / F.greatest("n_items", F.lit(1))).alias("name_similarity"))
