"""What a receipt's text says: prices, quantities, dates, times, kinds, payment, votes.

All of it as column expressions; nothing runs in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and signs that decide what a row means.
SIGNS = {"EUR": ("€",), "JPY": ("¥", "￥", "円"), "GBP": ("£",), "USD": ("US$",), "KRW": ("₩", "원"), "INR": ("₹",), "THB": ("฿",), "TRY": ("₺",), "RUB": ("₽",), "VND": ("₫",), "PHP": ("₱",), "ILS": ("₪",), "PLN": ("zł",), "CZK": ("Kč",)}
NOT_CODES = ("ALL", "TOP", "CUP", "PEN", "TRY", "MOP", "BOB", "SOS", "BAM", "GEL", "MAD", "ANG")
UNITS = ("stück", "stk", "st", "kg", "pcs", "pc")
CASH = ("bar", "barzahlung", "bargeld", "gegeben", "bargegeben", "cash", "espèces", "especes", "efectivo", "contanti")
CARD = ("karte", "kartenzahlung", "ec", "eckarte", "eccash", "girocard", "kreditkarte", "debitkarte", "visa", "mastercard", "maestro", "vpay", "amex", "card", "credit", "debit", "carte", "tarjeta", "carta")
DEPOSIT = ("pfand", "deposit", "cauzione")
RETURNED = ("leergut", "pfandrück", "pfandruck", "pfandbon", "pfandgutschrift", "gutschein", "gutschrift", "coupon", "voucher", "rabatt", "nachlass", "preisvorteil", "discount", "クーポン", "割引", "値引")
UNTIL = ("bis", "gültig", "mhd", "valid", "until", "expires")
TILL_WORDS = {
    "de": ("summe", "zwischensumme", "gesamt", "mwst", "ust", "pfand", "leergut", "stk", "rückgeld", "gegeben", "zahlen", "betrag", "netto", "brutto", "kartenzahlung", "danke", "einkauf", "rabatt", "steuer", "bar", "zurück", "endbetrag", "stück"),
    "en": ("subtotal", "tax", "change", "cash", "thank", "you", "qty", "amount", "due", "balance", "tip", "receipt", "items", "paid", "tendered", "sales"),
    "fr": ("tva", "espèces", "especes", "merci", "montant", "rendu", "sous-total", "ttc", "ht", "prix", "articles", "monnaie", "payer"),
    "es": ("efectivo", "cambio", "gracias", "importe", "tarjeta", "factura", "base", "imponible", "entregado"),
    "it": ("totale", "contanti", "resto", "grazie", "importo", "scontrino", "subtotale", "pagamento", "documento", "commerciale"),
}
SCRIPTS = {"kana": "ぁ-ゟ゠-ヿｦ-ﾝ", "han": "一-鿿㐀-䶿", "hangul": "가-힯ᄀ-ᇿ㄰-㆏", "latin": "A-Za-zÀ-ɏ"}
SYMBOLS = "(?:€|\\$|£|¥|￥|円|₩|EUR|USD|GBP|JPY|KWD)"
MAX_DIGITS, MAX_PLAIN_YEN = 15, 7


def price(token: Column, exponent: int) -> Column:
    """Minor units of a price token of a currency with ``exponent`` decimals, or NULL.

    Signs and symbols may stand on either side, a minus in front makes it negative; one
    kind of thousands mark, other than the decimal mark; exactly the currency's decimals;
    no leading zeros; at most 15 digits, 7 in an ungrouped whole amount. With decimals a
    tax class of one or two capitals, or a star, may be glued on.
    """
    outer = rf"^{SYMBOLS}*([-−]?){SYMBOLS}*([0-9][0-9.,]*[0-9]|[0-9]){SYMBOLS}*-?{SYMBOLS}*$"
    decimals = f"[.,][0-9]{{{exponent}}}"
    shapes = [rf"[0-9]+{decimals}", rf"[0-9]{{1,3}}(?:\.[0-9]{{3}})+,[0-9]{{{exponent}}}", rf"[0-9]{{1,3}}(?:,[0-9]{{3}})+\.[0-9]{{{exponent}}}"] if exponent else [rf"[0-9]{{1,{MAX_PLAIN_YEN}}}", r"[0-9]{1,3}(?:\.[0-9]{3})+", r"[0-9]{1,3}(?:,[0-9]{3})+"]
    fits = f"^(?:{'|'.join(shapes)})$"

    def unglued(t: Column) -> Column:
        return F.when(t.rlike(r"[0-9-]\*?[A-Z]{0,2}$"), F.regexp_replace(t, r"(?<=[0-9-])\*?[A-Z]{0,2}$", "")).otherwise(t)

    def minor(body: Column) -> Column:
        def of(digits: Column) -> Column:
            good = (F.length(digits) <= MAX_DIGITS) & ~((F.length(digits) > exponent + 1) & digits.startswith("0"))
            return F.when(good, digits.try_cast("bigint"))

        return F.when(body.rlike(fits), bound(F.translate(body, ".,", ""), of))

    def signed(t: Column) -> Column:
        return bound(bound(F.regexp_extract(t, outer, 2), minor), lambda m: F.when(m.isNotNull(), F.when(t.rlike("[-−]") & (F.regexp_extract(t, outer, 1) != ""), -m).otherwise(m)))

    # most words have no digit, and no word without one is a price
    bare = lambda t: F.when(t.rlike("^[*※]"), F.regexp_replace(t, r"^[*※](?=[0-9¥￥])", "")).otherwise(t)
    whole = lambda t: bound(bound(bare(t), unglued) if exponent else bare(t), signed)
    return bound(F.trim(token), lambda t: F.when(t.rlike("[0-9]"), whole(t)))


def bound(x: Column, f) -> Column:
    """``f`` of ``x``, worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def quantity(token: Column) -> Column:
    """A quantity above 0 of up to nine digits, one decimal mark, a unit glued on."""
    bare = F.regexp_replace(F.lower(F.trim(token)), f"({'|'.join(UNITS)})$", "")
    good = bare.rlike(r"^[0-9]+([.,][0-9]+)?$") & (F.length(F.regexp_replace(bare, "[.,]", "")) <= 9)
    value = F.when(good, F.regexp_replace(bare, ",", ".")).cast("decimal(18,9)")
    return F.when(value > 0, value)


def count(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]{1,9}$"), F.nullif(F.when(token.rlike("^[0-9]{1,9}$"), token).cast("bigint"), F.lit(0)))


def keyword(token: Column) -> Column:
    """Letters only, in lower case."""
    return F.lower(F.regexp_replace(token, r"[^\p{IsAlphabetic}]", ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def _valid(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & year.rlike("^20[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _first(candidates: Column, build) -> Column:
    """The first of an array of matches that ``build`` turns into a value."""
    return F.get(F.filter(F.transform(candidates, build), lambda x: x.isNotNull()), F.lit(0))


def purchase_date(text: Column, japanese: Column, month_first: Column) -> Column:
    """The first date of a row: 2022年9月17日, 2015/03/22, 04.05.19, 12/06/2009 (day first
    unless the month would be above 12 or ``month_first``), also with an hour glued on.
    Japanese rows have no two-digit years; rows that name a validity have no date."""
    kanji = r"(?<![0-9])([0-9]{4})年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日"
    year_first = r"([0-9]{4})([./-])\s*([0-9]{1,2})\2\s*([0-9]{1,2})(?![0-9])"
    day_first = r"([0-9]{1,2})([./-])\s*([0-9]{1,2})\2\s*(?:([0-9]{4})(?=[0-9]{1,2}:|[^0-9]|$)|([0-9]{2})(?![0-9]))"
    numeric = rf"(?<![0-9.,/-])(?:{year_first}|{day_first.replace(chr(92) + '2', chr(92) + '6')})"
    part = lambda m, i: F.regexp_extract(m, numeric, i)

    def build(m: Column) -> Column:
        first, second = part(m, 5), part(m, 7)
        year = F.when(part(m, 8) != "", part(m, 8)).when(~japanese & (part(m, 9) != ""), F.concat(F.lit("20"), part(m, 9))).otherwise("")
        swap = ((second.try_cast("int") > 12) | month_first) & (first.try_cast("int") <= 12) & (second.try_cast("int") <= 31)
        return F.when(part(m, 1) != "", _valid(part(m, 1), part(m, 3), part(m, 4))).otherwise(_valid(year, F.when(swap, first).otherwise(second), F.when(swap, second).otherwise(first)))

    # the extracted match has lost its right context, which the pattern looks at; a bar closes it
    found = F.transform(F.regexp_extract_all(text, F.lit(numeric + "(?=(.?.?.?))"), F.lit(0)), lambda m: m)
    until = F.exists(words(text), lambda w: keyword(w).isin(*UNTIL)) | text.contains("期限") | text.contains("まで")
    k = lambda m: _valid(F.regexp_extract(m, kanji, 1), F.regexp_extract(m, kanji, 2), F.regexp_extract(m, kanji, 3))
    # most rows have no digit before such a mark, and no date
    return F.when(text.rlike("[0-9][年./-]"), F.when(~until, F.coalesce(_first(F.regexp_extract_all(text, F.lit(kanji), F.lit(0)), k), _first(found, build))))


def purchase_time(text: Column) -> Column:
    """The first HH:MM of a row that is no end of a range; 17時28分; none in opening hours.

    The digits before the colon are an hour of one or two, or two after a year of two or four."""
    kanji = r"([0-9]{1,2})時\s*([0-9]{1,2})\s*分"
    clock = r"(?<![0-9])(?<![-~〜～–]\s{0,3})(?:(?:[0-9]{4}|[0-9]{2})(?=[0-9]{2}[:：]))?([0-9]{1,2})[:：]([0-9]{2})(?![0-9])(?::[0-9]{2}(?![0-9]))?(?!\s*[-~〜～–])"
    def build(pattern: str):
        def f(m: Column) -> Column:
            h, n = F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)
            return F.when((h.try_cast("int") <= 23) & (n.try_cast("int") <= 59), F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(n, 2, "0")))
        return f
    found = F.coalesce(_first(F.regexp_extract_all(text, F.lit(kanji), F.lit(0)), build(kanji)), _first(F.regexp_extract_all(text, F.lit(clock), F.lit(0)), build(clock)))
    return F.when(~text.contains("営業"), found)


def names_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a word of ``text``, letters only, contains one of ``parts``."""
    either = "|".join(parts)
    return F.coalesce(F.exists(F.transform(words(text), keyword), lambda w: w.rlike(either)), F.lit(False))


def item_kind(text: Column, minor: Column, tax: Column) -> Column:
    """tax, discount (less than nothing), deposit (its first word says so and no word names
    something given back) or article; words are compared by their letters."""
    first = F.coalesce(F.get(words(text), F.lit(0)), F.lit(""))
    return F.when(tax, "tax").when(minor < 0, "discount").when(names_any(first, DEPOSIT) & ~names_any(text, RETURNED), "deposit").otherwise("article")


def vat_rate(text: Column) -> Column:
    """The first rate above 0 and below 100 of a row: 19%, 19,00%, 7 %."""
    rate = r"([0-9]+(?:[.,][0-9]+)?)\s*%"
    value = lambda m: F.regexp_replace(F.regexp_extract(m, rate, 1), ",", ".").try_cast("decimal(12,6)")
    return _first(F.regexp_extract_all(text, F.lit(rate), F.lit(0)), lambda m: F.when((value(m) > 0) & (value(m) < 100), value(m)))


# ------------------------------------------------------------------ votes over all rows of a receipt
def payment_kind(rows: DataFrame) -> DataFrame:
    """(receipt_id, payment): cash or card where the receipt names one and not both."""
    first = F.get(F.filter(F.transform(words(F.col("text")), keyword), lambda w: w != ""), F.lit(0))
    cash = F.coalesce(first.isin(*CASH), F.lit(False)) | F.col("text").contains("現金")
    card = F.coalesce(first.isin(*CARD), F.lit(False)) | F.col("text").contains("クレジット") | F.col("text").contains("カード")
    out = rows.groupBy("receipt_id").agg(F.max(cash).alias("cash"), F.max(card).alias("card"))
    return out.select("receipt_id", F.when(F.col("cash") & ~F.col("card"), "cash").when(F.col("card") & ~F.col("cash"), "card").alias("payment"))


def languages(rows: DataFrame) -> DataFrame:
    """(receipt_id, language): the script that dominates, else the language whose till words
    lead alone; NULL where nothing tells."""
    letters = lambda p: F.length("text") - F.length(F.regexp_replace("text", f"[{p}]+", ""))
    known = {w for ws in TILL_WORDS.values() for w in ws}
    low = F.filter(F.split(F.lower("text"), r"[^\p{IsAlphabetic}-]+"), lambda w: w.isin(*known))
    # most words are no till words: each row is split once, and languages share what is left
    said = rows.select("receipt_id", *[letters(p).alias(k) for k, p in SCRIPTS.items()], low.alias("low"))

    def among(ws: tuple[str, ...]):
        return lambda w: w.isin(*ws)

    hits = [F.sum(F.size(F.filter("low", among(ws)))).alias(k) for k, ws in TILL_WORDS.items()]
    df = said.groupBy("receipt_id").agg(*[F.sum(k).alias(k) for k in SCRIPTS], *hits)
    asian = F.col("kana") + F.col("han") + F.col("hangul")
    script = F.when((asian >= 2) & (asian >= F.col("latin")), F.when(F.col("hangul") > F.col("kana") + F.col("han"), "ko").when(F.col("kana") > 0, "ja").otherwise("zh"))
    best = F.greatest(*TILL_WORDS)
    lead = reduce(lambda a, b: a + b, [F.when(F.col(k) == best, 1).otherwise(0) for k in TILL_WORDS])
    winner = F.coalesce(*[F.when(F.col(k) == best, k) for k in TILL_WORDS])
    return df.select("receipt_id", F.coalesce(script, F.when((F.col("latin") >= 3) & (best > 0) & (lead == 1), winner)).alias("language"))


def currencies(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(receipt_id, currency): a vote per row and sign, word or ISO code; a unique leader
    wins, two leaders give none; a lone dollar sign is USD if nothing else votes; then
    Japanese gives JPY and Korean KRW. ``codes(code)`` is the currency dimension."""
    text = F.col("text")
    by_sign = [F.when(reduce(lambda a, b: a | b, [text.contains(s) for s in signs]), F.lit(code)) for code, signs in SIGNS.items()]
    # whole words alone: a word that is no candidate is passed over at once, as an empty match
    named = F.when(text.rlike(r"[A-Z]{3}|(?iu:euro|yen)"), F.regexp_extract_all(text, F.lit(r"([A-Z]{3}|(?iu:euros?|yen))(?!\p{IsAlphabetic})|\p{IsAlphabetic}++"), F.lit(1))).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
    free = text.rlike("[0-9]") | text.rlike(r"(?U)\A\s*\S+\s*\z")
    by_word = lambda free: F.transform(F.filter(named, lambda w: w != ""), lambda w: F.when(F.upper(w).isin("EURO", "EUROS"), "EUR").when(F.upper(w) == "YEN", "JPY").when(free & ~w.isin(*NOT_CODES), w))
    # a row is looked at once, not once a word; the outer explode keeps the votes from being worked out again for a filter
    votes = rows.select("receipt_id", F.explode_outer(F.concat(F.array(*by_sign), bound(free, by_word))).alias("code")).where("code IS NOT NULL")
    votes = votes.join(F.broadcast(codes.select("code").unionByName(rows.sparkSession.createDataFrame([(c,) for c in SIGNS], "code string")).distinct()), "code", "left_semi")
    n = votes.groupBy("receipt_id", "code").agg(F.count("*").alias("n"))
    top = n.groupBy("receipt_id").agg(F.max(F.struct("n", "code")).alias("m"), F.sort_array(F.collect_list("n"), asc=False).alias("all"))
    top = top.select("receipt_id", F.when((F.size("all") == 1) | (F.get("all", F.lit(0)) > F.get("all", F.lit(1))), F.col("m.code")).alias("code"), F.lit(True).alias("voted"))
    dollars = rows.groupBy("receipt_id").agg(F.max(text.contains("$") & ~text.contains("US$")).alias("dollar"))
    df = dollars.join(top, "receipt_id", "left").join(languages(rows), "receipt_id")
    fallback = F.when(F.col("dollar"), "USD").when(F.col("language") == "ja", "JPY").when(F.col("language") == "ko", "KRW")
    return df.select("receipt_id", F.when(F.col("voted"), F.col("code")).otherwise(fallback).alias("currency"))


def total_check(items: DataFrame, header: DataFrame) -> DataFrame:
    """(receipt_id, check, off): whether the items explain the total."""
    s = items.groupBy("receipt_id").agg(F.sum("total_minor").alias("items"))
    off = F.col("total") - F.coalesce("items", F.lit(0))
    return header.join(s, "receipt_id", "left").select("receipt_id", F.when(F.col("total").isNull(), "no_total").when(off == 0, "matches").otherwise("differs").alias("check"), F.when(F.col("total").isNotNull(), off).alias("off"))
