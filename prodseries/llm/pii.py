"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

A pattern's matches are marked in the text, which is then split at the marks: so every match is known with its position
and with the text around it after one pass, without copying the text for each match. All patterns take linear time on
any text: a repeated class never gives back what it took (or, for IBANs, at most the 34 characters of one), and no match
starts inside a run that was tried before.

IBANs end where the length of their country says. Where that gives no match, or for other country codes, the longest
run of groups that ends at a word boundary counts; for other codes also a shorter one, the longest that passes mod-97.

Offsets count code points, the end is exclusive. Cases: a null text counts as empty; a null doc_id is kept; repeated rows
give equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A code point that no pattern mentions marks the matches; one of the text's own becomes its neighbour.
MARK, OTHER = "\U0010FFFF", "\U0010FFFE"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _groups(size: int) -> str:
    """So many letters and digits, with a blank or none before each fourth."""
    rest = rf"\x20?[A-Z0-9]{{{size % 4}}}" if size % 4 else ""
    return rf"(?:\x20?[A-Z0-9]{{4}}){{{size // 4}}}{rest}(?![A-Za-z0-9])"


#: A start is looked at first, so that the countries are tried only there.
IBAN = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}{_groups(n - 4)}" for n, codes in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
)
#: kind: (pattern, a text without this has no match, score, words nearby that support it)
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, r"\b(e-?mail|mail|contact|correo|courriel|kontakt)",
    ),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".", 0.6, r"\b(ip|host|server|address|addr|login|from)\b",
    ),
    # a whole run of digits, with at most one blank or hyphen between two, of 16 to 19 digits
    "card": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        "", 0.7, r"\b(card|credit|visa|mastercard|amex|tarjeta|karte|carte)",
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+", 0.6, r"\b(phone|tel|call|mobile|fax|telefon|teléfono)",
    ),
    "iban": (
        IBAN,
        "", 0.9, r"\b(iban|account|konto|bank|compte|cuenta)",
    ),
}
BASE = ("email", "ip", "card", "phone")
#: Code points looked at before and after a span, and what a supporting word adds.
BEFORE, AFTER, SUPPORT = 48, 24, 0.1
#: Parts whose running sums are made in one go.
BLOCK = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(turned, i, F.lit(1))) - 48
        twice = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits, their first four moved to the end, leave 1 when divided by 97."""
    compact = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))

    def left_over(turned: Column) -> Column:
        def step(rest: Column, i: Column) -> Column:
            code = F.ascii(F.substring(turned, i, F.lit(1)))
            return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)

    return F.get(F.transform(F.array(turned), left_over), F.lit(0)) == 1  # transform(), so that it is turned once


def iban_ends(value: Column) -> Column:
    """The lengths at which a match passes mod-97: all of it, for a code of no known country also ends at a blank; longest first."""
    whole = F.array(F.length(value))
    blanks = F.filter(F.sequence(F.length(value) - 1, F.lit(12), F.lit(-1)), lambda i: F.substring(value, i + 1, F.lit(1)) == " ")
    known = F.left(value, F.lit(2)).isin(" ".join(IBAN_LENGTHS.values()).split())
    return F.filter(F.when(known, whole).otherwise(F.concat(whole, blanks)), lambda i: mod97(F.left(value, i)))


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return F.size(iban_ends(value)) > 0
    return F.lit(True)


def offsets(lengths: Column) -> Column:
    """Where each part starts: running sums, in blocks so that long lists do not take quadratic time."""
    none = F.array(F.lit(0))

    def summed(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    last_block = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last_block), lambda b: summed(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    bases = F.aggregate(blocks, none, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(s, -1))))
    return F.flatten(F.transform(blocks, lambda s, b: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + F.get(bases, b))))


def _parts(text: Column, kind: str) -> Column:
    """The text split at its matches: every second part is a match."""
    pattern, needs, _, _ = KINDS[kind]
    marked = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(F.contains(text, F.lit(needs)), marked) if needs else marked


def _spans(kind: str) -> Column:
    """The confirmed matches of the column `<kind>_parts`, with offsets in `<kind>_at`."""
    _, _, score, support = KINDS[kind]
    parts, at = F.col(f"{kind}_parts"), F.col(f"{kind}_at")

    def span(i: Column) -> Column:
        value, start = F.get(parts, i), F.get(at, i)
        around = F.lower(F.concat(F.right(F.get(parts, i - 1), F.lit(BEFORE)), F.lit(" "), F.left(F.get(parts, i + 1), F.lit(AFTER))))
        supported = F.when(around.rlike(support), score + SUPPORT).otherwise(score)
        length = F.get(iban_ends(value), F.lit(0)) if kind == "iban" else F.length(value)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + length).alias("end"), supported.alias("score"))

    matches = F.filter(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: confirmed(kind, F.get(parts, i)))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.size(parts) > 2, F.transform(matches, span)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """docs with one more column `found`: for each kind its spans (kind, start, end, score), in order."""
    row = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    parts = row.select("row", *(_parts(F.col("text"), k).alias(f"{k}_parts") for k in KINDS))
    lengths = [F.when(F.size(f"{k}_parts") > 2, F.transform(f"{k}_parts", F.length)).alias(f"{k}_len") for k in KINDS]
    at = [F.when(F.size(f"{k}_parts") > 2, offsets(F.col(f"{k}_len"))).alias(f"{k}_at") for k in KINDS]
    spans = parts.select("*", *lengths).select("*", *at).select("row", F.struct(*(_spans(k).alias(k) for k in KINDS)).alias("found"))
    return spans.select("row.*", "found")


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, joined by commas."""
    spans = F.concat(*(found[k] for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, top_score for each document."""
    found = F.col("found")
    best = F.array_max(F.transform(F.concat(*(found[k] for k in KINDS)), lambda s: s["score"]))
    return find(docs.select("doc_id", "text")).select(
        "doc_id", *(F.size(found[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(found, BASE), 256).alias("base_sha256"), listed(found, tuple(KINDS)).alias("spans"),
        F.coalesce(best, F.lit(0.0)).alias("top_score"),
    )


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap as one; it takes the kind of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, none, add)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; n_chars, if there, follows the text."""
    whole = find(docs.select(F.struct("*").alias("row"), "text"))
    spans = whole.select("row", "text", _merged(F.concat(*(F.col("found")[k] for k in KINDS))).alias("spans"))
    cuts = F.col("spans")

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
        return F.concat(F.substring("text", before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    rest = F.substring("text", F.element_at(cuts, -1)["end"] + 1, F.length("text"))
    changed = F.when(F.size(cuts) > 0, F.concat(F.array_join(F.transform(cuts, piece), ""), rest)).otherwise(F.col("text"))
    new = spans.select("row", changed.alias("text"), (F.size(cuts) > 0).alias("changed"))
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return new.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
