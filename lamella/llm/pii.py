"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.  Column functions only.

Kinds and what confirms a match (but for ``iban``, a match that fails is dropped and not tried again from a later character):

- ``email``; ``ip`` (four parts, each at most 255); ``card`` (14 to 19 digits that pass the Luhn test);
  ``phone`` (after a plus sign, 10 to 15 digits): these are kept whatever their score.
- ``iban`` (mod-97 is 1), ``ssn`` and ``phone_local`` (no checksum): kept where the score reaches ``threshold``;
  the last two do so only with a telling word in the 48 characters before them.  An IBAN is sought from every place where
  one may begin; of what follows, in groups parted by one space, it takes as many whole groups as give its country's length, or
  else the most that pass mod-97 with 15 to 34 characters.

The patterns are written so that a run of characters is entered at its start alone and never given back, which keeps
matching linear in the length of the text, and free of deep recursion, whatever the text.

Positions are in code points, end exclusive.  Cases: null or empty text has no spans; texts of any length are searched whole;
a U+0001 in a text, which marks matches internally, is taken for U+0002, which no pattern contains; rows that
repeat and null ids get a result each; other columns pass through, of the same name as a result's they are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_local")
BASE = KINDS[:4]

#: kind: (pattern, condition that a text with a match fulfils)
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])",  # where one may begin
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: whole groups of capitals and digits
_GROUPS = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: telling words before a span, matched in lower case
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write)",
    "ip": r"\b(?:ip|host|server|address|client)",
    "card": r"\b(?:card|visa|credit|debit|payment|karte|carte|tarjeta)",
    "phone": r"\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)",
    "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"\b(?:ssn|social security)",
    "phone_local": r"\b(?:phone|tel|call|mobile|fax)",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "phone_local": 0.3}
CONTEXT_GAIN, CONTEXT_CHARS = 0.3, 48


def _has(text: Column, kind: str) -> Column:
    """A cheap condition that every text with a match fulfils."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike({"ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "phone_local": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"}[kind])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder by 97 of an IBAN (capitals and digits, no spaces), as ISO 13616 reads it."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "ssn":
        return ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return F.lit(True)


def _solid(iban: Column) -> Column:
    return F.replace(iban, F.lit(" "), F.lit(""))


def _ibans(text: Column) -> Column:
    """array<struct<start, end, match>> of the IBANs."""
    pieces = F.split(F.regexp_replace(text, PATTERNS["iban"], f"{MARK}$0"), MARK, -1)
    none = F.array().cast("array<long>")
    begin = F.struct(F.lit(-1).cast("long").alias("at"), none.alias("out"))
    # what is before the first place, and then each place up to the next
    places = F.aggregate(
        pieces,
        begin,
        lambda acc, piece: F.struct((F.greatest(acc["at"], F.lit(0)) + F.length(piece)).alias("at"), F.when(acc["at"] < 0, acc["out"]).otherwise(F.array_append(acc["out"], acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    own = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for c in codes.split() for x in (c, n)])

    def best(at):
        # 34 characters, a space between any two, and what comes next
        groups = F.split(F.regexp_extract(F.substring(text, (at + 1).cast("int"), F.lit(69)), _GROUPS, 0), " ")
        heads = F.transform(groups, lambda g, k: F.array_join(F.slice(groups, 1, k + 1), " "))
        valid = F.filter(heads, lambda m: F.when(F.length(_solid(m)).between(15, 34), mod97(_solid(m)) == 1).otherwise(F.lit(False)))
        return F.aggregate(valid, F.lit(None).cast("string"), lambda acc, m: F.when(F.length(_solid(acc)) == F.try_element_at(own, F.substring(acc, 1, 2)), acc).otherwise(m))

    spans = F.filter(F.transform(places, lambda at: F.struct(at.alias("start"), best(at).alias("match"))), lambda s: s["match"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,match:string>>").alias("out"))

    def step(acc, s):
        end = s["start"] + F.length(s["match"])
        span = F.struct(s["start"].alias("start"), end.alias("end"), s["match"].alias("match"))
        new = s["start"] >= acc["at"]
        return F.struct(F.when(new, end).otherwise(acc["at"]).alias("at"), F.when(new, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def _found(text: Column, kind: str, threshold: float) -> Column:
    """array<struct<start, order, end, kind, score, match>> of one kind, by start."""
    order = KINDS.index(kind)
    pieces = F.split(F.regexp_replace(text, f"(?:{PATTERNS[kind]})", f"{MARK}$0{MARK}"), MARK, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("within"), F.array().cast("array<struct<start:long,end:long,match:string>>").alias("out"))

    def step(acc, piece):
        end = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("match"))
        return F.struct(end.alias("at"), (~acc["within"]).alias("within"), F.when(acc["within"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    if kind == "iban":
        spans = _ibans(text)
    else:
        spans = F.filter(F.aggregate(pieces, start, step, lambda acc: acc["out"]), lambda s: _confirmed(kind, s["match"]))

    def scored(s):
        before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT_CHARS)).cast("int")))
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)))
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"), s["match"].alias("match"))

    out = F.transform(spans, scored)
    if kind not in BASE:
        out = F.filter(out, lambda s: s["score"] >= threshold)
    empty = F.array().cast("array<struct<start:long,order:int,end:long,kind:string,score:double,match:string>>")
    return F.when(_has(text, kind), out).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.55) -> DataFrame:
    """``docs`` with ``pii``: array<struct<start, order, end, kind, score, match>> by start, then kind as listed."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit("\u0002"))
    return docs.withColumn("pii", F.array_sort(F.concat(*[_found(text, k, threshold) for k in KINDS])))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.55) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; spans that overlap become one.  A null text stays null."""
    # ``pii`` may be a column of the input's own
    own = "__pii" if "pii" in docs.columns else None
    d = docs.withColumnRenamed("pii", own) if own else docs
    d = find_pii(d, text_col, threshold)
    text, spans = F.col(text_col), F.col("pii")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], F.array(between, tag))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    d = d.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop("pii")
    return d.withColumnRenamed(own, "pii") if own else d


def op6_pii(spark, sf_dir):
    """Personal data in all ``documents``."""
    d = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii", lambda s: s["order"] < len(BASE))
    return d.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
