r"""Personal data spans: patterns propose, checksums confirm, context scores.

Positions come from column expressions: ``split`` and ``regexp_extract_all``
with one pattern give the pieces between the matches and the matches, whose
lengths add up to code point offsets. Every pattern is written so that Java's
matcher runs in linear time and constant stack on any text: runs are
possessive, and a run is entered only at its start or where the last match
ended (``\G``), which leaves the leftmost non-overlapping matches unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IBAN lengths by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24,
    "SI": 19, "SK": 24,
}
_IBAN = "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())

LOCAL = r"[A-Za-z0-9._%+-]"
# kind -> (pattern, text that must be present for a match to be possible).
# ``card`` names whole runs of 13 to 19 digits; shorter and longer runs would
# be matched and dropped.
BASE = {
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
# what the method adds to the base kinds
EXTRA = {
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", ""),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "call": (r"(?<![0-9+.(-])\(?[0-9]{2,5}\)?[\x20./-][0-9][\x20./0-9-]{4,14}[0-9](?![0-9])", ""),
}
KINDS = (*BASE, *EXTRA)

#: Score of a confirmed span, what a context word within WINDOW code points
#: before or behind it adds, and the score that a span beyond the base needs.
SCORES = {"email": 90, "ip": 80, "card": 90, "phone": 80, "iban": 90, "ssn": 40, "call": 30}
CONTEXT_BONUS = 30
THRESHOLD = 60
WINDOW = 40
_CALL = "phone|call|tel[.:]|fax|mobile|anruf|appel"
CONTEXT = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "address|server|host|adresse|direcci",
    "card": "card|visa|payment|karte|carte|tarjeta",
    "phone": _CALL,
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer|sozialvers|assurance",
    "call": _CALL,
}

_STEP = "array<struct<gap:int,m:string,pre:string,post:string>>"
_SPAN = "array<struct<start:bigint,m:string,pre:string,post:string>>"
#: Matches whose offsets are added up in one go; a text's matches are taken in
#: blocks of so many, which keeps long lists of matches near linear.
BLOCK = 256
#: The least length of a match of any pattern; as many matches as fill a WINDOW
#: on one side are looked at.
SHORTEST = 4
NEAR = WINDOW // SHORTEST


def _steps(text: str, pattern: str, needs: str) -> Column:
    """Matches with the gap in front of each and what surrounds them."""
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0)
    behind = F.slice(gaps, 2, F.size(gaps))
    zipped = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m"), behind.alias("b")), lambda z: z["m"].isNotNull())
    steps = F.transform(zipped, lambda z: F.struct(
        F.length(z["g"]).alias("gap"), z["m"].alias("m"),
        F.right(z["g"], F.lit(WINDOW)).alias("pre"), F.left(z["b"], F.lit(WINDOW)).alias("post")))
    may = F.contains(F.col(text), F.lit(needs)) if needs else F.col(text).rlike("[0-9]")
    return F.when(may, steps).otherwise(F.array().cast(_STEP))


def _spans(steps: str) -> Column:
    """Start offsets of a (materialised) column of steps, block by block."""
    n = F.size(steps)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def width(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, s: a + s["gap"] + F.length(s["m"]))

    def block(b: Column) -> Column:
        start = F.struct(width(F.slice(steps, 1, b * BLOCK)).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), start, lambda a, s: F.struct(
            (a["at"] + s["gap"] + F.length(s["m"])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + s["gap"]).alias("start"), s["m"].alias("m"),
                                              s["pre"].alias("pre"), s["post"].alias("post"))).alias("out")),
            lambda a: a["out"])

    return F.when(n > 0, F.flatten(F.transform(blocks, block))).otherwise(F.array().cast(_SPAN))


def _surrounded(steps: str) -> Column:
    """Steps whose ``pre`` and ``post`` reach WINDOW code points into the text.

    A shorter gap to the neighbouring match is followed by that match and the
    gap beyond it, and so on; ``pre`` and ``post`` as given are whole gaps then.
    """
    def one(s: Column, i: Column) -> Column:
        ahead = F.slice(steps, F.greatest(i - (NEAR - 1), F.lit(1)), F.least(i, F.lit(NEAR)))
        pre = F.array_join(F.transform(ahead, lambda a: F.concat(a["pre"], a["m"])), "")
        post = F.array_join(F.transform(F.slice(steps, i + 2, NEAR), lambda b: F.concat(b["m"], b["post"])), "")
        return F.struct(s["gap"].alias("gap"), s["m"].alias("m"),
                        F.right(F.concat(pre, s["pre"]), F.lit(WINDOW)).alias("pre"),
                        F.left(F.concat(s["post"], post), F.lit(WINDOW)).alias("post"))

    return F.transform(steps, one)


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits has a valid Luhn check digit."""
    d = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(1, 21):
        v = F.substring(d, i, 1).cast("int") * (1 if i % 2 == 0 else 2)
        total = total + v - F.when(v > 9, 9).otherwise(0)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.array_remove(F.split(moved, ""), ""), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, r"\x20", ""))
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    if kind == "call":
        return F.length(digits).between(7, 15)
    return F.lit(True)


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans`` (array of kind, start, end, score) for every row.

    Kinds come as listed in KINDS, each by start; ends are exclusive, offsets
    are code points of the whole text. Base spans need their check only; other
    spans need a check, a score of THRESHOLD and no overlap with a base span.
    Context is the WINDOW code points of the text before and behind a match,
    other matches included.
    Null and empty texts have no spans. Repeated rows are each looked at;
    other columns of ``docs`` are not read.
    """
    patterns = {**BASE, **EXTRA}
    x = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    x = x.select(key, *[_steps("_text", p, needs).alias(f"_s_{k}") for k, (p, needs) in patterns.items()])
    x = x.select(key, *[_surrounded(f"_s_{k}").alias(f"_s_{k}") for k in patterns])
    x = x.select(key, *[_spans(f"_s_{k}").alias(f"_m_{k}") for k in patterns])
    typed = "array<struct<kind:string,start:bigint,end:bigint,score:int>>"

    def judged(k: str) -> Column:
        def one(s: Column) -> Column:
            near = F.lower(s["pre"]).rlike(CONTEXT[k]) | F.lower(s["post"]).rlike(CONTEXT[k])
            return F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"),
                            (F.lit(SCORES[k]) + F.when(near, CONTEXT_BONUS).otherwise(0)).alias("score"))
        spans = F.transform(F.filter(f"_m_{k}", lambda s: _confirmed(k, s["m"])), one)
        return spans.cast(typed)

    x = x.select(key, F.concat(*[judged(k) for k in BASE]).alias("_base"),
                 F.concat(*[judged(k) for k in EXTRA]).alias("_extra"))
    more = F.filter("_extra", lambda e: (e["score"] >= THRESHOLD) & ~F.exists(
        "_base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return x.select(key, F.concat("_base", more).alias("spans"))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *[count(k) for k in BASE],
        F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
