"""Personal data: patterns propose spans, checksums confirm them, context words near them adjust the score.

DataFrame functions only. A pattern's matches are marked in the text with a separator, the text is split there, and the lengths of the parts
give the positions. The separator is a control character that no pattern can match; where a text holds it already it is first
replaced by another one, so lengths stay the same. Patterns are possessive and may start only where a run of their characters starts (or
where the last match ended), hence time is linear in the text and the same leftmost matches are found.

Kinds: the base kinds email, ip, card, phone are always kept once their check passes; the further kinds (iban with the mod-97
check, ssn and local phone numbers) are kept from a score of KEEP on. Score: 0.5 for the pattern, 0.35 for a passed checksum, 0.25 for
a context word of the kind within NEAR code points before the span or behind it, at most 1.

Defined cases: a null text is empty and has no spans; offsets are code points of the whole text, end exclusive; an empty table
gives an empty result; further columns pass through, but for those whose names start with `pii_`, which are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn", "local")
CHECKSUM = ("card", "iban")
KEEP, NEAR = 0.7, 40
MARK, OTHER = "\u0001", "\u0002"

_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Fewer than 16 digits can't pass, and no later start in the same run has more of them.
    "card": r"(?:(?<![0-9])(?<![0-9][\x20-])|\G)(?=[0-9](?:[\x20-]?[0-9]){15})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
}
# A text without this can't match; cheaper than the pattern.
_HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_CONTEXT = {
    "email": r"(?i)e-?mail|contact|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|address|server|host",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax|telefon|tél|teléfono",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social|security",
    "local": r"(?i)phone|tel|call|mobile|fax|telefon|tél|teléfono",
}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _mod97(found: Column) -> Column:
    """Remainder of an account number with its first four characters moved behind and letters as 10 to 35."""
    plain = F.regexp_replace(found, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest, ch):
        letter = F.ascii(ch) - 55
        return F.when(letter >= 10, (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(ch) - 48) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: part.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & F.call_function("luhn_check", _digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(found, " ", "")).between(15, 34) & (_mod97(found) == 1)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,found:string,near:string>>"


def _spans(text: Column, kind: str, digits: Column) -> Column:
    """Matches of a kind that pass its check, in order; `digits` tells whether the text holds a digit at all."""
    parts = F.split(F.regexp_replace(text, f"({_PATTERN[kind]})", f"{MARK}$1{MARK}"), MARK)
    empty = F.array().cast(_SPAN)
    # Every second part is a match. Only those that pass are kept; the others just move the position.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("before"), empty.alias("spans"))

    def step(state, part):
        end = state["at"] + F.length(part)
        keep = (state["i"] % 2 == 1) & _valid(kind, part)
        span = F.struct(state["at"].alias("start"), end.alias("end"), part.alias("found"),
                        state["before"].alias("near"))
        return F.struct(end.alias("at"), (state["i"] + 1).alias("i"), F.right(F.concat(state["before"], part), F.lit(NEAR)).alias("before"),
                        F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))
    found = F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(empty)
    possible = F.lit(True) if kind == "email" else digits
    if kind in _HINT:
        possible = F.contains(text, F.lit(_HINT[kind])) & possible
    return F.when(possible, found).otherwise(empty)


def _scored(kind: str, spans: Column, text: Column) -> Column:
    """Spans with kind and score; those of the further kinds that score too low are left out."""
    def score(s):
        around = F.concat(s["near"], F.lit(" "), F.substr(text, s["end"] + 1, F.lit(NEAR)))
        base = 0.85 if kind in CHECKSUM else 0.5
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"),
                        F.least(F.lit(1.0), F.lit(base) + F.when(around.rlike(_CONTEXT[kind]), 0.25).otherwise(0.0)).alias("score"))
    out = F.transform(spans, score)
    return F.filter(out, lambda s: s["score"] >= KEEP) if kind in FURTHER else out


def find(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with `out`: array<struct<kind,start,end,found,score>>, kind by kind, then by start."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("pii_")])
    raw = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER)
    found = (docs.select("*", raw.alias("pii_raw")).withColumn("pii_digits", F.col("pii_raw").rlike("[0-9]"))
             .select("*", *[_spans(F.col("pii_raw"), kind, F.col("pii_digits")).alias(f"pii_{kind}") for kind in BASE + FURTHER]))
    shown = F.coalesce(F.col(text), F.lit(""))
    parts = [F.when(F.size(f"pii_{kind}") > 0, _scored(kind, F.col(f"pii_{kind}"), shown)).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,found:string,score:double>>")) for kind in BASE + FURTHER]
    return found.withColumn(out, F.concat(*parts)).drop("pii_raw", "pii_digits", *[f"pii_{kind}" for kind in BASE + FURTHER])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by [KIND]; of overlapping spans the first (then the longest) names the whole run."""
    shown = F.coalesce(F.col(text), F.lit(""))
    found = find(docs, text, "pii_spans")
    order = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc, s):
        end, inside = -s["minus"], s["start"] < acc["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substr(shown, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["done"], piece).alias("done"))
    clean = F.aggregate(order, state, step, lambda acc: F.concat(acc["done"], F.substr(shown, acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, clean).otherwise(F.col(text))).drop("pii_spans")


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), "text", "all_spans").select("doc_id", "all_spans")

    def count(kind):
        return F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("all_spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("all_spans")).alias("spans"),
                        F.coalesce(F.array_max(F.transform("all_spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
