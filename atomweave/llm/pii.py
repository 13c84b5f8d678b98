"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators (Luhn for cards, remainder 97 for bank accounts, ranges for
addresses, digit counts for phones) confirm them, and whole words close to a span on either side adjust its score; a
span of a kind that is not a base one stays if its score reaches the kind's least. All of it is done inside the row in
linear time, so nothing is shuffled and a text of any length is read whole.

Defined results: a null text counts as the empty one (no spans); repeated rows give repeated results; null ids
stay null; other columns of the input, whatever their names, are passed through by ``redact`` and ignored by
``scan``. Positions are code points, ends exclusive. Matches of one kind never overlap, those of two kinds may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, let

#: Characters before and after a span in which context words count; of a text that masking looks at together.
NEAR, PIECE = 48, 256
#: What a context word adds to a kind's score, and from which score a span counts as sure.
CONTEXT, SURE = 0.3, 0.8


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern for Java (no nested backtracking), plain score, context words, a string without which there is no match, score from which it stays."""

    name: str
    pattern: str
    score: float
    words: str
    gate: str = ""
    least: float = 0.0


#: Characters of an account number by its country.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Account numbers of the length that their country has; of 15 to 34 characters, up to the next one, where the country is not listed."""
    listed = "|".join("|".join(c.split()) for c in IBAN.values())
    known = "|".join(rf"(?:{'|'.join(c.split())})[0-9][0-9](?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
    other = rf"(?!{listed})[A-Z][A-Z][0-9][0-9](?:(?:\x20(?!(?:{listed})[0-9][0-9]))?[A-Z0-9]){{11,30}}"
    return rf"(?=[A-Z][A-Z][0-9][0-9])(?:(?<![A-Za-z0-9])|(?<=IBAN|Iban|iban))(?:{known}|{other})(?![A-Za-z0-9])"


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Base kinds in the order of the digest, then those that the method adds. Possessive forms match the same spans as
#: the plain ones, in linear time: a local part is only tried where it begins or right after the last match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, "mail|contact|write|reach", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|from", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|credit|pay|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax|sms", "+"),
    Kind("iban", _iban(), 0.8, "iban|account|bank|konto"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.5, "ssn|social|security", "-"),
    Kind("secret", r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}+", 0.4, "token|secret|password|passwd|pwd|api key|apikey|key|credential|bearer|auth", least=0.7),
)
#: Beginnings of keys that tell what they are.
_KEYS = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|xox[abprs]-|eyJ[A-Za-z0-9_-]+[.]eyJ)"
BASE = ("email", "ip", "card", "phone")

_SPAN = "array<struct<kind string, start bigint, end bigint, score double>>"
_MATCH = "struct<start bigint, m string, before string, after string>"


def kind_spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by start: what lies between the matches gives the positions and the context."""
    matched = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = let(F.split(text, kind.pattern, -1), lambda b: F.transform(matched, lambda m, i: F.struct(F.get(b, i).alias("before"), m.alias("m"), F.left(F.get(b, i + 1), F.lit(NEAR + 1)).alias("after"))))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["before"])
        return start + F.length(p["m"]), F.array(F.struct(start.alias("start"), p["m"].alias("m"), F.right(p["before"], F.lit(NEAR + 1)).alias("before"), p["after"].alias("after")))

    found = fold(pairs, F.lit(0).cast("long"), _MATCH, step)
    named = F.transform(
        F.filter(found, lambda s: _valid(kind, s["m"])),
        lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), _score(kind, s).alias("score")),
    )
    if kind.least:
        named = F.filter(named, lambda s: s["score"] >= kind.least - 1e-9)
    if kind.gate:
        named = F.when(F.contains(text, F.lit(kind.gate)), named).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    return named.cast(_SPAN)


def _score(kind: Kind, s: Column) -> Column:
    """The kind's score, and CONTEXT more if one of its words stands close; a word that the border of NEAR cuts is none."""
    before = F.when(F.length(s["before"]) > NEAR, F.regexp_replace(s["before"], "^[A-Za-z]+", "")).otherwise(s["before"])
    after = F.when(F.length(s["after"]) > NEAR, F.regexp_replace(s["after"], "[A-Za-z]+$", "")).otherwise(s["after"])
    close = F.lower(F.concat(before, F.lit(" "), after)).rlike(f"(?<![a-z])(?:{kind.words})s?(?![a-z])")
    plain = F.lit(kind.score) if kind.name != "secret" else F.when(s["m"].rlike(_KEYS), F.lit(1.0)).otherwise(F.lit(kind.score))
    return F.least(F.lit(1.0), plain + F.when(close, F.lit(CONTEXT)).otherwise(F.lit(0.0)))


def _valid(kind: Kind, m: Column) -> Column:
    """The validator of a kind for a matched string."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind.name == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind.name == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
        step = lambda a, c: F.when(c == "", a).when(c >= "A", F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97)))
        return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1
    if kind.name == "ssn":
        return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    if kind.name == "secret":  # words and numbers alone are none
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("^(?:[A-Za-z]+[./_=-]+)*[A-Za-z]*[0-9]{0,4}$")
    return F.lit(True)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and a column for each kind with its spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *[kind_spans(text, k).alias(k.name) for k in kinds])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base kinds, all spans as text and how many are sure."""
    found = scan(docs, id_col, text_col)
    every = F.concat(*[F.col(k.name) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.size(every).cast("long").alias("n_spans"),
        F.sha2(written(F.concat(*[F.col(k) for k in BASE])), 256).alias("base_sha256"), written(every).alias("spans"),
        F.size(F.filter(every, lambda s: s["score"] >= SURE - 1e-9)).cast("long").alias("n_sure"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (and each run of overlapping ones) as one [KIND] of the span that begins it."""
    def piecewise(own: Column, pieces: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            k = F.floor(a / PIECE)
            few = F.array_join(F.slice(pieces, (k + 1).cast("int"), (F.floor((b - 1) / PIECE) - k + 1).cast("int")), "")
            return F.when(b <= a, F.lit("")).otherwise(few.substr((a - k * PIECE + 1).cast("int"), (b - a).cast("int")))

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            more = F.array(cut(at, s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.greatest(at, s["end"]), F.when(s["start"] < at, F.expr("cast(array() as array<string>)")).otherwise(more)

        by_start = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_"), s["kind"].alias("kind"), s["end"].alias("end"))))
        tail = cut(F.array_max(F.transform(own, lambda s: s["end"])), F.length(text).cast("long"))
        return F.array_join(F.concat(fold(by_start, F.lit(0).cast("long"), "string", step), F.array(tail)), "")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(spans, lambda own: F.when(F.size(own) == 0, text).otherwise(let(pieces, lambda p: piecewise(own, p))))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The rows with every span masked in the text column.

    Null texts stay null, empty ones empty; repeated rows stay repeated; null ids and columns of other names pass through.
    """
    spare = "_pii_spans"
    while spare in docs.columns:
        spare += "_"
    spans = F.concat(*[kind_spans(F.coalesce(F.col(text_col), F.lit("")), k) for k in kinds])
    return docs.withColumn(spare, spans).withColumn(text_col, masked(F.col(text_col), F.col(spare))).drop(spare)
