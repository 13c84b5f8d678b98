"""License scan, with DataFrame functions only: ordered signature rules over the words of a text.

A rule runs only where its keyword is a word of the text. Detections of all rules are resolved by priority and
interval containment in one sweep over their starts. Everything is done inside the row: nothing is shuffled.

Defined results: a null or empty text has no words, no detections and score 0; repeated rows give repeated
results; null ids stay null; other columns of the input are ignored; no length is limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold, let
from .license_rules import rules

#: Words of a text, after A-Z have become a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are all counted, with their labels; the keyword gates them.
PHRASES = (("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "reserved", "all rights reserved"))
#: Score of a detection by tier (1 a mention to 4 a tag).
SCORES = {1: 0.6, 2: 0.8, 3: 0.9, 4: 1.0}
TIERS = tuple(SCORES)

_ONE = "struct<first bigint, last bigint, tier int, rule int, label string>"
_FOUND = f"array<{_ONE}>"


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _places(joined: Column, rule: Column) -> Column:
    """Where a rule's pattern matches, in words; joined has one space before, between and after the words."""
    bordered = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.regexp_extract_all(joined, bordered, F.lit(0))
    pairs = let(F.split(joined, bordered, -1), lambda between: F.transform(found, lambda m, i: F.struct(F.get(between, i).alias("before"), m.alias("m"))))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        first = at + _spaces(p["before"])
        last = first + _spaces(p["m"])
        return last, F.array(F.struct(first.alias("first"), last.alias("last"), rule["tier"].alias("tier"), rule["rule"].alias("rule"), rule["label"].alias("label")))

    return fold(pairs, F.lit(-1).cast("long"), _ONE, step)


def _table() -> list[tuple[int, int, str, str, str]]:
    """(rule, tier, label, keyword, pattern); the phrases come first, in a tier of their own below all."""
    base = [(i, 0, label, keyword, pattern) for i, (label, keyword, pattern) in enumerate(PHRASES)]
    return base + [(len(base) + i, tier, label, keyword, pattern) for i, (tier, label, keyword, pattern) in enumerate(rules())]


def resolve(found: Column) -> Column:
    """Without the detections that one of a higher tier, or a longer or earlier one of the same tier, contains."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("till"), (-d["tier"]).alias("rank"), d["rule"].alias("rule"), d["label"].alias("label"))))
    none = F.expr(f"cast(array() as {_FOUND})")

    def step(reach: Column, d: Column) -> tuple[Column, Column]:
        last, tier = -d["till"], -d["rank"]
        covered = F.lit(False)
        for t in TIERS:
            covered = covered | ((tier <= t) & (reach[f"t{t}"] >= last))
        here = F.struct(d["first"].alias("first"), last.alias("last"), tier.cast("int").alias("tier"), d["rule"].alias("rule"), d["label"].alias("label"))
        now = F.struct(*[F.when(tier == t, F.greatest(reach[f"t{t}"], last)).otherwise(reach[f"t{t}"]).alias(f"t{t}") for t in TIERS])
        return now, F.when(covered, none).otherwise(F.array(here))

    return fold(ordered, F.struct(*[F.lit(-1).cast("long").alias(f"t{t}") for t in TIERS]), _ONE, step)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, phrases (all places of the base phrases) and detections (resolved), each with words first to last (exclusive)."""
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    worded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    rows = _table()
    keywords = F.array(*[F.lit(k) for k in sorted({r[3] for r in rows})])
    present = worded.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect(keywords, "words").alias("present"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"))
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("tier"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern")) for r, t, label, k, p in rows])
    gated = F.filter(table, lambda r: F.array_contains(F.col("present"), r["keyword"]))
    every = F.when(F.size("present") == 0, F.expr(f"cast(array() as {_FOUND})")).otherwise(F.flatten(F.transform(gated, lambda r: _places(F.col("joined"), r))))
    found = present.select("doc_id", "n_words", every.alias("every"))
    n = len(PHRASES)
    return found.select("doc_id", "n_words", F.filter("every", lambda d: d["rule"] < n).alias("phrases"), resolve(F.filter("every", lambda d: d["rule"] >= n)).alias("detections"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and labels of the whole text, and the score of its best detection (a base phrase counts as a mention)."""
    labels = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"])))
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("detections", lambda d: F.element_at(F.create_map(*[x for t, s in SCORES.items() for x in (F.lit(t), F.lit(s))]), d["tier"]))), F.lit(0.0)),
        F.when(F.size("phrases") > 0, F.lit(SCORES[1])).otherwise(F.lit(0.0)),
    )
    return detect(docs, id_col, text_col).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.transform("phrases", lambda d: d["first"])).alias("first_word"), F.array_max(F.transform("phrases", lambda d: d["first"])).alias("last_word"),
        F.array_join(labels(F.col("phrases")), ",").alias("base_labels"), F.array_join(labels(F.concat("phrases", "detections")), ",").alias("labels"),
        score.alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
