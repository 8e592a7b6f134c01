"""Secret scan over a trigram inverted index, with column functions only.

From each rule's regular expression a Boolean query over mandatory trigrams is derived (an OR of
ANDs). The index holds, for every trigram some rule needs, postings of document ids in blocks of
neighbouring ids; a rule's candidates come from intersecting and uniting its postings block by
block, and only they are verified with the expression. A rule without mandatory trigrams scans
every text. The index is written to the shared folder.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. Their positions
follow from the lengths of the pieces between matches, so a text is read twice per rule at most.

Defined results: null or empty text has no spans; a null key cannot be posted, so such rows are
verified by every rule; repeated rows repeat; an empty table gives an empty result. Keys are whole numbers. The work
on a text grows with its length and with its number of matches, not with their square.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.llm.arrays import let, scan_array
from selvedge.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 4096
# An AND of more trigrams than this is cut: fewer conditions only add candidates.
TRIGRAMS_PER_CLAUSE = 6
# A class of so few characters counts as alternatives.
SMALL_CLASS = 6


@dataclass(frozen=True)
class SecretRule:
    """``value`` is the group whose length must reach ``least``; ``base`` rules come first in ties."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = False


# The base rules.
BASE_RULES = (
    SecretRule(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        True,
    ),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    SecretRule("hex", "[0-9a-f]+", 0, 24, True),
)

# Well-known credential formats.
MORE_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("gitlab", "glpat-[A-Za-z0-9_-]{20,}"),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", "AIza[0-9A-Za-z_-]{35}"),
    SecretRule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}"),
    SecretRule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    # A key runs to its END line; one that has none runs through the base64 text after its first line.
    SecretRule(
        "pem",
        "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
        "(?:[A-Za-z0-9+/=:,. \r\n\t-]*?-----END [A-Z0-9 ]*PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)",
    ),
    # User and password of an address, of any length; the scheme before them is no secret.
    SecretRule("login", "://[A-Za-z0-9_.~%!$&'()*+,;=-]*:[A-Za-z0-9_.~%!$&'()*+,;=:-]+@"),
)

RULES = BASE_RULES + MORE_RULES


def _trigrams(literal: str) -> frozenset[str]:
    low = literal.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _strings(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern; each is the list of literal runs that its matches must hold.

    Only what is certain counts: classes, repeats and optional parts end a run.
    """
    import re._constants as C
    import re._parser as parser

    def walk(items) -> list[list[str]]:
        # Each alternative keeps its finished runs and, last, the run still growing.
        ways: list[list[str]] = [[""]]
        for op, value in items:
            if op is C.LITERAL and value < 128:
                ways = [[*w[:-1], w[-1] + chr(value)] for w in ways]
            elif op is C.IN and len(value) <= SMALL_CLASS and all(o is C.LITERAL and v < 128 for o, v in value):
                ways = [[*w[:-1], w[-1] + chr(v)] for w in ways for _, v in value]
            elif op is C.SUBPATTERN:
                inner = walk(value[3])
                ways = [_join(w, i) for w in ways for i in inner]
            elif op is C.BRANCH:
                inner = [i for branch in value[1] for i in walk(branch)]
                ways = [_join(w, i) for w in ways for i in inner]
            elif op is C.MAX_REPEAT and value[0] >= 1:
                inner = walk(value[2])
                ways = [[*_join(w, i), ""] for w in ways for i in inner]
            elif op is C.MAX_REPEAT and value[1] == 1:
                inner = walk(value[2])
                ways = [x for w in ways for x in (w, *[_join(w, i) for i in inner])]
            else:
                ways = [[*w, ""] for w in ways]
        return ways

    def _join(left: list[str], right: list[str]) -> list[str]:
        return [*left[:-1], left[-1] + right[0], *right[1:]]

    return walk(parser.parse(pattern))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that every match holds; None if some match needs none."""
    clauses = set()
    for runs in _strings(pattern):
        needed = sorted(frozenset().union(*[_trigrams(r) for r in runs]))
        if not needed:
            return None
        clauses.add(frozenset(needed[:TRIGRAMS_PER_CLAUSE]))
    minimal = [c for c in clauses if not any(o < c for o in clauses)]
    return sorted(minimal, key=sorted)


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, block, ids), ids of at most BLOCK neighbouring keys; written to the shared folder."""
    low = F.translate(F.col(text), UPPER, LOWER)
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    postings = (
        docs.select(F.col(key).cast("long").alias("id"), low.alias("_low"))
        .filter("id IS NOT NULL")
        .select("id", F.explode(held).alias("trigram"))
        .groupBy("trigram", F.floor(F.col("id") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    return stage(postings, "trigrams")


def candidates(index: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(id, kinds): the ids that each indexed rule has to verify."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    needed = sorted({t for q in queries.values() for clause in q for t in clause})
    none = F.array().cast("array<bigint>")
    blocks = index.groupBy("block").agg(
        *[F.first(F.when(F.col("trigram") == t, F.col("ids")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(needed)]
    )
    posting = {t: F.coalesce(F.col(f"p{k}"), none) for k, t in enumerate(needed)}
    rows = blocks.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        reduce(
                            F.array_union,
                            [reduce(F.array_intersect, [posting[t] for t in sorted(clause)]) for clause in query],
                        ).alias("ids"),
                    )
                    for kind, query in queries.items()
                ]
            )
        ).alias("hit")
    )
    hits = rows.select("hit.kind", F.explode("hit.ids").alias("id"))
    return hits.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: SecretRule, order: int, text: Column) -> Column:
    """Spans of one rule: walk over the pieces between matches, adding up lengths."""
    java = rule.pattern
    matches = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    values = matches if rule.value == 0 else F.regexp_extract_all(text, F.lit(java), F.lit(rule.value))
    gaps = F.transform(F.split(text, java, -1), lambda piece: F.length(piece))
    steps = F.arrays_zip(
        F.transform(matches, lambda m: F.length(m)).alias("m"),
        F.transform(values, lambda v: F.length(v)).alias("v"),
        gaps.alias("g"),
    )

    def span(state: Column, x: Column) -> Column:
        start = state + x["g"]
        return F.struct(
            F.when(x["v"] >= rule.least, start).alias("start"), F.lit(order).alias("order"), (start + x["m"]).alias("end"), F.lit(rule.kind).alias("kind")
        )

    # The last piece has no match after it.
    found = scan_array(F.filter(steps, lambda x: x["m"].isNotNull()), F.lit(0), lambda at, x: at + x["g"] + x["m"], span)
    return F.filter(found, lambda x: x["start"].isNotNull())


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """``docs`` with a column ``spans``: array of (start, order, end, kind), sorted by start, then rule order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    needed = sorted({t for q in queries.values() if q for clause in q for t in clause})
    names = docs.columns
    packed = docs.select(
        F.col(key).cast("long").alias("_id"),
        F.col(text).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
    )
    found = candidates(build_index(docs, needed, key, text), rules)
    joined = packed.join(found, F.col("_id") == F.col("id"), "left")

    def wanted(rule: SecretRule) -> Column:
        body = F.col("_text").isNotNull()
        if queries[rule.kind] is None:
            return body
        return body & (F.col("_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)))

    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    body = F.coalesce(F.col("_text"), F.lit(""))
    per_rule = [
        F.when(wanted(r) & body.rlike(_enough(r)), _spans(r, k, body)).otherwise(empty) for k, r in enumerate(rules)
    ]
    return joined.select(F.col("_row"), F.sort_array(F.concat(*per_rule)).alias("spans"))


def _enough(rule: SecretRule) -> str:
    """A cheaper test than walking the matches: some match of the wanted length must be there."""
    if rule.value == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` joined by commas."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(
            chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


PIECE, PIECES = 4_096, 1 << 20


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, by way of longer ones: finding a place in a string means counting to it."""

    def cut(whole: Column, size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(whole) - 1, F.lit(0)), F.lit(size))
        return F.transform(starts, lambda k: F.substring(whole, k + 1, F.lit(size)))

    return F.flatten(F.transform(cut(text, PIECES), lambda part: cut(part, PIECE)))


def _between(pieces: Column, low: Column, high: Column) -> Column:
    """Characters low to high of a text in pieces."""
    first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
    at = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    head = F.substring(at(first), low % PIECE + 1, F.lit(PIECE))
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    near = F.substring(at(first), low % PIECE + 1, high - low)
    return F.when(high <= low, F.lit("")).when(first == last, near).otherwise(
        F.concat(head, middle, F.substring(at(last), F.lit(1), high % PIECE))
    )


def redact(text: Column, spans: Column, mark: Callable[[Column], Column] | None = None) -> Column:
    """``text`` with every span replaced by ``[kind]``; overlapping spans are replaced as one. ``spans`` are sorted."""
    name = mark or (lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))

    def replaced(pieces: Column, held: Column) -> Column:
        def show(at: Column, s: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(_between(pieces, at, s["start"]), name(s))).otherwise(F.lit(""))

        parts = scan_array(held, F.lit(0), lambda at, s: F.greatest(at, s["end"]), show)
        return F.concat(F.array_join(parts, ""), _between(pieces, F.array_max(F.transform(held, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(_pieces(text), lambda pieces: let(spans, lambda held: replaced(pieces, held))))
