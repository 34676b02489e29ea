"""Secret scan over a trigram inverted index, with DataFrame operations only.

A Boolean query over trigrams follows from each rule's regular expression: what every match
must hold.  The index has the postings (trigram, text) of the trigrams that rules ask for,
over the text with small letters, so it serves rules with and without regard to case.  A
query is an alternative of conjunctions; a conjunction meets the postings of its trigrams
and keeps the texts that stand in all of them, all conjunctions at once in one join on the
trigram.  Those texts are a rule's candidates, and only there its expression is run.  A rule
without a mandatory trigram, such as a run of hexadecimal digits, has every text as a
candidate.

Texts are told apart by two 64-bit hashes.  Were two texts ever to share both, each would
get the other's candidates as well, and the expressions would settle it: the index decides
only where to look.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, packed, stored, text_key, unpacked
from lodestone.llm.spans import SPAN, let, regex_spans, running


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has `least` code points or more; the others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three kinds that every scan has; in the order that ties are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run is taken whole, so shorter runs needn't be matched and dropped
)
#: Public formats of credentials and keys.
MORE = (
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A query: True, a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
#: Strings that a part of an expression may stand for before it counts as open.
STRINGS = 64
#: Candidate texts (some 60 bytes each) up to which their table is sent to every executor.
SENT_ROWS = 100_000


def combine(how: str, parts: Iterable[Query]) -> Query:
    """The parts under one "and" or "or", in the least form: no part that another one implies."""
    flat = [y for x in parts for y in (x[1] if isinstance(x, tuple) and x[0] == how else (x,))]
    if how == "and":
        flat = [x for x in dict.fromkeys(flat) if x is not True]
    elif True in flat:
        return True
    else:
        needs = {x: frozenset(x[1] if isinstance(x, tuple) else (x,)) for x in flat}
        flat = [x for x in needs if not any(needs[y] < needs[x] for y in needs)]
    return True if not flat else flat[0] if len(flat) == 1 else (how, tuple(flat))


def of_strings(strings: set[str]) -> Query:
    return combine("or", [combine("and", [x[i : i + 3] for i in range(len(x) - 2)]) for x in sorted(strings)])


def _class(items: list) -> set[str] | None:
    """Small letters of a short character class; None if it is open."""
    chars: set[str] = set()
    for op, value in items:
        if op is rc.LITERAL:
            chars.add(chr(value).lower())
        elif op is rc.RANGE and value[1] - value[0] < STRINGS:
            chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 6 else None


def analyse(tokens: Iterable) -> tuple[set[str] | None, Query]:
    """All strings that a sequence stands for, or None if it is open, and the query that follows from it."""
    known: set[str] | None = {""}
    query: list[Query] = []
    closed = True
    for op, value in tokens:
        part, extra = None, True
        if op is rc.LITERAL:
            part = {chr(value).lower()}
        elif op is rc.IN:
            part = _class(value)
        elif op is rc.SUBPATTERN:
            part, extra = analyse(value[3])
        elif op is rc.BRANCH:
            sides = [analyse(x) for x in value[1]]
            if all(s is not None for s, _ in sides):
                part = set().union(*(s for s, _ in sides))
            else:
                extra = combine("or", [q if s is None else of_strings(s) for s, q in sides])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = value
            strings, within = analyse(inner)
            if strings is not None and high <= 4 and len(strings) ** high <= STRINGS:
                part = {"".join(x) for n in range(low, high + 1) for x in product(strings, repeat=n)}
            elif low:
                extra = within if strings is None else of_strings(strings)
        elif op is rc.AT:
            part = {""}
        if part is not None and len(known) * len(part) <= STRINGS:
            known = {a + b for a in known for b in part}
        else:
            query += [of_strings(known), extra if part is None else of_strings(part)]
            known, closed = {""}, False
    return (known, of_strings(known)) if closed else (None, combine("and", [*query, of_strings(known)]))


def trigram_query(pattern: str) -> Query:
    """What the trigrams of a text in small letters must satisfy if the expression matches in it."""
    return analyse(rp.parse(pattern))[1]


def grams_of(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))


def trigram_index(docs: DataFrame, grams: Iterable[str]) -> DataFrame:
    """Postings (gram, _key_a, _key_b) of the given trigrams over the texts in small letters."""
    low = docs.select(F.lower("text").alias("_low"), *text_key())
    wanted = F.array(*[F.lit(x) for x in sorted(grams)]) if grams else F.array().cast("array<string>")
    held = F.filter(wanted, lambda g: F.contains(F.col("_low"), g))
    return low.select(F.explode(held).alias("gram"), "_key_a", "_key_b")


def conjunctions(query: Query) -> list[frozenset[str]]:
    """The alternatives of a query, each a set of trigrams that all must be there."""
    if query is True:
        return [frozenset()]
    if isinstance(query, str):
        return [frozenset([query])]
    sides = [conjunctions(x) for x in query[1]]
    if query[0] == "or":
        found = {x for side in sides for x in side}
    else:
        found = {frozenset().union(*x) for x in product(*sides)}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_key_a, _key_b and _rules, the kinds for which the text stands in all postings of some
    conjunction; rules without a query aren't listed.

    A text has as many postings as rules have trigrams at most, so no group grows with the input.
    """
    spark = index.sparkSession
    rows, number = [], 0
    for rule in rules:
        if (query := trigram_query(rule.pattern)) is not True:
            for grams in conjunctions(query):
                rows += [(number, rule.kind, gram, 1 << i, (1 << len(grams)) - 1) for i, gram in enumerate(sorted(grams))]
                number += 1
    asked = spark.createDataFrame(rows, "_part int, _kind string, gram string, _bit long, _all long")  # as long as the rules are
    met = index.join(F.broadcast(asked), "gram").groupBy("_key_a", "_key_b", "_part", "_kind", "_all").agg(F.bit_or("_bit").alias("_seen"))
    return met.filter("_seen = _all").groupBy("_key_a", "_key_b").agg(F.collect_set("_kind").alias("_rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_rows: int = SENT_ROWS) -> DataFrame:
    """docs with `spans`: an array of (start, rank, kind, end) by start, then in the order of the rules.

    Places count code points, ends are exclusive.  Null and empty texts have no spans.  Texts
    are scanned whole; the work grows with their length and the number of matches.  Rows are
    judged each by its own text, so repeated rows repeat; a column `spans` of docs gives way,
    other names can't clash; an empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    index = trigram_index(docs, set().union(*map(grams_of, queries.values())))
    found, _ = stored(candidates(index, rules), "secret-candidates")
    keyed = packed(docs).select("_row", "text", *text_key())
    marked = attach(keyed, found, ["_key_a", "_key_b"], found.count(), most_rows)
    text, nothing = F.coalesce(F.col("text"), F.lit("")), F.array().cast(SPAN)

    def of_rule(rank: int, rule: Rule) -> Column:
        spans = F.filter(regex_spans(text, rule.pattern, rule.group), lambda x: x["size"] >= rule.least)
        if queries[rule.kind] is not True:
            spans = F.when(F.array_contains("_rules", rule.kind), spans).otherwise(nothing)
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))

    spans = F.array_sort(F.concat(*[of_rule(i, rule) for i, rule in enumerate(rules)]))
    return marked.select(*unpacked(docs, ("spans",)), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


#: Spans up to which pieces are cut out of the text itself: each such cut goes through the text from its start.
CUT_SPANS = 64


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of spans, overlapping ones as one, replaced by the mark."""

    def joined(piece) -> Column:
        """piece(start, size) for what stands before each fresh span and after the last one."""
        upto = running(F.transform(spans, lambda x: x["end"]), F.greatest)  # the end of all spans before
        parts = F.zip_with(spans, upto, lambda x, at: F.when(x["start"] >= at, F.concat(piece(at, x["start"] - at), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), piece(last, F.char_length(text) - last))

    near = joined(lambda start, size: F.substring(text, (start + 1).cast("int"), size.cast("int")))
    far = let(F.split(text, ""), lambda chars: joined(lambda start, size: F.array_join(F.slice(chars, (start + 1).cast("int"), size.cast("int")), "")))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= CUT_SPANS, near).otherwise(far)
