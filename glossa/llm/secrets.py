"""Secret scan by a trigram index.

Every rule's regular expression is taken apart into the literals that each of its matches must hold; their trigrams make a
Boolean query, alternatives of trigrams that must all be there. The index has a posting for each of those trigrams and each text (by
hash) that holds it. Postings are intersected by counting them per text and alternative; only candidates are searched with a
rule's expression, on the whole text. A rule that has an alternative without a trigram scans every text.

Only built-in functions; the driver handles rules, never texts. Trigrams ignore the case of A-Z, which only adds candidates.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .spans import found, joined, named, none

# Alternatives beyond which a class or branch counts as unknown, which only adds candidates.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is what trigrams are derived from, ``search`` the same language written for Spark. A match is kept if its
    group ``value`` has at least ``least`` characters."""

    kind: str
    pattern: str
    search: str
    least: int = 0
    value: int = 0


def plain(kind: str, pattern: str) -> Rule:
    return Rule(kind, pattern, pattern)


# The base rules, in their order.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]++", 18),
    Rule("hex", r"[0-9a-f]{16,}", r"(?<![0-9a-f])[0-9a-f]{16,}+", 16),
)
# Public shapes of other credentials.
MORE = (
    plain("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    plain("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    plain("google", r"AIza[A-Za-z0-9_-]{35}"),
    plain("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{24,99}"),
    plain("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def literals(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern, each a list of lower-case literals that a match of it must hold."""
    whole = []
    for done, open_ in _walk(sre_parser.parse(pattern), [((), "")]):
        whole.append([x for x in (*done, open_) if x])
    return whole


def _close(states: list) -> list:
    return list(dict.fromkeys(((*done, open_), "") for done, open_ in states))


def _walk(nodes, states: list) -> list:
    """Follow the nodes from each state, a state being the literals done and the one still growing."""
    for op, arg in nodes:
        if op is sre.LITERAL:
            states = [(done, open_ + chr(arg).lower()) for done, open_ in states]
        elif op is sre.SUBPATTERN:
            states = _walk(arg[-1], states)
        elif op is sre.BRANCH:
            branched = [s for branch in arg[1] for s in _walk(branch, states)]
            states = branched if len(branched) <= MOST_ALTERNATIVES else _close(states)
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) * len(states) <= MOST_ALTERNATIVES:
            letters = sorted({chr(x[1]).lower() for x in arg})
            states = [(done, open_ + c) for done, open_ in states for c in letters]
        elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            both = list(dict.fromkeys([*states, *_walk(arg[2], states)]))
            states = both if len(both) <= MOST_ALTERNATIVES else _close(states)
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            states = _walk(arg[2], states)
            states = states if arg[1] == 1 else _close(states)
        else:
            states = _close(states)
    return states


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that a match needs; None if some match needs none."""
    query = [frozenset(x[i : i + 3] for x in parts for i in range(len(x) - 2)) for parts in literals(pattern)]
    return None if not all(query) else list(dict.fromkeys(query))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``trigram, mark`` for each of the trigrams that a text holds, once per distinct text."""
    low = texts.select("mark", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("mark", F.explode(held).alias("trigram")).groupBy("trigram", "mark").agg(F.lit(1).alias("one")).select("trigram", "mark")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``mark, rules``: the rules of which some alternative has all its trigrams in the text."""
    rows = [(kind, number, len(need), t) for kind, query in queries.items() for number, need in enumerate(query) for t in sorted(need)]
    wanted = index.sparkSession.createDataFrame(rows, "rule string, way int, need int, trigram string")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("mark", "rule", "way", "need").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == F.col("need")).groupBy("mark").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *MORE), text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``spans`` (s, k, e, kind, v) by start and order of rule; one row per input row.

    Matches of a rule are leftmost and do not overlap; those of several rules may. A null text is empty and has none.
    Repeated rows stay; equal texts share their postings.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text).alias("text"))
    rows = rows.select("row", "text", F.xxhash64("text").alias("mark"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    narrow = {kind: q for kind, q in queries.items() if q is not None}
    if narrow:
        index = stored(postings(rows.select("mark", "text"), sorted({t for q in narrow.values() for need in q for t in need})), "postings")
        rows = rows.join(candidates(index, narrow), "mark", "left")

    def spans(order: int, rule: Rule) -> Column:
        least = (lambda v: F.length(v) >= rule.least) if rule.least else None
        hits = found(F.col("text"), rule.search, least, rule.value)
        if rule.kind in narrow:
            hits = F.when(F.array_contains("rules", rule.kind), hits).otherwise(none())
        return named(rule.kind, order, hits)

    return rows.select("row", F.sort_array(F.concat(*[spans(i, r) for i, r in enumerate(rules)])).alias("spans"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that ``scan`` found."""
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        F.col(f"row.{key}").alias(key),
        *[count(r.kind) for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
