"""Rule tables as generated column expressions: expansions, intents, actions, follow-ups."""

from __future__ import annotations

import re
import unicodedata

import regex

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import normalize_arabic, normalize_for_matching, once

_FOLD = str.maketrans("أإآٱىةؤئ", "اااايهءء")


def fold(s: str) -> str:
    """The folding of ``normalize_arabic`` for literals without marks."""
    return unicodedata.normalize("NFC", s).translate(_FOLD)


def _bounded(alternatives: list[str], arabic: bool) -> str:
    words = [fold(w) for w in alternatives] if arabic else alternatives
    longest = "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\'", "'") for w in sorted(words, key=len, reverse=True))
    edge = r"[\p{L}\p{N}_؀-ۿ]"
    return f"(?<!{edge})(?:{longest})(?!{edge})"


def expansion_rules() -> list[tuple[str, str]]:
    """(pattern, official terms) in order, English first."""
    return [(_bounded(a, False), t) for a, t in fixed.EXPAND_EN] + [(_bounded(a, True), fold(t)) for a, t in fixed.EXPAND_AR]


_EDGE = r"[\p{L}\p{N}_؀-ۿ]"


def phrase_table() -> tuple[dict[str, list[int]], list[str], int]:
    """(rules by phrase, official terms by rule, most words of a phrase); a phrase begins and ends within a word."""
    rows = [(a, t) for a, t in fixed.EXPAND_EN] + [([fold(x) for x in a], fold(t)) for a, t in fixed.EXPAND_AR]
    table: dict[str, list[int]] = {}
    for k, (alternatives, _) in enumerate(rows):
        for phrase in alternatives:
            table.setdefault(phrase, []).append(k)
    words = lambda x: len(regex.findall(_EDGE + "+", x))
    if odd := [x for x in table if not regex.fullmatch(f"{_EDGE}(.*{_EDGE})?", x)]:
        raise ValueError(f"phrases must begin and end within a word: {odd}")
    return table, [t for _, t in rows], max(map(words, table))


def expansions(q: Column) -> Column:
    """Official terms to append, in rule order, each once.

    A text is cut into words and what stands between them; every run of words up to the longest phrase is looked up in
    one set. The cost depends on the text's words, not on the number of rules.
    """
    table, official, most = phrase_table()
    rule = F.create_map(*(x for p, ks in table.items() for x in (F.lit(p), F.array(*(F.lit(k) for k in ks)))))
    terms = F.array(*(F.lit(t) for t in official))

    def runs_of(parts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: F.coalesce(F.rlike(F.get(parts, i), F.lit("^" + _EDGE)), F.lit(False)))
        each = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(2 * most - 1), F.lit(2)), lambda k: F.array_join(F.slice(parts, i + 1, k), ""))))
        found = F.filter(each, lambda g: g.isin(*table))
        rules = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda g: rule[g]))))
        return F.array_distinct(F.transform(rules, lambda k: F.get(terms, k)))

    text = F.coalesce(F.lower(normalize_arabic(q)), F.lit(""))
    return once(F.regexp_extract_all(text, F.lit(f"{_EDGE}+|[^{_EDGE[1:]}+"), F.lit(0)), runs_of)


def expand_query(q: Column) -> Column:
    return once(expansions(q), lambda adds: F.when(F.size(adds) > 0, F.concat(q, F.lit(" "), F.array_join(adds, " "))).otherwise(q))


def detect_intent(q: Column) -> Column:
    def first(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, p in fixed.INTENTS:
            out = out.when(F.rlike(t, F.lit(p)), F.lit(name))
        return out.otherwise("general")

    return once(normalize_for_matching(q), first)


def looks_like_followup(q: Column) -> Column:
    n = F.size(F.filter(F.split(F.coalesce(q, F.lit("")), r"\s+"), lambda x: x != ""))
    return (n <= fixed.FOLLOWUP_WORDS) & ((detect_intent(q) != "general") | F.rlike(F.coalesce(q, F.lit("")), F.lit(fixed.REFERENTIAL)))


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), normalize_for_matching(c), F.lit(" "))


def _matching(t: Column, table: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.rlike(t, F.lit(p)), F.lit(a)) for a, p in table)))


def query_actions(q: Column) -> Column:
    """struct(actions, strong): weak cues count only without a strong one."""
    def both(t: Column) -> Column:
        weak = _matching(t, fixed.ACTIONS_WEAK)
        return once(_matching(t, fixed.ACTIONS_STRONG), lambda s: F.struct(F.when(F.size(s) > 0, s).otherwise(weak).alias("actions"), (F.size(s) > 0).alias("strong")))

    return once(_padded(q), both)


def title_action(title: Column) -> Column:
    """The action whose cue starts first in a title, strong cues before weak ones; null without any."""
    def first(t: Column, table: list[tuple[str, str]]) -> Column:
        hits = [F.when(F.rlike(t, F.lit(p)), F.struct(F.length(F.split(t, p, 2)[0]).alias("at"), F.lit(k).alias("k"), F.lit(a).alias("a"))) for k, (a, p) in enumerate(table)]
        return F.array_min(F.array_compact(F.array(*hits)))["a"]

    return once(_padded(title), lambda t: F.coalesce(first(t, fixed.ACTIONS_STRONG), first(t, fixed.ACTIONS_WEAK)))


def service_actions(title_en: Column, title_ar: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(title_action(title_en), title_action(title_ar))))


def action_adjustment(actions: Column, strong: Column, service: Column, bonus: float = fixed.ACTION_BONUS, penalty: float = fixed.ACTION_PENALTY) -> Column:
    none = (F.size(actions) == 0) | (F.size(service) == 0)
    return F.when(none, 0.0).when(F.arrays_overlap(actions, service), bonus).when(strong, -penalty).otherwise(0.0)


def action_conflict(actions: Column, strong: Column, service: Column) -> Column:
    """A strong cue for actions that the service does not have."""
    return strong & (F.size(actions) > 0) & (F.size(service) > 0) & ~F.arrays_overlap(actions, service)
