"""Identifier and query-text functions: segments, stems, match scores, fuzzy scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Words that queries drop.
STOP_WORDS = (
    "a an the is are was were be been in on at to for of by with from and or not but if then else when it its this that "
    "these those do does did has have had can could will would shall should may might must i you he she we they me him "
    "her us them my your his our their what which who whom where how why all any both each few more most no some such "
    "only own same so than too very just about into over also new get got set"
).split()

#: Where an identifier splits: between runs of letters and digits, before a capital after a small letter or digit, and before the last capital of a run.
_SPLIT = r"[^\p{L}\p{N}]+|(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def segments(name: Column) -> Column:
    """Lower-case word segments of an identifier: 2 to 32 characters, not all digits, 12 at most."""
    parts = F.split(name, _SPLIT)
    good = F.filter(parts, lambda s: F.length(s).between(2, 32) & ~s.rlike(r"^\p{N}+$"))
    return F.slice(F.transform(good, F.lower), 1, 12)


def words_of_query(text: str) -> list[str]:
    """White-space words, trimmed of ASCII punctuation but the underscore, lower-cased, without stop words."""
    edge = r"""[!-/:-@\[-^`{-~]+"""
    words = (re.sub(rf"^{edge}|{edge}$", "", w).lower() for w in text.split())
    return [w for w in words if w and w not in STOP_WORDS]


def query_words(text: Column) -> Column:
    """words_of_query as a column."""
    trimmed = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"""^[!-/:-@\[-^`{-~]+|[!-/:-@\[-^`{-~]+$""", "")))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(trimmed, lambda w: (w != "") & ~F.array_contains(stops, w))


def stem(word: Column) -> Column:
    """Suffix rules in order, the first that fits; lengths in bytes. `ing` and `ed` undouble the last letter."""
    w = F.lower(word)
    size = F.octet_length(w)
    short = size.between(6, 9)
    cut = lambda n: F.left(w, F.length(w) - n)
    undoubled = lambda base: F.when(F.right(base, F.lit(1)) == F.right(F.left(base, F.length(base) - 1), F.lit(1)), F.left(base, F.length(base) - 1)).otherwise(base)
    plural = cut(1)
    return (
        F.when(size <= 3, w)
        .when(w.endswith("ing") & short, undoubled(cut(3)))
        .when(w.endswith("ed") & (size > 4), undoubled(cut(2)))
        .when(w.endswith("s") & ~w.endswith("ss") & short, F.when(plural.endswith("e") & (F.length(plural) > 2), cut(2)).otherwise(plural))
        .when(w.endswith("tion") & size.between(9, 14), F.concat(cut(3), F.lit("e")))
        .when(w.endswith("ment") & short, cut(4))
        .when(w.endswith("ly") & (size > 4), cut(2))
        .when(w.endswith("ies") & (size > 4), F.concat(cut(3), F.lit("y")))
        .otherwise(w)
    )


def word_starts(name: Column) -> Column:
    """Lower-case first letters of the words of a camel-case or underscored name, as one string."""
    spaced = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|_+", " ")
    return F.lower(F.array_join(F.transform(F.filter(F.split(spaced, " "), lambda s: s != ""), lambda s: F.left(s, F.lit(1))), ""))


def match_score(name: Column, prefix: str) -> Column:
    """0 for a prefix, 1 for an acronym of word starts, 2 for a substring, null for no match."""
    low = prefix.lower()
    acronym = ".*" + ".*".join(re.escape(c) for c in low) + ".*"
    return F.when(F.lower(name).startswith(low), 0).when(word_starts(name).rlike(f"^{acronym}$"), 1).when(F.lower(name).contains(low), 2)


def is_screaming_snake(name: Column) -> Column:
    return name.rlike(r"\p{L}") & name.rlike(r"^[\p{Lu}_0-9]+$")


def fuzzy_score(name: Column, query: str) -> Column:
    """Mean over the query's words of 0.7 + 0.2 * gap + 0.01 * (consecutive letters); 0 if one is no subsequence.

    The gap term uses the first place of the word's first letter and the last place of its last letter.
    """
    low = F.lower(name)
    tokens = query.lower().split()
    if not tokens:
        return F.lit(0.0)
    total, all_there = F.lit(0.0), F.lit(True)
    for token in tokens:
        subsequence = ".*".join(re.escape(c) for c in token)
        all_there = all_there & low.rlike(f"(?s){subsequence}") & (F.octet_length(low) >= len(token.encode()))
        first = F.instr(low, token[0]) - 1
        last = F.length(low) - F.instr(F.reverse(low), token[-1])
        span = (last - first).cast("double")
        gap = F.when(span > 0, 1 - (span - len(token)) / (span + 1)).otherwise(1.0)
        total = total + F.least(F.lit(1.0), 0.7 + 0.2 * gap + 0.1 * _consecutive(low, token))
    return F.when(all_there, total / len(tokens)).otherwise(0.0)


def _consecutive(text: Column, token: str) -> Column:
    """A tenth for each letter that the leftmost match takes right after the one before."""
    letters = F.array(*[F.lit(c) for c in token])
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

    def step(state, letter):
        found = F.call_function("locate", letter, text, state["at"] + 1)
        return F.struct(found.alias("at"), (state["sum"] + F.when((state["at"] > 0) & (found == state["at"] + 1), 0.1).otherwise(0.0)).alias("sum"))

    return F.aggregate(letters, start, step)["sum"]


def substituted(signature: Column, mapping: Column) -> Column:
    """Whole identifiers replaced by a map in one pass: what is put in is not replaced again."""
    parts = F.regexp_extract_all(signature, F.lit(r"([A-Za-z_]\w*|[^A-Za-z_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(mapping, t), t)), "")


#: Generic types whose single argument is an element type.
COLLECTIONS = (
    "List MutableList ArrayList Set MutableSet HashSet LinkedHashSet Collection MutableCollection Iterable MutableIterable "
    "Sequence Array Flow StateFlow SharedFlow MutableStateFlow MutableSharedFlow Iterator"
).split()


def collection_element(raw: Column) -> Column:
    """List<Product> gives Product for the known collection types; else null."""
    outer, inner = F.regexp_extract(raw, r"^\s*([A-Za-z_.]+)<", 1), F.regexp_extract(raw, r"<\s*(?:out |in )?([A-Za-z_][\w.]*)", 1)
    return F.when(F.substring_index(outer, ".", -1).isin(COLLECTIONS) & (inner != ""), inner)


def type_leaf(raw: Column) -> Column:
    """The last segment of a type without its arguments and nullability."""
    return F.substring_index(F.regexp_replace(raw, r"<.*|\?$", ""), ".", -1)
