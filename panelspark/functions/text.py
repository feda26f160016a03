"""Small text expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.params import CONNECTORS, FACTOR_TERMS

# fixed values: characters that separate words, and all others (common ones first, which matches faster)
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = (
    r"\x21-\x84\xa1-\u167f\x00-\x08\x0e-\x1b\x86-\x9f\u1681-\u1fff\u200b-\u2027\u202a-\u202e"
    r"\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}"
)


# the same white space, character by character
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(SPACES))


def base_of(pair: Column) -> Column:
    """First three letters of a pair name."""
    return F.substring(pair, 1, 3)


def quote_of(pair: Column) -> Column:
    return F.substr(pair, F.lit(4))


def label(model: Column, config: Column, style: str = "brackets") -> Column:
    """``model (config)`` or ``model::config``."""
    if style == "brackets":
        return F.concat(model, F.lit(" ("), config, F.lit(")"))
    return F.concat_ws("::", model, config)


def p_text(p: Column) -> Column:
    """p-value as text: n/a, p<0.001 or p=0.xxx."""
    return (
        F.when(p.isNull() | F.isnan(p), F.lit("n/a"))
        .when(p < 0.001, F.lit("p<0.001"))
        .otherwise(F.format_string("p=%.3f", p))
    )


def words(text: Column) -> Column:
    """Words of a text, split at white space of any kind."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{NOT_SPACE}]+"))


def shorten(text: Column, limit: int) -> Column:
    """Texts over ``limit`` characters are cut three short of it and marked with dots."""
    cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


@lru_cache(maxsize=16)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        made.add_word(term, k)
    made.make_automaton()
    return made


def found_terms(lowered: Column, terms: Sequence[str]) -> Column:
    """(terms, words): the different terms that occur in a lower-cased text, as substrings, and its number of words.

    One automaton reads each text once, whatever the number of terms, in Arrow batches; built-in
    expressions would read it once per term. Terms inside other terms are found as well. The terms are in the
    order given; null texts give null.
    """
    known = tuple(dict.fromkeys(terms))

    @F.pandas_udf("terms array<string>, words int")
    def find(texts: pd.Series) -> pd.DataFrame:
        automaton = _automaton(known) if known else None
        rows = [
            (None, None) if t is None
            else ([known[k] for k in sorted({k for _, k in automaton.iter(t)})] if automaton else [], len(t.split()))
            for t in texts
        ]
        return pd.DataFrame(rows, columns=["terms", "words"]).astype({"words": "Int32"})

    return find(lowered)


def factor_types(found: Column, terms: Mapping[str, Sequence[str]] = FACTOR_TERMS) -> Column:
    """Categories with at least one term among the terms found."""
    named = [F.when(F.arrays_overlap(found, F.array(*[F.lit(t) for t in ts])), F.lit(c)) for c, ts in terms.items()]
    return F.array_compact(F.array(*named))


def _hits(found: Column, terms: Sequence[str]) -> Column:
    """How many of the terms, repeats counted, are among those found."""
    weights = Counter(terms)
    if max(weights.values(), default=0) < 2:
        return F.size(F.array_intersect(found, F.array(*[F.lit(t) for t in weights])))
    return reduce(lambda a, b: a + b, [F.array_contains(found, t).cast("int") * n for t, n in weights.items()])


def coherence(
    text: Column,
    n_words: Column,
    found: Column,
    terms: Mapping[str, Sequence[str]] = FACTOR_TERMS,
    connectors: Sequence[str] = CONNECTORS,
) -> Column:
    """0-1 score from length, connectors and terms found; texts under ten characters score 0."""
    length = F.least(F.lit(0.3), n_words / F.lit(50) * 0.3)
    links = F.least(F.lit(0.4), _hits(found, connectors) * 0.1)
    domain = F.least(F.lit(0.3), _hits(found, [t for ts in terms.values() for t in ts]) * 0.05)
    return F.when(F.length(text) < 10, F.lit(0.0)).otherwise(F.round(length + links + domain, 3))


def title_heads(titles: Column) -> Column:
    """First four words of each title, lower case.  Make them once per list of articles."""
    return F.transform(titles, lambda t: F.slice(words(F.lower(t)), 1, 4))


def grounding(lowered: Column, refs: Column, heads: Column) -> Column:
    """Share of articles an explanation refers to.

    With references: valid numbers over all articles.  Without: articles of whose
    title one of the first four words (``heads``) occurs in the text.
    """
    total = F.size(heads)
    valid = F.size(F.filter(refs, lambda r: (r >= 1) & (r <= total)))
    named = F.filter(heads, lambda ws: F.exists(ws, lambda w: F.contains(lowered, w)))
    return F.when((total > 0) & (F.size(refs) > 0), valid / total).otherwise(
        F.size(named) / F.greatest(total, F.lit(1))
    )
