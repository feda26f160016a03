"""Quality rules as a cascade."""

import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """Features by their definitions, with lists and loops."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered),
        "n_letterless": sum(not any(c.isascii() and c.isalpha() or ord(c) >= 128 for c in w) for w in words),
        "n_shouted": sum(sum("A" <= c <= "Z" for c in w) >= 2 and not any("a" <= c <= "z" for c in w) for w in words),
        "most_frequent": max(map(words.count, words), default=0),
    }


TEXTS = st.lists(st.sampled_from(["a", "b", "ab", "THE", "é", "x1", "#", "12", "\n", " ", "\t", "\x85", " ", "🎉", "<b>"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(["", " "]), st.sampled_from([3, 1 << 22]))
def test_features_are_those_defined(parts, glue, section):
    before, cascade.SECTION = cascade.SECTION, section
    try:
        text = glue.join(parts)
        made = cascade.Features(text)
        assert {k: getattr(made, k) for k in plain(text)} == plain(text)
    finally:
        cascade.SECTION = before


def test_every_feature_is_declared_after_its_parts():
    for k, (name, parts) in enumerate(cascade.FEATURES.items()):
        assert set(parts) <= set(list(cascade.FEATURES)[:k]) and hasattr(cascade.Features, name)


def rule(name, *needs):
    return cascade.Rule(name, needs, lambda f: False)


def sample(outcomes, **seconds):
    """A sample table: outcome bits -> rows, and seconds per feature and row."""
    rows = [[o, n, *[seconds.get(f, 0.0) * n for f in cascade.FEATURES]] for o, n in outcomes.items()]
    return pd.DataFrame(rows, columns=["outcome", "n", *cascade.FEATURES])


def test_rules_are_ordered_by_rejection_per_cost():
    a, b, c = rule("a", "lines"), rule("b", "n_symbols"), rule("c", "word_chars")
    seen = sample({0b001: 30, 0b010: 10, 0b100: 20, 0: 40}, lines=6.0, n_symbols=1.0, word_chars=1.0)
    assert [s.rule.name for s in cascade.order_rules(seen, [a, b, c])] == ["c", "b", "a"]
    # what is made anyway is free
    assert [s.rule.name for s in cascade.order_rules(seen, [a, b, c], free=("lines",))] == ["a", "c", "b"]


def test_selectivity_counts_only_what_is_left():
    a, b, c = rule("a", "lines"), rule("b", "n_symbols"), rule("c", "word_chars")
    # b rejects 39, but all of them are among the 40 that a rejects
    seen = sample({0b011: 39, 0b001: 1, 0b100: 5, 0: 55}, lines=1.0, n_symbols=1.0, word_chars=1.0)
    steps = cascade.order_rules(seen, [a, b, c])
    assert [s.rule.name for s in steps] == ["a", "c", "b"]
    assert [round(s.rejection, 3) for s in steps] == [0.4, round(5 / 60, 3), 0.0]


def test_shared_features_are_paid_once():
    a, b = rule("a", "n_letterless"), rule("b", "n_shouted")
    seen = sample({0b01: 10, 0b10: 10, 0: 80}, words=5.0, counts=1.0, n_letterless=0.5, n_shouted=0.5)
    first, second = cascade.order_rules(seen, [a, b])
    assert first.seconds == pytest.approx(6.5, abs=1e-3) and second.seconds == pytest.approx(0.5, abs=1e-3)


def test_no_sample_keeps_the_order_declared():
    assert [s.rule for s in cascade.order_rules(sample({}), cascade.RULES)] == list(cascade.RULES)


GOOD = "this is a fair text on the old town and its river " + " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))


def test_short_circuit_stops_at_the_first_rejection():
    tried = []
    rules = [cascade.Rule(n, (), lambda f, n=n: tried.append(n) or n == "second") for n in ("first", "second", "third")]
    steps = [cascade.Step(r, 0.0, 0.0) for r in rules]
    assert cascade.verdict(cascade.Features("x"), steps) == ("second", 2) and tried == ["first", "second"]


def test_verdicts_do_not_depend_on_the_order(table):
    shout = " ".join(w.upper() for w in GOOD.split())
    rows = [(1, GOOD), (2, GOOD + " ###" * 9), (3, "a b " * 40), (4, shout), (5, GOOD + " 12" * 30), (6, "x " * 20 + GOOD), (7, GOOD + " z" * 40), (8, GOOD + "wwwwwwwwww" * 80)]
    docs = table(rows)
    want = {r.doc_id: r.kept for r in cascade.rate(docs).collect()}
    assert want == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False}
    for rules in (cascade.MORE, cascade.MORE[::-1]):
        steps = [cascade.Step(r, 0.0, 0.0) for r in rules]
        assert {r.doc_id: r.kept for r in cascade.rate(docs, steps).collect()} == want
    kept = cascade.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6]


def test_odd_rows(table, odd):
    rows = cascade.rate(table(odd)).collect()
    assert len(rows) == len(odd) and not any(r.kept for r in rows)
    assert sorted((r.doc_id, r.n_words) for r in rows if r.doc_id is not None)[-1] == (6, 30_000)
    assert [r.n_repeat_words for r in rows if r.doc_id == 6] == [30_000]
    assert cascade.rate(table([])).collect() == [] and cascade.keep_good(table([])).collect() == []


def test_sample_is_bounded_and_covers_all_rules(table):
    docs = table([(i, GOOD if i % 3 else "only four words here") for i in range(600)])
    seen = cascade.estimate(docs, rows=100)
    assert 50 < seen["n"].sum() < 160 and set(seen["outcome"]) == {0, 1}
    steps = cascade.plan(docs, rows=100)
    assert {s.rule.name for s in steps} == {r.name for r in cascade.RULES} and steps[0].rule.name == "short"
