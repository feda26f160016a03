"""Mixing, decontamination and line windows."""

import hashlib

import pytest

from panelspark.llm import decontaminate, lines, mixing


def targets(sizes, most=3.0):
    """By the words of the contract: cap, reshare, until none is above."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_words_taken(table):
    rows = [(i, "w " * (1 + i % 40), "en", s) for s, n in (("a", 30), ("b", 900), ("c", 200), ("d", 5), (None, 60)) for i in range(n)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = mixing.mix_sources(table(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 80
        assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in own)
    again = mixing.mix_sources(table(rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_odd_rows(table, odd):
    got = mixing.mix_sources(table([*odd, (9, None, "en", None), (10, "", "en", "empty")])).collect()
    assert len(got) == len(odd) + 2 and all(r.taken is not None for r in got)
    assert [r.target for r in got if r.source == "empty"] == [0.0]
    assert mixing.mix_sources(table([])).collect() == []
    docs = table(odd)
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {i for i, _ in odd}


ITEM = "If Anna has 12 apples and gives Bob 5 apples, how many apples has Anna left after 3 days?"


def flagged(spark, table, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_ids) for r in decontaminate.decontaminate(table(rows), bench).collect() if r.contaminated}


def test_reparameterised_question_is_caught(spark, table):
    other = ITEM.replace("Anna", "Carla").replace("12", "40").replace("5", "9").replace("3", "7")
    broken = ITEM.replace("has Anna left", "has Dora left")  # the second Anna is another name
    rows = [
        (1, f"Before it. {ITEM} And after."), (2, f"so here, {other.replace('If', 'if')}"), (3, broken.replace("?", "") + " and 1 2 3"),
        (4, "12 5 3 9 8 7 6 5 4 3 2 1 " * 5), (5, "If you have apples then eat them."), (6, ITEM.upper().lower()),
    ]
    got = flagged(spark, table, rows, [(7, ITEM), (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (9, "too short")])
    assert {(1, "7"), (2, "7")} <= got and not any(d in (3, 4, 5) for d, _ in got)


def test_leaks_odd_rows(spark, table, odd):
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "one two three four five six")]
    rows = [*odd, (20, ITEM), (20, ITEM), (20, "clean"), (None, ITEM), (21, "zero one two three four five six seven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(table(rows), bench).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got if r.contaminated) == ["20", "20", "21", "None"]
    stage = decontaminate.decontaminate_stage(table(rows), bench)
    assert stage.columns == table(rows).columns and stage.count() == len(rows) - 4
    assert not any(r.contaminated for r in decontaminate.decontaminate(table(rows), bench.filter("false")).collect())
    assert decontaminate.decontaminate(table([]), bench).collect() == []


def brute_lines(rows, k=3):
    first, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        text = rows[i][1] or ""
        ls, gone = text.split("\n"), set()
        for p in range(len(ls) - k + 1):
            w = "\n".join(ls[p : p + k])
            if w.strip() and first.setdefault(w, (i, p)) != (i, p):
                gone |= set(range(p, p + k))
        kept = "\n".join(x for p, x in enumerate(ls) if p not in gone)
        out[i] = (rows[i][0], len(ls) if text else 0, len(gone), kept)
    return sorted(out.values(), key=str)


def test_line_windows(table, odd):
    rows = [(1, "a\nb\nc\nd\na\nb\nc"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, "\n\n\n\n"), (5, "q\na\nb\nx\na\nb\nq"), (6, "b\nc\nd\nb\nc\nd")]
    rows += [(i, t) for i, t in [(20, None), (21, ""), (None, "m\nn\no"), (22, "m\nn\no\np")]]
    got = lines.dedup_lines(table(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)
    assert len(lines.dedup_lines(table(odd)).collect()) == len(odd)
    assert lines.dedup_lines(table([])).collect() == []
    assert hashlib.md5(got[0].kept_text.encode()).hexdigest()


def test_verbatim_copies_do_not_depend_on_what_stands_before(spark, table):
    items = [(1, "Name the largest moon of Saturn now"), (2, "Which river flows through the old town of Basel and then on to the sea"), (3, "Seven grey geese fly over Lake Zurich every cold morning")]
    rows = [(i, before + text + after) for i, text in items for before, after in (("", ""), ("Question ", " please"), ("and so\n", "."), ("x. ", "!"))]
    rows += [(i, text.lower()) for i, text in items] + [(i, "so " + text.replace(" ", " \n ").upper()) for i, text in items]
    got = decontaminate.decontaminate(table([*rows, (9, "Name the largest moon, of course; the old town of Basel")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.item_ids == str(r.doc_id) for r in got if r.doc_id != 9) and [r.contaminated for r in got if r.doc_id == 9] == [False]


def test_exchanged_name_at_the_start_is_caught(spark, table):
    rows = [(1, "It says: Carla has 40 apples in the basket"), (2, "Carla has 40 apples in the basket"), (3, "then Carla has 40 apples in the basket"), (4, "the cat has 40 apples in the basket")]
    assert flagged(spark, table, rows, [(7, "Anna has 12 apples in the basket")]) == {(1, "7"), (2, "7"), (3, "7")}


def test_dense_and_short_items_are_found_by_their_values(spark, table):
    items = [
        (1, "Compute 3 + 4 * 12 - 7"), (2, "What is 2 + 2?"), (3, "Add 17 and 25, 38 and 41, 56 and 67 now"),
        (4, "1 2 4 8 16 32 add the next two numbers here"), (5, "Paris"), (6, "?!"),
    ]
    rows = [(i, f"so here it is: {text} and more") for i, text in items[:5]]
    rows += [(11, "so here it is: Compute 3 + 4 * 12 - 8"), (12, "what is 2 - 2"), (13, "Add 18 and 24, 39 and 40, 57 and 66 now"), (14, "comparison"), (15, "?!")]
    rows += [(16, "so 3 5 7 9 11 13 add the next two numbers here")]
    assert flagged(spark, table, rows, items) == {(i, str(i)) for i in range(1, 6)} | {(16, "4")}


def test_one_odd_slot_does_not_hide_a_long_copy(spark, table):
    long = (
        "In the year 1871 the old mill of Anna was sold to a baker, who kept the wheel turning for the whole village. "
        "Later on it was Anna again who bought it back in 1871 and let the children of the village play on the stones."
    )
    slim = "from Anna 12 went to Bob 15 for Anna 12 and Bob 15 gave Carl 18 to Dora 21 with Emil 24 near Fred 27 by"
    rows = [
        (1, long), (2, long.replace("was Anna again", "was Anne again")), (3, long.replace("1871 and", "1781 and")),
        (4, slim.replace("by", "on").replace("for Anna 12", "for Anna 13")),
        (5, "In the year 1871 the old mill of Anna was gone. Nobody bought it back in 1900 or let it"),
    ]
    got = flagged(spark, table, rows, [(7, long), (8, slim)])
    assert {d for d, _ in got} == {1, 2, 3, 4}


def test_mixed_rows_are_those_drawn_even_under_one_id(table):
    rows = [(None if i % 2 else 5, "w " * (1 + i % 7) + f"x{i}", "en", s) for i, s in enumerate(["a", "b", "b", "b", "b", "c"] * 60)]
    docs, want, got = table(rows), {}, {}
    for r in mixing.mix_sources(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in mixing.mix_stage(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == want
