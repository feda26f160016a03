"""Operator 7: benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units (after a
number) turn into typed placeholders, everything else into lower-case words without punctuation.
All windows of `WINDOW` template words are hashed and joined with those of the benchmark; windows
of the same lower-cased words are joined too, whatever their templates. A word that is a name only
because of what stands before it, at the start of an item or a sentence, is tried as both when it
opens a window, and runs of blanks are one blank. Windows that match at the same distance between
document and item lie on one diagonal; a diagonal counts when its windows cover `SHARE` of the
item's words, but no more than `COVER` are asked for, and the slots agree: wherever the item repeats
a value, the document repeats its own value. So a question whose numbers and names were exchanged is
caught, a coincidence of placeholders isn't. A slot that breaks this, where it isn't what the document
mostly has for that value, takes only the windows around it away; the diagonal still counts if the
others cover enough, or if there are `COVER` literal words without any slot.

Null and empty texts are never contaminated. Windows with less than half literal words are found by
their values only, the others on the template; either kind alone can reach its share, of all words
or of the words in windows of the second kind. Items shorter than the window are one window of their
own length. Items with fewer than `LEAST` words cannot be told from ordinary text by a template: they
are found where their words stand in a row with the same values and the text holds the item with the
signs between its words (case, blanks and signs at its ends aside), so an item of one word is found
wherever that word stands. Items without a letter or digit are not searched. Repeated rows get the
same answer each; rows that share an id are told apart by text. An empty benchmark flags nothing.
A null id is an id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import fresh_name, saved

WINDOW = 8
COVER = 13
SHARE = 0.8
LEAST = 5
BROADCAST_ROWS = 1_000_000
MOST_BITS = 20
UNITS = (
    "mm cm dm m km mg g kg t ml cl l s ms min h km/h mph ft inch inches mile miles yard yards pound pounds ounce ounces "
    "litre litres liter liters gram grams metre metres meter meters second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()


def template(text: Column, units: Sequence[str] = UNITS) -> Column:
    """The template words of a text: <n..>, <u..> and <p..> around a value, _ before a capital that begins a sentence."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "<>_", "   "), r"\s+", " ")
    # patterns test a character before they look behind it, which is what most places fail at
    marked = F.regexp_replace(marked, r"[.,](?<=[0-9][.,])(?=[0-9])", "_")
    marked = F.regexp_replace(marked, r"[0-9][0-9_]*", " <n$0> ")
    names = "|".join(sorted(units, key=len, reverse=True))
    marked = F.regexp_replace(marked, rf"(>\s{{1,3}})({names})(?![\p{{L}}\p{{N}}])", "$1<u$2>")
    marked = F.regexp_replace(marked, r"(?=\p{Lu})(?<=[\p{L},;]\s)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "<p$0>")
    marked = F.regexp_replace(marked, r"(?=\p{Lu})(?<![\p{L}\p{M}\p{N}<>_])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "_$0")
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{M}\p{N}<>_]+"), lambda w: w != "")


def _plain(w: Column) -> Column:
    """A template word as it stands in the text."""
    value = F.translate(F.substring(w, 3, 1 << 30), ">", "")
    return F.when(w.startswith("<"), value).when(w.startswith("_"), F.substring(w, 2, 1 << 30)).otherwise(w)


def _kind(w: Column) -> Column:
    """A template word without its value."""
    kind = F.concat(F.substring(w, 1, 2), F.lit(">"))
    return F.when(w.startswith("<"), kind).when(w.startswith("_"), F.substring(w, 2, 1 << 30)).otherwise(w)


def _coded(ws: str) -> dict[str, Column]:
    """Codes of the template words ``ws``, of the words as they stand, and whether a word may be a name or none."""
    return {
        "kinds": F.transform(ws, lambda w: F.xxhash64(_kind(w))),
        "plain": F.transform(ws, lambda w: F.xxhash64(_plain(w))),
        "opens": F.transform(ws, lambda w: w.startswith("_")),
    }


def _keys(i: Column, n: Column) -> tuple[Column, Column, Column]:
    """Hashes of the ``n`` words from place ``i``: as template, with the first word as a name if it may be one, as they stand."""
    first = F.when(F.element_at("opens", i + 1), F.xxhash64(F.concat(F.array(F.xxhash64(F.lit("<p>"))), F.slice("kinds", i + 2, n - 1))))
    return F.xxhash64(F.slice("kinds", i + 1, n)), first, F.xxhash64(F.slice("plain", i + 1, n))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_text, item_twin, length, n_words, usable, ipos, key, typed, pairs) for the windows that can show a leak.

    ``pairs`` has the codes that :func:`places` looks for. A window whose values may differ is ``typed``; the others match the same words only. ``usable``
    is the number of words in windows that are typed.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("item_text")).distinct()
    items = items.withColumn("ws", template(F.col("item_text"))).withColumn("n_words", F.size("ws"))
    items = items.filter("n_words > 0").withColumn("length", F.least("n_words", F.lit(WINDOW)))
    items = items.withColumns({**_coded("ws"), "item_twin": F.xxhash64("item_text")})

    def pairs(i: Column) -> Column:
        """Second and third word as they stand and as template; the first word of windows of one or two."""
        two = [F.struct(F.get(c, i + 1).alias("a"), F.get(c, i + 2).alias("b")) for c in ("plain", "kinds")]
        word = F.get("plain", i)
        return F.when(F.col("length") < 3, F.array(F.struct(word.alias("a"), word.alias("b")))).otherwise(F.array(*two))

    def spot(i: Column) -> Column:
        run = F.slice("ws", i + 1, F.col("length"))
        literal = F.size(F.filter(run, lambda w: ~w.startswith("<"))) * 2
        typed, named, plain = _keys(i, F.col("length"))
        fine = (F.col("n_words") >= LEAST) & (literal >= F.col("length"))
        first = fine & (i == 0) & (literal - 2 >= F.col("length"))
        return F.struct(i.alias("ipos"), F.when(fine, typed).alias("typed"), F.when(first, named).alias("named"), plain.alias("plain"), pairs(i).alias("pairs"))

    spots = F.transform(F.sequence(F.lit(0), F.col("n_words") - F.col("length")), spot)
    items = items.withColumn("spots", F.when(F.col("n_words") > 0, spots))  # filters may move
    fine = F.transform(F.filter("spots", lambda x: x["typed"].isNotNull()), lambda x: F.sequence(x["ipos"], x["ipos"] + F.col("length") - 1))
    items = items.withColumn("usable", F.size(F.array_distinct(F.flatten(fine))))
    rows = items.select("item_id", "item_text", "item_twin", "length", "n_words", "usable", F.explode("spots").alias("x"))
    keys = F.array(*[F.struct(F.col(f"x.{c}").alias("key"), F.lit(c != "plain").alias("typed")) for c in ("typed", "named", "plain")])
    fresh = F.filter(keys, lambda k: k["key"].isNotNull() & (k["typed"] | ~k["key"].eqNullSafe(F.col("x.typed"))))
    rows = rows.select("item_id", "item_text", "item_twin", "length", "n_words", "usable", "x.ipos", "x.pairs", F.explode(fresh).alias("k"))
    return rows.select("item_id", "item_text", "item_twin", "length", "n_words", "usable", "ipos", "k.key", "k.typed", "pairs")


def _bare(text: Column) -> Column:
    """A text in lower case with single blanks, without what is no letter or number at its ends."""
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(low, r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a saved table whose rows have been counted; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _reached(at: Column) -> Column:
    """The places in windows of ``length`` words that begin at ``at``."""
    return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + F.col("length") - 1))))


def _enough(at: Column, typed: Column) -> Column:
    """Whether typed windows hold enough of the words they can hold, or all windows of all words."""
    wanted = [F.least(F.lit(COVER), F.ceil(F.col(c) * SHARE)) for c in ("usable", "n_words")]
    return ((F.size(typed) > 0) & (F.size(_reached(typed)) >= wanted[0])) | (F.size(_reached(at)) >= wanted[1])


def _value(x: Column) -> Column:
    """What the item and the document have in a slot."""
    return F.struct(x["i"].alias("i"), x["d"].alias("d"))


def _pair(a: Column, b: Column, bits: int) -> Column:
    """The bit of two neighbouring codes."""
    return a.bitwiseXOR(F.shiftleft(b, 1)).bitwiseAND(F.lit(bits - 1))


def places(windows: DataFrame) -> Callable[[Column], Column]:
    """A test whether a window of the benchmark can begin at a place of a text (columns kinds and plain).

    Windows of three and more words are known by their second and third word, whose codes as template and as
    they stand set one bit each; shorter ones by their first word. A place without its bit holds
    no window, so nothing is lost, and hardly any place of other texts is hashed. The bits grow with the
    benchmark up to 2^``MOST_BITS``; beyond that more places pass, to the same result.
    """
    pairs = windows.select("length", F.explode("pairs").alias("pair"))
    n = pairs.count()
    bits = 1 << min(MOST_BITS, max(12, (16 * n).bit_length()))
    marked = pairs.select(
        (F.col("length") < 3).alias("short"), F.when(F.col("length") < 3, F.col("pair.a").bitwiseAND(F.lit(bits - 1))).otherwise(_pair(F.col("pair.a"), F.col("pair.b"), bits)).alias("bit")
    ).distinct().collect()  # at most 2 * bits numbers
    maps = {}
    for short in (True, False):
        cells = [0] * (bits >> 6)
        for r in marked:
            if r.short == short:
                cells[r.bit >> 6] |= 1 << (r.bit & 63)
        signed = [c - (1 << 64) if c >> 63 else c for c in cells]
        # literals, which are folded into one constant when the query is planned
        maps[short] = F.expr(f"array({','.join(f"bigint('{c}')" if c == -(1 << 63) else f'{c}L' for c in signed)})") if any(cells) else None

    def held(cells: Column | None, bit: Column) -> Column:
        if cells is None:
            return F.lit(False)
        cell = F.get(cells, F.shiftright(bit, 6).cast("int"))
        return F.coalesce(F.getbit(cell, bit.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))

    def test(i: Column) -> Column:
        out = held(maps[False], _pair(F.get("plain", i + 1), F.get("plain", i + 2), bits))
        out = out | held(maps[False], _pair(F.get("kinds", i + 1), F.get("kinds", i + 2), bits))
        return out | held(maps[True], F.get("plain", i).bitwiseAND(F.lit(bits - 1)))

    return test


def leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, twin, item_id, covered, n_slots) of all leaks; ``docs`` has doc_id, twin and text."""
    windows = saved(benchmark_windows(benchmark, item_col, item_text), "bench-windows")
    lengths = [r.length for r in windows.select("length").distinct().orderBy("length").collect()]  # at most WINDOW values
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, twin long, item_id long, covered int, n_slots int")
    keys = _small(windows.drop("item_text", "pairs"))
    words = docs.select("doc_id", "twin", template(F.col("text")).alias("ws")).select("doc_id", "twin", *[c.alias(k) for k, c in _coded("ws").items()])
    may = places(windows)
    starts = F.filter(F.sequence(F.lit(0), F.size("kinds") - lengths[0]), lambda i: may(i))

    def runs_from(i: Column) -> Column:
        """The windows of every length that begin at a place, with their keys."""
        made = [
            F.when(i + n <= F.size("kinds"), F.struct(F.lit(n).alias("length"), F.array_distinct(F.array_compact(F.array(*_keys(i, F.lit(n))))).alias("ks")))
            for n in lengths
        ]
        return F.transform(F.array_compact(F.array(*made)), lambda x: F.struct(i.alias("pos"), x["length"].alias("length"), x["ks"].alias("ks")))

    # an outer explode: no filter on its input may be derived, which would move below the codes and repeat them per place
    held = F.when(F.size("kinds") >= lengths[0], F.flatten(F.transform(starts, lambda i: runs_from(i))))
    spots = words.select("doc_id", "twin", F.explode_outer(held).alias("x")).filter("x IS NOT NULL")
    spots = spots.select("doc_id", "twin", "x.pos", "x.length", F.explode("x.ks").alias("key"))
    found = spots.join(keys, ["key", "length"])
    steps, typed = F.array_sort(F.collect_set("pos")), F.collect_set(F.when(F.col("typed"), F.col("pos")))
    by = ["doc_id", "twin", "item_id", "item_twin", "n_words", "usable", "length"]
    runs = found.groupBy(*by, (F.col("pos") - F.col("ipos")).alias("shift")).agg(steps.alias("at"), typed.alias("typed"))
    runs = saved(runs.filter(_enough(F.col("at"), F.col("typed"))), "diagonals")
    # the values in the slots: texts of the documents on a diagonal only
    named = docs.withColumnsRenamed({"doc_id": "_id", "twin": "_twin"})
    hot = _small(runs.select("doc_id", "twin").distinct().withColumn("is_hit", F.lit(True)))
    texts = named.join(hot, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_twin") == F.col("twin")))
    texts = texts.dropDuplicates(["_id", "_twin"]).select("_id", "_twin", template(F.col("text")).alias("ws"), _bare(F.col("text")).alias("bare"))
    items = windows.select("item_id", "item_twin", "item_text").distinct().select(
        F.col("item_id").alias("_item"), F.col("item_twin").alias("_item_twin"), template(F.col("item_text")).alias("iws"), _bare(F.col("item_text")).alias("ibare")
    )
    both = runs.join(texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_twin") == F.col("twin")))
    both = both.join(_small(items), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_twin") == F.col("_item_twin")))
    # the few words of a short item count only with the signs between them
    both = both.filter((F.col("n_words") >= LEAST) | F.contains("bare", "ibare"))
    both = both.withColumn("covered", _reached(F.col("at")))
    # what may be a name is a slot too; without an exchange it holds the same word on both sides
    pairs = F.transform(
        "covered",
        lambda p: F.struct(
            p.alias("p"),
            F.regexp_replace(F.element_at("iws", p - F.col("shift") + 1), "^_(.*)$", "<p$1>").alias("i"),
            F.element_at("iws", p - F.col("shift") + 1).startswith("_").alias("word"),
            _plain(F.element_at("ws", p + 1)).alias("d"),
        ),
    )
    both = both.withColumn("slots", F.filter(pairs, lambda x: x["i"].startswith("<")))
    both = both.withColumn("values", F.array_distinct(F.transform("slots", _value)))
    agree = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda x: x["i"])))
    exchanged = F.filter("slots", lambda x: ~x["word"] | (_plain(x["i"]) != x["d"]))
    both = both.withColumns({"agree": agree, "literal": F.size("covered") - F.size(exchanged)})
    # where they do not agree, slots go that hold something else than most slots of their value, with the windows around them
    odd = F.filter(
        "values",
        lambda v: F.size(F.filter("slots", lambda x: _value(x) == v)) * 2 <= F.size(F.filter("slots", lambda x: x["i"] == v["i"])),
    )
    decided = F.col("agree") | (F.col("literal") >= COVER)
    both = both.withColumn("odd", F.when(~decided, odd))
    both = both.withColumn("away", F.transform(F.filter("slots", lambda x: F.array_contains("odd", _value(x))), lambda x: x["p"]))
    for c in ("at", "typed"):
        stays = F.filter(c, lambda p: ~F.exists("away", lambda q: (q >= p) & (q < p + F.col("length"))))
        both = both.withColumn(c, F.when(decided, F.col(c)).otherwise(stays))
    covered = F.when(F.col("agree"), F.size("covered")).when(decided, F.col("literal")).otherwise(F.size(_reached(F.col("at"))))
    return both.filter(decided | _enough(F.col("at"), F.col("typed"))).select(
        "doc_id", "twin", "item_id", covered.alias("covered"), F.size("values").alias("n_slots")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, covered) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("twin", F.xxhash64(F.coalesce("text", F.lit(""))))
    flags = leaks(rows, benchmark).groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("most")
    )
    flags = _small(saved(flags, "flags"))
    joined = rows.drop("text").join(flags, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")), "left")
    clean = F.col("item_ids").isNull()
    return joined.select(
        "doc_id",
        (~clean).alias("contaminated"),
        F.when(clean, 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
        F.coalesce(F.array_join("item_ids", ","), F.lit("")).alias("item_ids"),
        F.coalesce("most", F.lit(0)).cast("long").alias("covered"),
    )


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark was found, with their own columns."""
    rows = docs.select("doc_id", "text").withColumn("twin", F.xxhash64(F.coalesce("text", F.lit(""))))
    leak, own = fresh_name(docs, "leak_id"), fresh_name(docs, "leak_twin")
    found = leaks(rows, benchmark).select(F.col("doc_id").alias(leak), F.col("twin").alias(own)).distinct()
    found = _small(saved(found, "leaks"))
    twin = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(leak)) & (twin == F.col(own)), "left_anti")
