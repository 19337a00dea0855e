"""Benchmark decontamination by template windows, with DataFrame functions only.

Words of texts and benchmark items become template tokens: numbers (digits or number words), names (capitalised within a
sentence, not in capitals) and units turn into typed placeholders. Windows of WINDOW tokens of the items are hashed and
joined with the documents' windows as these are made, so document windows are not shuffled. Matches that lie on one
alignment of item and document are gathered, and their slots are checked: an item's value in a slot must always stand for
the same document value. So a question whose numbers or names were replaced is still found, and a chance match of
templates is not. A document contains an item if COVERED of its windows match, or a passage of VERBATIM words word by word.

Which words are names depends on capitals and on where sentences end. An item is therefore hashed in three readings: as
written, without names (as in a copy in small letters), and with names at the starts of sentences too (as in a copy
without stops). A window with more than half placeholders says too little alone: it is compared by its values. An item
with such windows and LITERAL words or more that are no placeholders is found in other numbers too, where its whole
template stands: its window with the most words leads to the places, and there every token and all slots are compared.
An item of fewer than LEAST words is found where a sentence, or several, have its words and no more: a window of its
length that begins where a sentence does and ends where one does.

Cases: null text has no windows; an item of fewer than WINDOW words has one window of all of them; an item without a
word is never found; rows that share a doc_id count as one document, but keep_clean judges each row; items that share an
id as one item; empty tables give no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small

WINDOW, LEAST, COVERED, VERBATIM, LITERAL = 8, 5, 0.5, 25, 3  # WINDOW is 8 at most: windows are made of parts of 1, 2 and 4
#: Share of an item's slots that must map one value to one value.
CONSISTENT = 0.9

# Signs that are no part of a word, units, placeholders.
SIGNS = ".,;:!?\"'`()[]{}<>|*#$%&~^_=+/\\-"
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "t", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "pounds", "ounces", "dollars", "euros", "cents", "percent", "degrees", "meters", "metres", "kilometers", "kilograms", "grams", "liters", "litres", "watts", "kw", "kwh", "volts")
#: "one" is left out: it is more often a pronoun.
NUMBERS = ("zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def words(text: Column) -> Column:
    """Runs without white space that hold more than signs."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+"), lambda w: F.btrim(w, F.lit(SIGNS)) != "")


def _is_name(bare: Column, value: Column) -> Column:
    """Capitalised, and not written in capitals: a text in capitals has no names that could be told."""
    return (F.length(bare) > 1) & (F.left(bare, F.lit(1)) != F.left(value, F.lit(1))) & (F.substring(bare, 2, 1 << 30) == F.substring(value, 2, 1 << 30))


def _is_number(value: Column) -> Column:
    return F.left(value, F.lit(1)).between("0", "9") | value.isin(*NUMBERS)


def _token(loose: bool) -> Column:
    """The token of each word: a placeholder for a number, unit or name, else the word's value. loose: a sentence may begin with a name."""

    def token(value: Column, i: Column) -> Column:
        at = F.greatest(i, F.lit(1))
        same = F.element_at("_tl_bare", i + 1) == value
        return (
            F.when(_is_number(value), F.lit(NUMBER))
            .when(value.isin(*UNITS) & (i > 0) & _is_number(F.element_at("value", at)), F.lit(UNIT))
            .when(same if loose else same | (i == 0) | F.element_at("_tl_stop", at), value)
            .when(_is_name(F.element_at("_tl_bare", i + 1), value), F.lit(NAME))
            .otherwise(value)
        )

    return F.transform("value", token)


def _tokens(rows: DataFrame, loose: bool = False) -> DataFrame:
    """rows (with text) and the arrays value (words in lower case, without signs at their ends) and token; loose: and the array loose."""
    rows = rows.withColumn("_tl_word", words(F.col("text")))
    rows = rows.withColumns({"_tl_bare": F.transform("_tl_word", lambda w: F.btrim(w, F.lit(SIGNS))), "_tl_stop": F.transform("_tl_word", lambda w: F.right(w, F.lit(1)).isin(".", "!", "?", ":"))})
    rows = rows.withColumn("value", F.transform("_tl_bare", lambda w: F.lower(w))).withColumn("token", _token(False))
    return (rows.withColumn("loose", _token(True)) if loose else rows).withColumnRenamed("_tl_stop", "stop").drop("_tl_word", "_tl_bare")


def _hashes(rows: DataFrame, sizes: list[int], of: str, to: str) -> DataFrame:
    """rows with an array {to}{N} of hashes of the windows of array of, for each size N, one for each place. A name that a window begins with counts as a word: whether it is one depends on what stands before.

    Hashes of 2, 4, ... tokens are made from two neighbours' hashes, each in a column of its own, so every step is one pass over the array.
    """
    join = lambda x, y: F.xxhash64(x, y)
    shifted = lambda c, by: F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0)))
    first = F.transform(of, lambda t: F.xxhash64(t)) if of == "value" else F.zip_with(of, "value", lambda t, v: F.xxhash64(F.when(t == NAME, v).otherwise(t)))
    rows = rows.withColumns({"_tl_1": F.transform(of, lambda t: F.xxhash64(t)), "_tl_first": first})
    for power in (1, 2):
        rows = rows.withColumn(f"_tl_{2 * power}", F.zip_with(f"_tl_{power}", shifted(F.col(f"_tl_{power}"), power), join))
    for size in sizes:
        # the first token, then the binary parts of what follows it
        rows, at = rows.withColumn("_tl_sum", F.col("_tl_first")), 1
        for power in (4, 2, 1):
            if (size - 1) & power:
                rows = rows.withColumn("_tl_sum", F.zip_with("_tl_sum", shifted(F.col(f"_tl_{power}"), at), join))
                at += power
        rows = rows.withColumn(f"{to}{size}", F.slice("_tl_sum", 1, F.greatest(F.size("_tl_sum") - size + 1, F.lit(0)))).drop("_tl_sum")
    return rows.drop("_tl_first", "_tl_1", "_tl_2", "_tl_4")


def _sentences(hashes: str, n: int) -> Column:
    """Of the hashes of windows of n words, those that begin where a sentence does and end where one does, as windows of kind 2."""
    begins = lambda i: (i == 0) | F.element_at("stop", F.greatest(i, F.lit(1)))
    ends = lambda i: (i + n == F.size("stop")) | F.element_at("stop", i + n)
    made = F.transform(hashes, lambda h, i: F.when(begins(i) & ends(i), F.struct((i + 1).alias("place"), F.lit(n).alias("size"), F.lit(2).alias("kind"), F.xxhash64(h, F.lit(n), F.lit(2)).alias("hash"))))
    return F.array_compact(made)


def _places(rows: DataFrame, keys: list[str], sizes: list[int], plain: list[int], short: list[int], of: str = "token") -> DataFrame:
    """keys, place (from 1), size, kind (0: template, 1: values, 2: sentences) and hash of every window: templates of the sizes, values of the sizes plain, sentences of the sizes short. Only hashes are exploded: a row never carries its text's arrays along, and it is read once."""
    rows = _hashes(rows, sizes, of, "_tl_t")
    if plain or short:
        rows = _hashes(rows, [*plain, *short], "value", "_tl_v")
    lists = [(f"_tl_t{n}", n, 0) for n in sizes] + [(f"_tl_v{n}", n, 1) for n in plain]
    window = lambda n, kind: lambda h, i: F.struct((i + 1).alias("place"), F.lit(n).alias("size"), F.lit(kind).alias("kind"), F.xxhash64(h, F.lit(n), F.lit(kind)).alias("hash"))
    each = [F.transform(c, window(n, kind)) for c, n, kind in lists] + [_sentences(f"_tl_v{n}", n) for n in short]
    # outer: else a filter on the array's size is inferred and pushed below, with all steps written into it
    return rows.select(*keys, F.explode_outer(each[0] if len(each) == 1 else F.concat(*each)).alias("w")).where("w IS NOT NULL").select(*keys, "w.*")


def _slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _item_windows(own: DataFrame, sizes: list[int]) -> DataFrame:
    """item_id, item_place, size, kind, hash, anchor of the windows by which an item (item_id, least, value, token, loose, stop) is found, in its three readings. anchor: the window with the most words of an item that is found by its whole template, where it is compared by its values otherwise."""
    bare = F.zip_with("token", "value", lambda t, v: F.when(t == NAME, v).otherwise(t))
    readings = F.array(F.struct(F.lit(1).alias("no"), F.col("token").alias("as")), F.struct(F.lit(2).alias("no"), bare.alias("as")), F.struct(F.lit(3).alias("no"), F.col("loose").alias("as")))
    read = own.select("item_id", "least", "value", "stop", F.explode(readings).alias("r")).select("item_id", "least", "value", "stop", F.col("r.no").alias("no"), F.col("r.as").alias("token"))
    flags = F.transform("token", _slot)
    # an item is one sentence, whatever stops are in it
    one = F.transform("stop", lambda s, i: i + 1 == F.size("stop"))
    short = list(range(1, LEAST))
    made = _places(read.withColumns({"flags": flags, "stop": one}), ["item_id", "least", "no", "flags"], sizes, sizes, short)
    made = made.where((F.col("size") == F.col("least")) & ((F.col("least") >= LEAST) == (F.col("kind") < 2)))
    slots = F.size(F.filter(F.slice("flags", F.col("place"), F.col("size")), lambda x: x))
    made = made.withColumns({"heavy": slots * 2 > F.col("size"), "_tl_words": F.col("size") - slots})
    # a name that a window begins with is compared as a word, but still counts as a slot here
    chosen = ((F.col("kind") == 0) & ~F.col("heavy")) | ((F.col("kind") == 1) & (F.col("no") == 1) & F.col("heavy")) | ((F.col("kind") == 2) & (F.col("no") == 1))
    told = made.where(chosen).select("item_id", "place", "size", "kind", "hash", F.lit(False).alias("anchor"))
    literal = F.size(F.filter("flags", lambda x: ~x)) >= LITERAL
    best = made.where((F.col("kind") == 0) & (F.col("no") == 1) & literal).groupBy("item_id").agg(F.max_by(F.struct("place", "size", "kind", "hash", "heavy"), F.struct("_tl_words", -F.col("place"))).alias("w"), F.bool_or("heavy").alias("any"))
    best = best.where("any").select("item_id", "w.place", "w.size", "w.kind", "w.hash", F.lit(True).alias("anchor"))
    return told.unionByName(best).withColumnRenamed("place", "item_place").distinct()


def _row(id_col: str, text_col: str) -> Column:
    """The key of a row: equal rows have one key, and rows that share no more than the id have keys of their own."""
    return F.xxhash64(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _by_template(hits: DataFrame, own: DataFrame, some: DataFrame) -> DataFrame:
    """doc_id, row, item_id, n_slots, same: where every token of an item with an anchor stands at an alignment, and its slots are consistent. The item's first word may differ in what it counts as: what stands before decides."""
    led = hits.where("anchor").select("doc_id", "row", "item_id", "shift").distinct()
    tokens = own.select("item_id", F.posexplode("token").alias("at", "item_token"), "value", F.size("token").alias("n")).select("item_id", "n", (F.col("at") + 1).alias("at"), "item_token", F.get("value", F.col("at")).alias("item_value"))
    asked = led.join(tokens, "item_id").withColumn("place", F.col("at") + F.col("shift"))
    fits = (F.col("item_token") == F.col("token")) | ((F.col("at") == 1) & (F.col("item_value") == F.col("value")))
    keys = ["doc_id", "row", "item_id", "shift", "n"]
    slot = F.when(_slot(F.col("item_token")), F.col("item_value"))
    each = asked.join(some, ["row", "place"]).groupBy(*keys, slot.alias("slot")).agg(F.count_if(fits).alias("fit"), F.count_distinct("value").alias("values"), F.min(F.col("item_value") == F.col("value")).alias("same"))
    known = F.col("slot").isNotNull()
    whole = each.groupBy(*keys).agg(F.sum("fit").alias("fit"), F.count_if(known).alias("n_slots"), F.avg(F.when(known, (F.col("values") == 1).cast("double"))).alias("consistent"), F.min("same").alias("same"))
    return whole.where((F.col("fit") == F.col("n")) & (F.coalesce("consistent", F.lit(1.0)) >= CONSISTENT)).select("doc_id", "row", "item_id", "n_slots", "same")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", by: str = "doc_id") -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, n_slots, verbatim, for each document and item that it contains. by: what counts as one document, doc_id or row (the key of a row, then in place of doc_id)."""
    own = _tokens(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), loose=True).where(F.size("token") > 0)
    own = materialize(own.select("item_id", "value", "token", "loose", "stop", F.least(F.size("token"), F.lit(WINDOW)).alias("least")), "items")
    slots = own.select("item_id", F.posexplode_outer(F.arrays_zip("token", "value")).alias("at", "z")).where(_slot(F.col("z.token")))
    slots = materialize(slots.select("item_id", (F.col("at") + 1).alias("at"), F.col("z.value").alias("item_value")).distinct(), "slots")
    windows = materialize(_item_windows(own, list(range(LEAST, WINDOW + 1))), "windows")
    total = windows.where("NOT anchor").groupBy("item_id").agg(F.countDistinct("item_place").alias("n_windows"))
    # at most one for each size and kind
    used = [(r["kind"], r["size"]) for r in windows.select("kind", "size").distinct().collect()]
    sizes, plain, short = (sorted(n for k, n in used if k == kind) for kind in (0, 1, 2))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _row(id_col, text_col).alias("row"))
    seen = _places(_tokens(read), ["doc_id", "row"], sizes or [WINDOW], plain, short).drop("size", "kind")
    hits = seen.join(small(windows), "hash").select("doc_id", "row", "item_id", "item_place", "size", "anchor", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = materialize(hits, "hits")
    told = hits.where("NOT anchor").drop("anchor")

    # what stands in the document where an item has a slot
    aligned = ["row", "item_id", "shift"]
    asked = told.select(*aligned, F.explode(F.sequence("item_place", F.col("item_place") + F.col("size") - 1)).alias("at")).distinct()
    asked = materialize(asked.join(slots, ["item_id", "at"]).withColumn("place", F.col("at") + F.col("shift")), "asked")
    rows = asked.select("row").unionAll(hits.where("anchor").select("row")).distinct()
    some = read.join(small(materialize(rows, "rows")), "row", "left_semi")
    some = _tokens(some).select("row", F.posexplode_outer(F.arrays_zip("value", "token")).alias("place", "z")).select("row", (F.col("place") + 1).alias("place"), "z.value", "z.token").distinct()
    some = materialize(some, "words")
    filled = asked.join(some, ["row", "place"]).groupBy(*aligned, "item_value").agg(F.count_distinct("value").alias("n"), F.min(F.col("item_value") == F.col("value")).alias("same"))
    filled = filled.groupBy(*aligned).agg(F.count(F.lit(1)).alias("n_slots"), F.avg((F.col("n") == 1).cast("double")).alias("consistent"), F.min("same").alias("same"))
    # a text that was cut or enlarged inside an item has several alignments: their windows add up
    good = told.join(filled, aligned, "left").where(F.coalesce("consistent", F.lit(1.0)) >= CONSISTENT)
    each = good.groupBy("doc_id", *aligned, "n_slots", "same").agg(F.collect_set("item_place").alias("places"))
    run = F.max(F.when(F.coalesce("same", F.lit(True)), F.size("places")).otherwise(0))
    found = each.groupBy(by, "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"), F.coalesce(F.max("n_slots"), F.lit(0)).cast("long").alias("n_slots"), F.min(F.coalesce("same", F.lit(True))).alias("verbatim"), run.alias("run"))
    found = found.join(total, "item_id").where((F.col("n_matched") / F.col("n_windows") >= COVERED) | (F.col("run") > VERBATIM - WINDOW))
    # a whole template counts as all windows
    whole = _by_template(hits, own, some).groupBy(by, "item_id").agg(F.max("n_slots").alias("n_slots"), F.min("same").alias("verbatim")).join(total, "item_id")
    columns = [by, "item_id", "n_windows", "n_matched", "n_slots", "verbatim"]
    both = found.select(*columns).unionByName(whole.withColumn("n_matched", F.col("n_windows")).select(*columns))
    both = both.groupBy(by, "item_id", "n_windows").agg(F.max("n_matched").alias("n_matched"), F.max("n_slots").alias("n_slots"), F.min("verbatim").alias("verbatim"))
    return both.select(by, "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), "n_slots", "verbatim")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that contain an item; a row is judged by its own text, whatever its id."""
    gone = materialize(leaks(docs, items, id_col, text_col, by="row").select(F.col("row").alias("_tl_row")).distinct(), "dropped")
    return docs.withColumn("_tl_row", _row(id_col, text_col)).join(small(gone), "_tl_row", "left_anti").select(*docs.columns)
