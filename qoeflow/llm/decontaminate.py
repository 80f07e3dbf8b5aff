"""Benchmark decontamination by template canonicalisation, in DataFrame
functions only.

A text's words lose outer punctuation and case; numbers, quantities, units
after a number and capitalised words inside a sentence become the typed
placeholders ``<num> <qty> <unit> <name>``.  Windows of ``n`` such template
words are hashed and hash-joined with the windows of the benchmark items, which
finds questions that were re-parameterised as well as plain copies.  Which words
are names depends on case and on the word before, so that windows of ``n``
literal words without case go into the same join: they find copies in upper,
lower or title case.  For each document, item and shift (where the document's
words lie relative to the item's) the covered words are then compared one by
one: template words or literal words must be equal, and slots must be
consistent, i.e. one value of the item always corresponds to one value of the
document, case aside.

A name or number may have another count of words in the document: windows of
``n`` template words with each run of names or of numbers taken as one are
searched as well, and compared run by run.

A pair is reported when at least ``coverage`` of the item's words or at least
``long_run`` words are covered.  The consistent shifts and windows of a document
and item are united for that, as long as neighbouring shifts differ by no more
than half of the item's words (at least ``n``) and the slots stay consistent.
``covered`` counts the words of one shift's template windows where these reach
that alone, and the united words otherwise.

Only template windows with at least ``literals`` words that are no
placeholders are searched.  Literal windows have no such limit, so that items of
numbers and names are found word for word; an item of fewer than ``n`` words is
searched by one literal window of its whole length.  An item without a searched
template window behind its first word (short questions, arithmetic) has a weak
one: its template window with most literal words, of its whole length where it
is shorter than ``n``, if that has at least ``weak_literals`` of them.  What a weak
window finds counts only where the whole item is there, every word and slot.  As
a capitalised first word is a name inside another sentence, a weak window that
begins with it is searched in both forms.  An item without words has no copies.

Defined results: null text has no words; a null doc_id or item_id is reported
as null; rows equal in id and text give one pair; empty tables give no pairs;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.llm.common import fresh, materialise

N = 8
LITERALS = 5
WEAK_LITERALS = 3
COVERAGE = 0.5
LONG_RUN = 24

#: Units of measure that become ``<unit>`` after a number.
UNITS = ("km", "m", "cm", "mm", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "ft", "feet", "foot",
         "inch", "inches", "yard", "yards", "kg", "g", "mg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs",
         "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres",
         "gallon", "gallons", "cup", "cups", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
         "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
         "percent", "degree", "degrees", "kmh", "mph", "km/h", "m/s", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb",
         "tb", "w", "kw", "v", "volt", "volts", "j", "joule", "joules", "n", "newton", "newtons", "pa", "mol")
#: Kinds of windows: wide ones hold a run taken as one, weak ones (of items only) few literal words.
TEMPLATE, LITERAL, WIDE, WEAK = 0, 1, 2, 3
HOLDERS = ("<num>", "<qty>", "<unit>", "<name>")
RUNS = ("<num>", "<name>")
_OUTER = ".,;:!?\"'()[]{}<>*#&|~`…“”„«»‘’–—"
_NUMBER = "^[-+$€£]?\\d[\\d.,:/]*%?$"
_QUANTITY = "^[-+$€£]?\\d[\\d.,]*\\p{L}+[\\p{L}/]*$"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def _if(condition: Column, a, b=None) -> Column:
    """``a`` or ``b``; for conditions met at every word, as a ``when`` counts its branches at each."""
    return F.call_function("if", condition, *[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once (``transform`` of an array of it would copy the result)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, f)


def _bodies(w: Column) -> Column:
    """The words ``w`` without outer punctuation."""
    def within(x: Column) -> Column:
        return (x >= "a") & (x < "{")
    # most words start and end with a-z
    return F.transform(w, lambda x: _if(within(x) & within(F.substring(x, -1, 1)), x, F.btrim(x, F.lit(_OUTER))))


def _low(w: Column, bodies: Column) -> Column:
    """The literal words without case."""
    return F.transform(bodies, lambda b, i: _if(b == "", F.get(w, i), F.lower(b)))


def _tpl(w: Column, bodies: Column, low: Column) -> Column:
    """The template words."""
    def other(i: Column) -> Column:
        body, word, lower = F.get(bodies, i), F.get(w, i), F.get(low, i)
        plain = F.when(lower.isin(*UNITS) & (i > 0) & F.get(bodies, i - 1).rlike(_NUMBER), "<unit>").otherwise(lower)
        first = F.substring(body, 1, 1)
        capital = (F.upper(first) == first) & (F.lower(first) != first)
        inside = (i > 0) & ~F.get(w, i - 1).rlike("[.!?][\"'”’)]*$")
        return (F.when((body >= "a") & (body < "{"), plain)
                .when(body == "", word)
                .when(body.rlike(_NUMBER), "<num>")
                .when(body.rlike(_QUANTITY), "<qty>")
                .when(capital & inside, "<name>")
                .otherwise(plain))
    # most words start with a-z, are no units and need none of the other tests
    usual = F.zip_with(bodies, low, lambda b, x: _if((b >= "a") & (b < "{") & ~x.isin(*UNITS), x))
    return F.transform(usual, lambda x, i: F.coalesce(x, other(i)))


def _templates(df: DataFrame) -> DataFrame:
    """Adds ``bodies``, ``tpl``, the template words, and ``low``, the literal
    words without case, to the array ``words``."""
    w, b, x = F.col("words"), F.col("bodies"), F.col("low")
    return df.withColumn("bodies", _bodies(w)).withColumn("low", _low(w, b)).withColumn("tpl", _tpl(w, b, x))


def _joined(t: Column, i: Column) -> Column:
    """Whether word ``i`` of the template words ``t`` continues a run of names or numbers."""
    return (i > 0) & (F.get(t, i) == F.get(t, i - 1)) & F.get(t, i).isin(*RUNS)


def _rolled(of: Column, n: int) -> Column:
    """A hash of each ``n`` consecutive entries of the hashes ``of``, from hashes
    of 1, 2, 4... entries (entries behind the last window have no meaning).  A
    slice copies its whole array, so that one a window would cost the square of a
    text's words; all is one expression, as generated code for each step is large."""
    def followed(a: Column, b: Column, at: int) -> Column:
        return F.zip_with(a, F.slice(b, at + 1, F.greatest(F.size(b) - at, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def step(power: Column, width: int, have: Column | None, length: int) -> Column:
        if n & width:
            have, length = (power, width) if have is None else (followed(have, power, length), length + width)
        if 2 * width > n:
            return have
        return _bound(followed(power, power, width), lambda p: step(p, 2 * width, have, length))
    return _bound(of, lambda p: step(p, 1, None, 0))


def _count(size: Column, n: int) -> Column:
    """Number of windows of ``n`` among ``size`` entries."""
    return F.greatest(size - (n - 1), F.lit(0))


def _hashes(tpl: Column, low: Column, n: int, short: list[int], short_weak: list[int]) -> Column:
    """size (of ``tpl``), starts and ends (of the words and runs, if there is a
    run) and wins: hashes of the windows that ``_windows`` lists, kind by kind in
    order of position, null for a window that is left out."""
    def rolled(of: Column, m: int) -> Column:
        return F.slice(_rolled(of, m), F.lit(1), _count(F.size(of), m))

    def of_hashes(h: Column, g: Column) -> Column:
        # hashes are compared first: few neighbours are equal
        runs = F.array_compact(F.transform(h, lambda x, i: _if((x == F.get(h, i - 1)) & _joined(tpl, i), i)))
        starts = _bound(runs, lambda r: F.when(F.size(r) > 0, F.array_except(F.sequence(F.lit(0), F.size(h) - 1), r))
                        .otherwise(F.array().cast("array<int>")))
        return _bound(starts, lambda s: _bound(
            F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(F.size(h))),
            lambda e: F.struct(F.size(h).alias("size"), s.alias("starts"), e.alias("ends"),
                               of_starts(h, g, s, e).alias("wins"))))

    def of_starts(h: Column, g: Column, s: Column, e: Column) -> Column:
        wide = F.transform(rolled(F.transform(s, lambda i: F.get(h, i)), n), lambda x, k: _if(
            F.get(e, k + (n - 1)) - F.get(s, k) > n, x))
        return _bound(rolled(h, n), lambda hn: F.concat(
            hn, F.zip_with(hn, rolled(g, n), lambda x, y: F.nullif(y, x)), wide,
            *[rolled(g, m) for m in short], *[rolled(h, m) for m in short_weak]))
    return _bound(F.transform(tpl, lambda t: F.xxhash64(t)), lambda h: _bound(
        F.transform(low, lambda t: F.xxhash64(t)), lambda g: of_hashes(h, g)))


def _text_hashes(w: Column, n: int, short: list[int], short_weak: list[int]) -> Column:
    """``_hashes`` of words in one expression: no array between is copied into a row."""
    return _bound(w, lambda w: _bound(_bodies(w), lambda b: _bound(_low(w, b), lambda x: _bound(
        _tpl(w, b, x), lambda t: _hashes(t, x, n, short, short_weak)))))


def _windows(df: DataFrame, keep: list[str], hashes: Column, n: int, short: list[int],
             short_weak: list[int]) -> DataFrame:
    """The columns ``keep`` of ``df`` with hash, position, words and kind of each window of
    ``n`` template words, of each that is another one of ``n`` literal words or of
    ``n`` template words with runs of names or numbers taken as one, of each
    window of literal words as long as one of ``short``, and of template words
    as long as one of ``short_weak``; ``hashes`` are ``_hashes`` of the row."""
    # the outer explode keeps the optimiser from copying the window expression
    # into a filter on its size, where it would run once per word
    rows = (df.select(*keep, hashes.alias("x"))
            .select(*keep, "x.size", "x.starts", "x.ends", F.posexplode_outer("x.wins").alias("slot", "win"))
            .filter(F.col("win").isNotNull()))
    # what a window is follows from its place; it is worked out for those that are met
    size, before, found = F.col("size"), F.lit(0), None
    for kind, m in ((TEMPLATE, n), (LITERAL, n), (WIDE, n), *((LITERAL, m) for m in short),
                    *((TEMPLATE, m) for m in short_weak)):
        k = F.col("slot") - before
        start = F.get("starts", k) if kind == WIDE else k
        long = F.get("ends", k + (n - 1)) - F.get("starts", k) if kind == WIDE else F.lit(m)
        before = before + _count(F.size("starts") if kind == WIDE else size, m)
        here = F.struct(start.alias("pos"), long.alias("len"), F.lit(kind).alias("kind"))
        found = F.when(F.col("slot") < before, here) if found is None else found.when(F.col("slot") < before, here)
    return rows.select(*keep, "win", found.alias("w")).select(*keep, "win", "w.pos", "w.len", "w.kind")


def _literal_words(at: Column, length: Column) -> Column:
    """Words of the window of ``tpl`` that are no placeholders."""
    return F.size(F.filter(F.slice("tpl", at + 1, length), lambda t: ~t.isin(*HOLDERS)))


def _weak(items: DataFrame, n: int, literals: int, weak_literals: int) -> DataFrame:
    """win, item_key, at, item_len, item_kind of the weak windows: of each item
    without a searched template window behind its first word."""
    length = F.least(F.lit(n), F.size("tpl"))
    at = F.when(F.size("tpl") > 0, F.sequence(F.lit(0), F.size("tpl") - length)).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(at, lambda i: F.struct(_literal_words(i, length).alias("literals"), i.alias("at"))))
    strong = F.exists(at, lambda i: (i > 0) & (_literal_words(i, F.lit(n)) >= literals))
    found = (items.filter(~strong).select("item_key", "tpl", "bodies", length.alias("item_len"), best.alias("best"))
             .filter(F.col("best.literals") >= weak_literals)
             .select("item_key", "item_len", "best.at", F.slice("tpl", F.col("best.at") + 1, F.col("item_len")).alias("t"),
                     F.substring(F.get("bodies", F.col("best.at")), 1, 1).alias("first")))
    capital = (F.col("at") == 0) & (F.upper("first") == F.col("first")) & (F.lower("first") != F.col("first"))
    named = F.concat(F.array(F.lit("<name>")), F.slice("t", 2, F.greatest(F.col("item_len") - 1, F.lit(0))))
    forms = F.array_distinct(F.when(capital, F.array(F.col("t"), named)).otherwise(F.array(F.col("t"))))
    found = found.withColumn("form", F.explode(forms)).withColumn("f", F.transform("form", lambda t: F.xxhash64(t)))
    # a window's length is one of these
    win = F.coalesce(*[F.when(F.col("item_len") == m, F.get(_rolled(F.col("f"), m), F.lit(0)))
                       for m in range(max(weak_literals, 1), n + 1)])
    return found.select(win.alias("win"), "item_key", "at", "item_len", F.lit(WEAK).alias("item_kind"))


def _tokens(t: Column, w: Column) -> Column:
    """Template word and value of each word or run of some words."""
    every = F.sequence(F.lit(0), F.size(t) - 1)
    first = F.filter(every, lambda i: ~_joined(t, i))
    return F.transform(first, lambda i, k: F.struct(F.get(t, i).alias("t"), F.array_join(F.slice(
        w, i + 1, F.coalesce(F.get(first, k + 1), F.size(t)) - i), " ").alias("v")))


def _consistent(pairs: Column) -> Column:
    """Whether one value of the item always has one value of the document."""
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["a"])))


def _same(pairs: Column) -> Column:
    return F.forall(pairs, lambda x: x["a"] == x["b"])


def _united(pieces: Column) -> Column:
    """Item positions and value pairs of the pieces of a copy, leaving out those
    that contradict the ones before: the largest first, or those with a run
    first (a shift may cut a run), whichever gives more."""
    def add(acc: Column, x: Column) -> Column:
        pairs = F.array_union(acc["pairs"], x["pairs"])
        return F.when(_consistent(pairs), F.struct(F.array_union(acc["p"], x["p"]).alias("p"), pairs.alias("pairs"))
                      ).otherwise(acc)
    none = F.struct(F.array().cast("array<int>").alias("p"),
                    F.array().cast("array<struct<a:string,b:string>>").alias("pairs"))
    ways = [F.aggregate(F.sort_array(x), none, add) for x in (
        pieces, F.transform(pieces, lambda x: F.struct(x["shift"], x["order"], x["p"], x["pairs"])))]
    return F.array_max(F.array(*[F.struct(F.size(w["p"]).alias("n"), w["p"].alias("p"), w["pairs"].alias("pairs"))
                                 for w in ways]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", n: int = N, literals: int = LITERALS,
          coverage: float = COVERAGE, long_run: int = LONG_RUN, weak_literals: int = WEAK_LITERALS) -> DataFrame:
    """row_key (a hash of id and text), doc_id, item_id, item_words, covered,
    coverage, kind ('exact' or 'reparameterised') of each leaked item."""
    items = _templates(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t"))
                       .withColumn("item_key", F.xxhash64("item_id", "t")).dropDuplicates(["item_key"])
                       .withColumn("words", words(F.col("t"))).drop("t"))
    # items too short for a window have one of their whole length
    size = F.size("words")
    short = sorted(r[0] for r in items.filter((size > 0) & (size < n)).select(size).distinct().collect())
    weak = _weak(items, n, literals, weak_literals)
    short_weak = sorted(r[0] for r in weak.filter(F.col("item_len") < n).select("item_len").distinct().collect())
    searched = (_windows(items, ["item_key", "tpl"], _hashes(F.col("tpl"), F.col("low"), n, short, []), n, short, [])
                .filter((F.col("kind") == LITERAL) | (_literal_words(F.col("pos"), F.col("len")) >= literals))
                .filter((F.col("len") >= n) | (F.col("len") == F.size("tpl")))
                .select("win", "item_key", F.col("pos").alias("at"), F.col("len").alias("item_len"),
                        F.col("kind").alias("item_kind")).unionByName(weak))
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key")
    rows = docs.select(key, words(F.col(text_col)).alias("words"))
    seen = _windows(rows, ["row_key"], _text_hashes(F.col("words"), n, short, short_weak), n, short, short_weak)
    kind = F.greatest("kind", "item_kind")
    met = (seen.join(searched, "win")
           .groupBy("row_key", "item_key", (F.col("pos") - F.col("at")).alias("shift"))
           .agg(F.collect_set(F.when(kind == TEMPLATE, F.col("at"))).alias("by_template"),
                F.collect_set(F.when(kind < WIDE, F.col("at"))).alias("by_all"),
                F.collect_set(F.when(kind == WIDE, F.struct("at", "item_len", "len"))).alias("wide"),
                F.max(kind == WEAK).alias("weak")))
    met = materialise(met, "template-windows")       # read twice below, costly to compute
    # the words of candidates only, compared one by one
    texts = (docs.select(key, F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
             .join(met.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"]))
    texts = _templates(texts.select("row_key", "doc_id", words(F.col("t")).alias("words")))
    pair = (met.join(items.select("item_key", "item_id", F.col("low").alias("iw"), F.col("tpl").alias("it")),
                     "item_key")
            .join(texts.select("row_key", "doc_id", F.col("low").alias("dw"), F.col("tpl").alias("dt")), "row_key"))

    def by_shift(at: str) -> Column:
        if at == "weak":                                # nothing less than the whole item
            p = F.when(F.col("weak"), F.sequence(F.lit(0), F.size("iw") - 1)).otherwise(F.array().cast("array<int>"))
        else:
            p = F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(
                a, a + F.least(F.lit(n), F.size("iw")) - 1))))
        slots = F.transform(p, lambda p: F.struct(
            F.get("it", p).alias("it"), F.get("dt", p + F.col("shift")).alias("dt"),
            F.get("iw", p).alias("iv"), F.get("dw", p + F.col("shift")).alias("dv")))
        return F.struct(F.lit(at == "by_template").alias("template"), F.lit(False).alias("run"), p.alias("p"), slots.alias("slots"))

    def by_run(x: Column) -> Column:
        i, d = (_tokens(F.slice(F.col(t), at + 1, x[k]), F.slice(F.col(w), at + 1, x[k])) for t, w, at, k in (
            ("it", "iw", x["at"], "item_len"), ("dt", "dw", x["at"] + F.col("shift"), "len")))
        slots = F.zip_with(i, d, lambda a, b: F.struct(a["t"].alias("it"), b["t"].alias("dt"), a["v"].alias("iv"),
                                                       b["v"].alias("dv")))
        return F.struct(F.lit(False).alias("template"), F.lit(True).alias("run"),
                        F.sequence(x["at"], x["at"] + x["item_len"] - 1).alias("p"), slots.alias("slots"))
    piece = pair.withColumn("x", F.explode(F.concat(F.array(by_shift("by_template"), by_shift("by_all"), by_shift("weak")),
                                                    F.transform("wide", by_run))))
    same = F.forall("x.slots", lambda s: F.coalesce((s["it"] == s["dt"]) | (s["iv"] == s["dv"]), F.lit(False)))
    holders = F.filter("x.slots", lambda s: s["it"].isin(*HOLDERS))
    pairs = F.array_distinct(F.transform(holders, lambda s: F.struct(s["iv"].alias("a"), s["dv"].alias("b"))))
    keys = ["row_key", "item_key", "doc_id", "item_id", "item_words"]
    piece = (piece.filter(same & (F.size("x.p") > 0))
             .select("row_key", "item_key", "doc_id", "item_id", F.size("iw").alias("item_words"), "shift",
                     "x.template", "x.run", "x.p", pairs.alias("pairs")).filter(_consistent(F.col("pairs"))))
    # pieces of one copy: shifts with no gap above half of the item between them
    by_pair = Window.partitionBy("row_key", "item_key").orderBy("shift")
    gap = F.col("shift") - F.lag("shift").over(by_pair)
    copies = (piece.withColumn("new", F.when(gap > F.greatest(F.lit(n), F.col("item_words") / 2), 1).otherwise(0))
              .withColumn("copy", F.sum("new").over(by_pair))
              .groupBy(*keys, "copy")
              .agg(F.max(F.when(F.col("template"), F.struct(F.size("p").alias("covered"), _same(F.col("pairs"))
                                                            .alias("exact")))).alias("one"),
                   F.collect_list(F.struct((-F.size("p")).alias("order"), (~F.col("run")).alias("shift"), "p",
                                         "pairs")).alias("pieces"))
              .withColumn("all", _united(F.col("pieces"))))
    enough = [(F.col(c) >= coverage * F.col("item_words")) | (F.col(c) >= long_run) for c in ("one.covered", "covered")]
    judged = (copies.withColumn("covered", F.size("all.p")).withColumn("template", F.coalesce(enough[0], F.lit(False)))
              .filter(F.col("template") | enough[1])
              .select(*keys, F.when(F.col("template"), F.struct(F.lit(True).alias("template"), "one.covered", "one.exact"))
                      .otherwise(F.struct(F.lit(False).alias("template"), "covered",
                                          _same(F.col("all.pairs")).alias("exact"))).alias("b")))
    return (judged.groupBy(*keys).agg(F.max("b").alias("b"))
            .select("row_key", "doc_id", "item_id", "item_words", F.col("b.covered").alias("covered"),
                    (F.col("b.covered") / F.col("item_words")).alias("coverage"),
                    F.when(F.col("b.exact"), "exact").otherwise("reparameterised").alias("kind")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    row = fresh(docs, "row")
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("row_key").alias(row)).distinct()
    return docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col))).join(bad, row, "left_anti").drop(row)
