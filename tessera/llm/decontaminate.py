"""Benchmark decontamination by template canonicalisation, with built-in functions only.

Numbers, names (capitalised words) and units after a number become typed placeholders, so a
question with other numbers or names has the same template. Windows of eight template tokens are
hashed and joined with those of the benchmark. Windows on one diagonal (same offset between
document and item) are then put together, and their slots are checked: a benchmark value must meet
one value everywhere, and different names different ones (different numbers may meet equal ones).
What remains is a verbatim or a re-parameterised copy.

The windows of all documents aren't built for that. Each benchmark window has an anchor, its longest
two neighbouring literal words (or its longest one). A document that matches enough windows of an item holds their anchors, so one pass
over the words of the documents tells which documents can match at all, whatever the size of the
benchmark; the others aren't looked at again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, materialize, without

WINDOW = 8
#: Words of a window that must be literal, else it says too little.
LITERALS = 4
#: Share of an item's windows that must match on one diagonal.
COVERAGE = 0.4
#: Windows of the benchmark in one broadcast; larger benchmarks go in blocks of this many.
BLOCK = 100_000
#: Benchmark windows whose anchors are broadcast; with more they meet words by a shuffle.
BROADCAST_ANCHORS = 500_000

#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph percent dollar dollars cent cents euro euros usd eur gbp k w kw v hz khz mhz ghz kb mb gb tb".split()

#: Numbers that are written as words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()

_SEPARATORS = r"(?:[^\p{L}\p{N}%.,]++|[.,](?![0-9])|(?<![0-9])[.,])+"
_NUMBER = r"(?<![^ ])[0-9][0-9.,]*(?![^ ])"
_NAME = r"(?<![^ ])\p{Lu}[^ ]*"


def _words(text: Column) -> Column:
    """Text with single spaces between tokens: punctuation goes, a unit stands apart from its number."""
    apart = F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<=[0-9])(?=[\p{L}%])", " ")).otherwise(text)
    return F.trim(F.regexp_replace(apart, _SEPARATORS, " "))


def _template(words: Column) -> Column:
    """The same tokens with placeholders: ``#n`` number, ``#u`` unit after a number, ``#p`` name."""
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    named = F.regexp_replace(words, _NAME, "#p")
    numbered = F.when(named.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(named, _NUMBER, "#n"), rf"(?<=#n )(?:{units}|%)(?![^ ])", "#u")).otherwise(named)
    return F.lower(numbered)


_SPELLED = f"(?i:{'|'.join(NUMBER_WORDS)})(?![^ _])"


def _loose_template(words: Column) -> Column:
    """:func:`_template` that takes number words, and runs of them joined by ``_``, for numbers."""
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    spelled = F.regexp_replace(words, rf"(?<![^ ]){_SPELLED}(?:_{_SPELLED})*(?![^ ])", "#n")
    numbered = F.regexp_replace(F.regexp_replace(spelled, _NAME, "#p"), _NUMBER, "#n")
    return F.lower(F.regexp_replace(numbered, rf"(?<=#n )(?:{units}|%)(?![^ ])", "#u"))


def _tokens(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """Columns ``keep``, words s (one space apart) and template tokens k; rows without a token go."""
    words = df.select(*keep, _words(F.coalesce(df[text].cast("string"), F.lit(""))).alias("s")).where("s <> ''")
    return words.withColumn("k", F.split(_template(F.col("s")), " "))


def _window_hashes(k: int) -> Column:
    at = lambda i, j: F.get(F.col("h"), i + j)
    return F.when(F.size("h") >= k, F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(*[at(i, j) for j in range(k)])))


def _hashed(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("h", F.transform("k", lambda x: F.xxhash64(x)))


def _item_windows(items: DataFrame, k: int) -> DataFrame:
    """Windows of the benchmark with enough literal words: hash, item_id, wpos, bw, bk."""
    rows = _hashed(items).select("item_id", F.split("s", " ").alias("w"), "k", F.posexplode(_window_hashes(k)).alias("wpos", "hash"))
    rows = rows.select("hash", "item_id", "wpos", F.slice("w", F.col("wpos") + 1, k).alias("bw"), F.slice("k", F.col("wpos") + 1, k).alias("bk"))
    literal = F.size(F.array_distinct(F.filter("bk", lambda x: ~x.startswith("#"))))
    return rows.where(literal >= LITERALS)


def _loose_tokens(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """As :func:`_tokens`, with words c and tokens ck where a run of names or of number words is one,
    words w, and lowered tokens l without names."""
    rows = df.select(*keep, _words(F.coalesce(df[text].cast("string"), F.lit(""))).alias("s")).where("s <> ''")
    rows = rows.withColumn("r", F.regexp_replace("s", r"(?<![^ ])(\p{Lu}[^ ]*) (?=\p{Lu})", "$1_"))  # no word holds a _
    rows = rows.withColumn("r", F.regexp_replace("r", rf"(?<![^ ])({_SPELLED}) (?={_SPELLED})", "$1_"))
    split = lambda c: F.split(c, " ")
    return rows.select(*[F.col(x) for x in rows.columns if x not in ("s", "r")], split("s").alias("w"), split("r").alias("c"), split(_loose_template(F.col("r"))).alias("ck"), split(_loose_template(F.lower("s"))).alias("l"))


def _loose_windows(tokens: DataFrame, key: str, sizes: list[int], raw: bool, masked: bool = False) -> DataFrame:
    """Windows with runs of names as one token (path c), lowered ones that hold a capital (path l)
    and, if ``raw``, lowered ones as they are (path v): key, path, n, pos, hash. If ``masked``, also
    those without a capital in which one word stands for a name, each in turn (path m)."""
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    capital = F.transform("w", lambda x: x.rlike(r"^\p{Lu}"))
    columns = {"c": hashed("ck"), "l": hashed("l"), "u": capital}
    if raw:
        columns["v"] = F.transform("w", lambda x: F.xxhash64(F.lower(x)))
    rows = tokens.select("*", *[v.alias("h" + k) for k, v in columns.items()])

    def windows(path: str, n: int) -> Column:
        word = lambda h, j: F.xxhash64(h, F.lit(j))
        whole = lambda p, i: reduce(lambda a, b: a.bitwiseXOR(b), [word(F.get("h" + p, i + j), j) for j in range(n)])
        at = lambda i: F.struct(F.lit(path).alias("path"), F.lit(n).alias("n"), i.alias("pos"), whole(path, i).alias("hash"))
        places = F.sequence(F.lit(0), F.size("h" + path) - n)
        if path == "l":
            places = F.filter(places, lambda i: reduce(Column.__or__, [F.get("hu", i + j) for j in range(n)]))
        if path == "m":
            name = F.xxhash64(F.lit("#p"))
            # a mask changes one word of the window's hash
            one = lambda x, m: F.struct(F.lit(path).alias("path"), F.lit(n).alias("n"), x["i"].alias("pos"), x["h"].bitwiseXOR(word(F.get("hl", x["i"] + m), m)).bitwiseXOR(word(name, m)).alias("hash"))
            each = lambda x: F.array(*[one(x, m) for m in range(n)])
            bare = F.filter(F.sequence(F.lit(0), F.size("hl") - n), lambda i: ~reduce(Column.__or__, [F.get("hu", i + j) for j in range(n)]))
            hashed = F.transform(bare, lambda i: F.struct(i.alias("i"), whole("l", i).alias("h")))
            return F.when(F.size("hl") >= n, F.flatten(F.transform(hashed, each))).otherwise(F.array().cast("array<struct<path:string,n:int,pos:int,hash:bigint>>"))
        return F.when(F.size("h" + path) >= n, F.transform(places, at)).otherwise(F.array().cast("array<struct<path:string,n:int,pos:int,hash:bigint>>"))

    every = F.concat(*[windows(p, n) for n in sizes for p in ("c", "l", *("v" if raw else ""), *("m" if masked else ""))])
    return rows.withColumn("x", F.explode(every)).select(key, *[c for c in ("w", "c", "ck", "l", "plain") if c in rows.columns], "x.*")


def _own(path: Column) -> Column:
    return F.when(path == "c", F.col("c")).otherwise(F.col("w"))


def _first_word(path: Column, pos: Column) -> Column:
    """Place among single words of token ``pos`` of a path."""
    return F.when((path == "c") & (pos > 0), F.size(F.split(F.array_join(F.slice("c", 1, F.greatest(pos, F.lit(1))), "_"), "_"))).otherwise(pos)


def _loose_items(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, list[int], bool]:
    """Windows of the second way with an item's ids and words, their lengths, and whether items
    are matched by their words as they are."""
    items = _loose_tokens(benchmark.where(benchmark[item_id].isNotNull()), item_text, benchmark[item_id].alias("item_id")).dropDuplicates()
    strict = lambda k: F.size(F.array_distinct(F.filter(k, lambda x: ~x.startswith("#")))) >= LITERALS
    template = F.split(_template(F.array_join("w", " ")), " ")
    size = F.least(F.size("w"), F.lit(WINDOW))
    usable = F.exists(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: strict(F.slice(F.col("k"), i, size)))
    items = items.withColumn("k", template).withColumn("plain", ~usable).drop("k")
    sizes = sorted({m for r in items.select(F.least(F.size("w"), F.lit(WINDOW)).alias("a"), F.least(F.size("c"), F.lit(WINDOW)).alias("b")).distinct().collect() for m in r if m >= LITERALS})
    raw = bool(items.where(F.col("plain")).limit(1).count())
    if not sizes:
        sizes = [WINDOW]
    path, pos = F.col("path"), F.col("pos")
    windows = _loose_windows(items, "item_id", sizes, raw).where(F.col("n") == F.least(F.size(_own(path)), F.lit(WINDOW)))
    tokens = F.when(path == "c", F.col("ck")).when(path == "l", F.col("l")).otherwise(F.transform("w", lambda x: F.lower(x)))
    windows = windows.select("hash", "item_id", "plain", path.alias("bpath"), _first_word(path, pos).alias("wpos"), F.slice(_own(path), pos + 1, F.col("n")).alias("bw"), F.slice(tokens, pos + 1, F.col("n")).alias("bk"))
    return windows.where(F.when(F.col("bpath") == "v", F.col("plain")).otherwise(strict("bk"))), sizes, raw


def _loose(docs: DataFrame, windows: DataFrame, sizes: list[int], raw: bool, doc_id: str, text: str) -> DataFrame | None:
    """Pairs whose names have other word counts, whose case differs, or whose items have too few
    literal words for a template and occur verbatim; columns as :func:`contamination`."""
    path, pos = F.col("path"), F.col("pos")
    blocks = -(-windows.count() // BLOCK)
    spread = _loose_windows(_loose_tokens(docs.where(docs[doc_id].isNotNull()), text, docs[doc_id].alias("doc_id")), "doc_id", sizes, raw, masked=True).drop("ck", "l")
    hits = []
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == b)
        hits.append(spread.join(F.broadcast(block), "hash"))  # a block is about BLOCK windows
    if not hits:
        return None
    met = reduce(DataFrame.unionByName, hits).select("doc_id", "item_id", "bpath", (_first_word(path, pos) - F.col("wpos")).alias("shift"), "wpos", "bw", "bk", F.slice(_own(path), pos + 1, F.col("n")).alias("dw"))
    tuples = F.zip_with(F.arrays_zip("bk", "bw"), F.col("dw"), lambda b, d: F.struct(b["bk"].alias("t"), b["bw"].alias("b"), d.alias("d")))
    met = met.withColumn("p", tuples).where(F.forall("p", lambda x: x["t"].startswith("#") | (F.lower(x["d"]) == x["t"])))
    count = lambda c: F.size(F.split(F.array_join(c, "_"), "_"))
    capital = lambda c: c.rlike(r"^\p{Lu}")
    # what the strict template can't see
    new = (F.col("bpath") == "v") | (count("bw") != count("dw")) | F.exists("p", lambda x: (capital(x["b"]) != capital(x["d"])) | ((x["t"] == "#n") & (F.lower(x["b"]) != F.lower(x["d"])) & (x["b"].rlike(r"\p{L}") | x["d"].rlike(r"\p{L}"))))
    met = met.select("doc_id", "item_id", "shift", "wpos", new.alias("new"), F.filter("p", lambda x: x["t"].startswith("#")).alias("slots"))
    diagonal = met.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("wpos").alias("at"), F.max("new").alias("new"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    # a diagonal alone, and with its neighbours
    centres = F.concat(F.array(F.struct(F.lit(0).alias("reach"), F.col("shift").alias("centre"))), F.transform(F.sequence(F.col("shift") - WINDOW, F.col("shift") + WINDOW), lambda x: F.struct(F.lit(WINDOW).alias("reach"), x.alias("centre"))))
    near = diagonal.withColumn("x", F.explode(centres)).groupBy("doc_id", "item_id", "x").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"), F.max("new").alias("new"), F.min("shift").alias("shift"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    names = F.filter("pairs", lambda s: s["t"] == "#p")
    one_way = F.size(F.array_distinct(F.transform("pairs", lambda s: F.struct(s["t"], s["b"])))) == F.size("pairs")
    other_way = F.size(F.array_distinct(F.transform(names, lambda s: s["d"]))) == F.size(names)
    near = near.where(F.col("new") & one_way & other_way)
    changed = F.size(F.filter("pairs", lambda s: F.lower(s["b"]) != F.lower(s["d"]))).cast("long")
    best = near.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-changed).alias("unchanged"), (-F.col("shift")).alias("early"), F.size("pairs").cast("long").alias("n_slots"))).alias("m"))
    totals = windows.groupBy("item_id").agg(F.count_distinct("wpos").alias("item_windows"))
    return best.join(totals, "item_id").select("doc_id", "item_id", F.col("m.n_windows").alias("n_windows"), "item_windows", (F.col("m.n_windows") / F.col("item_windows")).alias("coverage"), F.col("m.n_slots").alias("n_slots"), (-F.col("m.unchanged")).alias("n_changed"), (-F.col("m.early")).cast("long").alias("position"))


def _strict_items(benchmark: DataFrame, item_id: str, item_text: str) -> dict[int, DataFrame]:
    """Windows of the first way by their length; items under eight tokens are one window."""
    items = _tokens(benchmark.where(benchmark[item_id].isNotNull()), item_text, benchmark[item_id].alias("item_id")).dropDuplicates()
    lengths = items.select(F.least(F.size("k"), F.lit(WINDOW)).alias("n")).distinct()
    sizes = sorted(r["n"] for r in lengths.collect() if r["n"] >= LITERALS)  # at most eight lengths
    return {k: _item_windows(items.where((F.size("k") >= WINDOW) if k == WINDOW else (F.size("k") == k)), k) for k in sizes}


def _strict(docs: DataFrame, by_size: dict[int, DataFrame], doc_id: str, text: str) -> DataFrame | None:
    """Best diagonal of each pair by the template of single tokens; columns as :func:`contamination`."""
    tokens = _hashed(_tokens(docs.where(docs[doc_id].isNotNull()), text, docs[doc_id].alias("doc_id")))
    hits: list[DataFrame] = []
    for k, windows in by_size.items():
        blocks = -(-windows.count() // BLOCK)
        for b in range(blocks):
            block = windows if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == b)
            spread = tokens.select("doc_id", "s", F.posexplode(_window_hashes(k)).alias("pos", "hash"))
            met = spread.join(F.broadcast(block), "hash")  # a block is about BLOCK windows of k tokens
            # the template tokens tell a true match from a hash collision only with the raw ones:
            # equal literals are checked here, placeholders by the slots
            met = met.select("doc_id", "item_id", (F.col("pos") - F.col("wpos")).alias("shift"), "wpos", "bw", "bk", F.slice(F.split("s", " "), F.col("pos") + 1, k).alias("dw"))
            hits.append(met.withColumn("k", F.lit(k)))
    if not hits:
        return None
    met = reduce(DataFrame.unionByName, hits)
    slots = F.filter(F.zip_with(F.arrays_zip("bk", "bw"), F.col("dw"), lambda b, d: F.struct(b["bk"].alias("t"), b["bw"].alias("b"), d.alias("d"))), lambda s: s["t"].startswith("#"))
    agree = F.forall(F.zip_with(F.arrays_zip("bk", "bw"), F.col("dw"), lambda b, d: b["bk"].startswith("#") | (F.lower(d) == b["bk"])), lambda x: x)
    met = met.where(agree).select("doc_id", "item_id", "shift", "wpos", slots.alias("slots"))
    # each window of an item once a diagonal, then the slots of all its windows
    diagonal = met.groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("wpos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    distinct = lambda f: F.size(F.array_distinct(F.transform("pairs", f)))
    one_way = distinct(lambda s: F.struct(s["t"], s["b"])) == F.size("pairs")
    # two numbers or units may well become one; two names that do are another text
    names = F.filter("pairs", lambda s: s["t"] == "#p")
    other_way = F.size(F.array_distinct(F.transform(names, lambda s: s["d"]))) == F.size(names)
    diagonal = diagonal.where(one_way & other_way)
    diagonal = diagonal.select("doc_id", "item_id", "shift", "n_windows", F.size("pairs").cast("long").alias("n_slots"), F.size(F.filter("pairs", lambda s: s["b"] != s["d"])).cast("long").alias("n_changed"))
    totals = reduce(DataFrame.unionByName, by_size.values()).groupBy("item_id").agg(F.count_distinct("wpos").alias("item_windows"))
    best = diagonal.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("n_changed")).alias("unchanged"), (-F.col("shift")).alias("early"), "n_slots")).alias("m"))
    out = best.join(totals, "item_id").select("doc_id", "item_id", F.col("m.n_windows").alias("n_windows"), "item_windows", (F.col("m.n_windows") / F.col("item_windows")).alias("coverage"), F.col("m.n_slots").alias("n_slots"), (-F.col("m.unchanged")).alias("n_changed"), (-F.col("m.early")).cast("long").alias("position"))
    return out


def _suspects(docs: DataFrame, windows: list[DataFrame], doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Ids (_suspect) of the documents that hold the anchors of COVERAGE of an item's windows, and the
    items (item_id) that any document may match, as their windows without an anchor make up COVERAGE.

    ``windows`` has those of each way (item_id, wpos, bk). An anchor is a window's longest two neighbouring
    literal words of letters; without such two, its longest one.
    """
    plain = lambda x: x.rlike(r"^\p{L}+$")
    beside = F.zip_with(F.expr("slice(bk, 1, size(bk) - 1)"), F.expr("slice(bk, 2, size(bk) - 1)"), lambda a, b: F.when(plain(a) & plain(b), F.struct((-F.length(a) - F.length(b)).alias("size"), F.xxhash64(a, b).alias("pair"))))
    alone = F.transform(F.filter("bk", plain), lambda a: F.struct((-F.length(a)).alias("size"), F.xxhash64(a, F.lit("")).alias("pair")))
    two, one = F.array_min(F.filter(beside, lambda x: x.isNotNull()))["pair"], F.array_min(alone)["pair"]
    every = [w.select(F.lit(i).alias("way"), "item_id", "wpos", F.coalesce(two, one).alias("anchor"), (two.isNull() & one.isNotNull()).alias("single")) for i, w in enumerate(windows)]
    every = materialize(reduce(DataFrame.unionByName, every).distinct(), "benchmark-anchors")
    ways = every.groupBy("item_id", "way").agg(F.count_distinct("wpos").alias("total"), F.collect_list(F.struct("wpos", "anchor")).alias("windows"))
    held = lambda ok: F.size(F.array_distinct(F.transform(F.filter("windows", lambda w: ok(w["anchor"])), lambda w: w["wpos"]))) >= COVERAGE * F.col("total") - 1e-9
    anywhere = materialize(ways.where(held(lambda a: a.isNull())).select("item_id").distinct(), "benchmark-anywhere")
    pairs = every.where("anchor IS NOT NULL").select("item_id", "anchor").distinct()
    small = every.count() <= BROADCAST_ANCHORS
    runs = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].alias("_suspect"), F.split(F.lower(docs[text].cast("string")), r"[^\p{L}]+").alias("a"))
    said = F.arrays_zip("a", F.slice("a", 2, F.size("a")).alias("b"))
    if every.where("single").limit(1).count():
        said = F.concat(said, F.transform("a", lambda x: F.struct(x.alias("a"), F.lit("").alias("b"))))
    runs = runs.select("_suspect", F.explode(said).alias("z")).select("_suspect", F.xxhash64("z.a", "z.b").alias("_said"))
    met = runs.join(F.broadcast(pairs) if small else pairs, runs["_said"] == pairs["anchor"]).groupBy("_suspect", "item_id").agg(F.collect_set("anchor").alias("present"))
    both = met.join(F.broadcast(ways) if small else ways, "item_id")
    found = both.where(held(lambda a: a.isNull() | F.array_contains("present", a))).select("_suspect").distinct()
    return materialize(found, "benchmark-suspects"), anywhere


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of document and benchmark item whose templates agree with consistent slots.

    Returns doc_id, item_id, n_windows (item windows met on the best diagonal), item_windows,
    coverage, n_slots, n_changed (slots whose value differs: 0 for a verbatim copy) and position
    (token of the document where the item starts, may be negative), one row a pair. Null ids on
    either side and null or empty texts give no rows; items under eight tokens are matched as one
    window of their length, those under four can't be found. Repeated rows count once; other
    columns are not carried.

    Pairs that this doesn't find are looked for in a second way: runs of names count as one name, number
    words as numbers, lowered texts are matched as well, in which any one word of a window may stand for
    a name, and windows add up over neighbouring diagonals; items without a window of four different literal words match by their lowered words as they are.
    Their figures are those of the second way, with ``position`` that of the first diagonal.

    The documents are read once for their words; those that hold the anchors of enough windows of
    an item are read once per window length and block of benchmark windows, and once per block in
    the second way. Only words that are anchors and matched windows are shuffled.
    """
    by_size = {k: materialize(w, "benchmark-templates") for k, w in _strict_items(benchmark, item_id, item_text).items()}
    windows, sizes, raw = _loose_items(benchmark, item_id, item_text)
    windows = materialize(windows, "benchmark-loose")
    every = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    suspects, anywhere = _suspects(every, [*by_size.values(), windows], "doc_id", "text")
    few = suspects.count() <= BROADCAST_IDS
    # written, else the tests of the templates are pushed below the join, to all texts
    some = materialize(every.join(F.broadcast(suspects) if few else suspects, every["doc_id"] == suspects["_suspect"], "left_semi"), "benchmark-texts")
    parts = [(some, by_size, windows)]
    open_items = anywhere.count()
    if open_items:  # all documents, for these items alone; the others as before
        items = F.broadcast(anywhere) if open_items <= BROADCAST_IDS else anywhere
        only = lambda how: lambda w: w.join(items, "item_id", how)
        parts = [(some, {k: only("left_anti")(w) for k, w in by_size.items()}, only("left_anti")(windows)), (every, {k: only("left_semi")(w) for k, w in by_size.items()}, only("left_semi")(windows))]
    found = []
    for texts, strict, loose in parts:
        ways = [_strict(texts, strict, "doc_id", "text"), _loose(texts, loose, sizes, raw, "doc_id", "text")]
        found += [x.withColumn("way", F.lit(-i)) for i, x in enumerate(ways) if x is not None]
    found = [x.where(F.col("coverage") >= COVERAGE) for x in found]
    if not found:
        none = "doc_id {}, item_id {}, n_windows long, item_windows long, coverage double, n_slots long, n_changed long, position long"
        return docs.sparkSession.createDataFrame([], none.format(docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()))
    every = reduce(DataFrame.unionByName, found)
    values = [c for c in every.columns if c not in ("doc_id", "item_id", "way")]
    return every.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*values), "way").alias("m")).select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null id stay."""
    return without(docs, contamination(docs, benchmark, doc_id).select("doc_id"), doc_id)
