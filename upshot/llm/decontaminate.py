"""Benchmark decontamination by template canonicalisation.

Texts become words and numbers, lower-cased; numbers, names (capitalised words
within a sentence) and units after a number are typed slots. Windows of ``WINDOW``
canonical tokens of the benchmark, at least half of them literal, are joined by
hash with those of the documents. Matches on one diagonal (same shift between
document and item) must fill the slots consistently: each slot value of the item
always meets the same value in the document. So a question with other numbers
or names is caught, and one whose values don't fit together is not.

Only windows of at most ``COMMON`` templates count, so that a preface which many items share
tells nothing; of an item without such a window, all count. A document is contaminated by an
item if the consistent windows cover ``SHARE`` of the tokens that its windows cover
(all of a full copy), or ``ENOUGH`` of them.

With ``verbatim``, windows of mostly slots (arithmetic, tables, lists of names) are
joined too, with the slots' own values in the hash: they match on equal values only,
and count on any diagonal. Without it they are left out. The queries set it.

The texts are searched in two steps: windows of all texts, by their canonical hash alone, against
the different hashes of the index; then the full windows of the texts that met one, once for rows of equal
text. So no row of the first step carries an item or a value.

Everything is DataFrame functions. Items with the same canonical tokens, whose
slots share values in the same places, are one template, reported under the
smallest id; with ``verbatim``, items with a window of mostly slots are one only
if all their slots' values are equal. The window index of the benchmark is
broadcast up to ``BROADCAST_ROWS`` rows and joined with a shuffle beyond, with the
same result. Documents are never compared with each other.

Defined cases: null and empty texts have no tokens; items of fewer than ``WINDOW``
tokens match as a whole, those of fewer than ``LEAST`` never; texts are searched whatever their id, and
rows with a null id are reported and dropped like others; items with a null id are left out; repeated rows are
reported once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise

WINDOW = 8
LEAST = 4
SHARE = 0.5
ENOUGH = 32
COMMON = 8  # templates: windows of more say nothing about one of them
BROADCAST_ROWS = 100_000
NAME_MARK, NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002", "\ue003"
MID_SENTENCE = r"([\p{L}\p{N},;:] )(\p{Lu}\p{Ll})"
TOKEN = NAME_MARK + r"?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"
#: Units that make a slot after a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams",
         "kilogram", "kilograms", "ton", "tons", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres",
         "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
         "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "meter",
         "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres")


def tokens_of(text: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), MID_SENTENCE, "$1" + NAME_MARK + "$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def canonical(tokens: Column) -> Column:
    units = F.array(*map(F.lit, UNITS))
    # zipped with the token before: a lambda that indexes the array could be planned
    # with the array's whole expression evaluated for each token
    before = F.slice(F.concat(F.array(F.lit("")), tokens), F.lit(1), F.size(tokens))

    def one(t: Column, last: Column) -> Column:
        return (F.when(_is_number(t), NUMBER).when(t.startswith(NAME_MARK), NAME)
                .when(_is_number(last) & F.array_contains(units, t), UNIT).otherwise(t))

    return F.zip_with(tokens, before, one)


def _is_slot(t: Column) -> Column:
    return (t >= NUMBER) & (t <= UNIT)


def _mostly_slots(values: Column, k: Column | int) -> Column:
    return F.size(F.array_compact(values)) * 2 > k


def _window_hash(marks: Column, values: Column, k: Column | int) -> Column:
    """Hash of a window's canonical tokens, and of the slots' values if it is mostly slots."""
    return F.when(_mostly_slots(values, k), F.xxhash64(marks, values)).otherwise(F.xxhash64(marks))


def templates(items: DataFrame, id_col: str, text_col: str, verbatim: bool = False) -> DataFrame:
    """Rows (item, n_items, tokens, canon): one per canonical text of the benchmark and
    equality pattern of its slots (the first place of each slot's value), so an item
    that repeats a value never stands for one that doesn't."""
    given = (items.select(F.col(f"`{id_col}`").alias("item"), tokens_of(F.col(f"`{text_col}`").cast("string")).alias("tokens"))
             .where("item is not null").where(F.size("tokens") >= LEAST).withColumn("canon", canonical(F.col("tokens"))).distinct()
             .withColumn("filled", _slot_values(F.col("tokens"), F.col("canon")))
             .withColumn("pattern", F.transform("filled", lambda v: F.array_position("filled", v))))
    k = F.least(F.size("canon"), F.lit(WINDOW))
    some = F.exists(F.sequence(F.lit(0), F.size("canon") - k), lambda i: _mostly_slots(F.slice("filled", i + 1, k), k))
    given = given.withColumn("own", F.when(F.lit(verbatim) & some, F.col("filled")))
    return (given.groupBy("canon", "pattern", "own").agg(F.min(F.struct("item", "tokens")).alias("first"), F.countDistinct("item").alias("n_items"))
            .select(F.col("first.item").alias("item"), "n_items", F.col("first.tokens").alias("tokens"), "canon"))


def window_index(found: DataFrame, verbatim: bool = False) -> DataFrame:
    """Rows (plain, hash, k, item, n_items, size, at, filled, equal) of the templates' windows that count;
    ``plain`` is the hash of the canonical tokens, ``filled`` has the slots' values and null for literal tokens, ``equal`` marks
    windows of mostly slots, which match on equal values, ``size`` is the number of tokens these windows cover."""
    k = F.least(F.size("canon"), F.lit(WINDOW))
    windows = (found.withColumn("k", k).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("canon") - k)))
               .withColumn("here", F.slice("canon", F.col("at") + 1, F.col("k")))
               .withColumn("filled", F.slice(_slot_values(F.col("tokens"), F.col("canon")), F.col("at") + 1, F.col("k"))))
    windows = windows.withColumn("equal", _mostly_slots(F.col("filled"), F.col("k"))).withColumn("marks", F.transform("here", lambda t: F.xxhash64(t)))
    windows = (windows.where(F.lit(verbatim) | ~F.col("equal"))
               .select(F.xxhash64("marks").alias("plain"), _window_hash(F.col("marks"), F.col("filled"), F.col("k")).alias("hash"), "k", "item", "n_items",
                       "at", "filled", "equal"))
    windows, _ = materialise(windows, "windows")
    held = windows.groupBy("hash", "k").agg(F.countDistinct("item").alias("_n")).select(F.col("hash").alias("_h"), F.col("k").alias("_k"), (F.col("_n") <= COMMON).alias("rare"))
    marked = windows.join(held, (F.col("hash") == F.col("_h")) & (F.col("k") == F.col("_k"))).drop("_h", "_k")
    some = marked.groupBy(F.col("item").alias("_i")).agg(F.max("rare").alias("some"))
    counted = marked.join(some, F.col("item") == F.col("_i")).where(F.col("rare") | ~F.col("some")).drop("_i", "rare", "some")
    covers = F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("k") - 1))))
    sizes = counted.groupBy(F.col("item").alias("_i")).agg(F.size(covers).alias("size"))
    return counted.join(sizes, F.col("item") == F.col("_i")).drop("_i")


def _slot_values(tokens: Column, canon: Column) -> Column:
    return F.zip_with(tokens, canon, lambda t, c: F.when(_is_slot(c), t))


def _starts(marks: Column, k: int) -> Column:
    last = F.size(marks) - k
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def plain_hashes(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (a, b, plain) of the windows of the texts, by their canonical tokens. The marks of a text are made once for all
    lengths, in a struct which the windows refer to, and nothing filters on them."""
    given = docs.withColumn("canon", canonical(F.col("tokens"))).select(
        "a", "b", F.struct(F.transform("canon", lambda t: F.xxhash64(t)).alias("marks")).alias("t"))

    def hashes(k: int) -> Column:
        return F.transform(_starts(F.col("t.marks"), k), lambda i: F.xxhash64(F.slice("t.marks", i + 1, k)))

    each = [hashes(k) for k in lengths]
    return given.select("a", "b", F.explode(each[0] if len(each) == 1 else F.concat(*each)).alias("plain"))


def windows_of(docs: DataFrame, lengths: list[int], verbatim: bool = False) -> DataFrame:
    """Rows (a, b, k, pos, hash, values) of the texts' windows. The arrays of a text
    are in one struct, which the windows refer to more than once, and nothing
    filters on them: so they are made once per text, and no exploded row
    carries them."""
    given = (docs.withColumn("canon", canonical(F.col("tokens")))
             .select("a", "b", F.struct(F.transform("canon", lambda t: F.xxhash64(t)).alias("marks"),
                                        _slot_values(F.col("tokens"), F.col("canon")).alias("values")).alias("t")))

    def each(k: int) -> Column:
        def window(i: Column) -> Column:
            marks, values = F.slice("t.marks", i + 1, k), F.slice("t.values", i + 1, k)
            return F.struct(F.lit(k).alias("k"), i.alias("pos"), (_window_hash(marks, values, k) if verbatim else F.xxhash64(marks)).alias("hash"),
                            values.alias("values"))

        return F.transform(_starts(F.col("t.marks"), k), window)

    return given.select("a", "b", F.explode(F.concat(*[each(k) for k in lengths])).alias("w")).select("a", "b", "w.*")


def _text_key(text: Column) -> tuple[Column, Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(F.lit(1), t), F.xxhash64(F.lit(2), t)


def text_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 verbatim: bool = False) -> DataFrame:
    """Rows (a, b, item, n_items, n_tokens, share, n_slots, same_values, first_token) of contaminated texts; (a, b) is
    the text's key."""
    index, _ = materialise(window_index(templates(items, item_col, item_text_col, verbatim), verbatim), "index")
    rows = index.count()
    lengths = sorted(r["k"] for r in index.select("k").distinct().collect()) or [WINDOW]  # at most WINDOW lengths
    text = F.col(f"`{text_col}`").cast("string")
    a, b = _text_key(text)
    given = docs.select(a.alias("a"), b.alias("b"), text.alias("text"))
    tokens = tokens_of(F.col("text")).alias("tokens")

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    near = (plain_hashes(given.select("a", "b", tokens), lengths)
            .join(side(index.select(F.col("plain").alias("_plain")).distinct()), F.col("plain") == F.col("_plain"), "left_semi")
            .select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct())
    near, _ = materialise(near, "near")
    few = given.join(near, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi").dropDuplicates(["a", "b"]).select("a", "b", tokens)
    few, _ = materialise(few, "few")
    other = index.drop("plain").withColumnRenamed("hash", "_hash").withColumnRenamed("k", "_k")
    found = (windows_of(few, lengths, verbatim).join(side(other), (F.col("hash") == F.col("_hash")) & (F.col("k") == F.col("_k")))
             .select("a", "b", "item", "n_items", "size", "pos", "at", "k", "equal", F.array_compact(F.col("filled")).alias("b_"),
                     F.coalesce(F.array_compact("values"), F.array().cast("array<string>")).alias("d"))
             .withColumn("filled", F.arrays_zip(F.col("b_").alias("b"), F.col("d"))).drop("b_", "d"))
    here = F.sequence("at", F.col("at") + F.col("k") - 1)

    def gathered(which: Column) -> Column:
        return F.struct(F.array_distinct(F.flatten(F.collect_set(F.when(which, here)))).alias("covered"),
                        F.array_distinct(F.flatten(F.collect_set(F.when(which, F.col("filled"))))).alias("filled"),
                        F.min(F.when(which, F.col("pos"))).alias("pos"))

    # windows that match on equal values count whether or not the others' slots fit together
    one = ["a", "b", "item", "n_items", "size"]
    line = (found.groupBy(*one, (F.col("pos") - F.col("at")).alias("shift"))
            .agg(gathered(F.lit(True)).alias("all"), gathered(F.col("equal")).alias("same"),
                 F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("equal"), F.col("filled"))))).alias("free"))
            .withColumn("fits", F.size(F.array_distinct(F.transform("free", lambda p: p["b"]))) == F.size("free"))
            .where(F.col("fits") | (F.size("same.covered") > 0))
            .select(*one, F.when(F.col("fits"), F.col("all")).otherwise(F.col("same")).alias("t"))
            .select(*one, "t.*"))
    total = (line.groupBy(*one)
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"), F.max(F.size("filled")).alias("n_slots"),
                  F.min(F.forall("filled", lambda p: p["b"] == p["d"])).alias("same_values"), F.min("pos").alias("pos")))
    return (total.where((F.col("n") >= F.col("size") * SHARE) | (F.col("n") >= ENOUGH))
            .select("a", "b", "item", F.col("n_items").cast("long").alias("n_items"),
                    F.col("n").cast("long").alias("n_tokens"), (F.col("n") / F.col("size")).alias("share"),
                    F.col("n_slots").cast("long").alias("n_slots"), "same_values", F.col("pos").cast("long").alias("first_token")))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", verbatim: bool = False) -> DataFrame:
    """Rows (``id_col``, ``item_col``, ``n_items``, ``n_tokens``, ``share``,
    ``n_slots``, ``same_values``, ``first_token``) of contaminated documents."""
    hit = text_matches(docs, items, text_col, item_col, item_text_col, verbatim)
    hit, _ = materialise(hit.withColumnRenamed("a", "_a").withColumnRenamed("b", "_b"), "hits")
    a, b = _text_key(F.col(f"`{text_col}`"))
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), a.alias("a"), b.alias("b"))
    # the rows of contaminated texts alone are made distinct
    few = ids.join(hit.select(F.col("_a").alias("a_"), F.col("_b").alias("b_")).distinct(), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left_semi").distinct()
    return (few.join(hit, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_items", "n_tokens", "share", "n_slots", "same_values", "first_token"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", verbatim: bool = False) -> DataFrame:
    """``docs`` without the rows of contaminated texts, whatever their id."""
    hit, _ = materialise(text_matches(docs, items, text_col, item_col, item_text_col, verbatim).select("a", "b").distinct(), "hits")
    taken = set(docs.columns)
    x, y = (next(f"{name}{n}" for n in range(len(taken) + 1) if f"{name}{n}" not in taken) for name in ("key_", "other_"))
    a, b = _text_key(F.col(f"`{text_col}`"))
    return docs.join(hit.select(F.col("a").alias(x), F.col("b").alias(y)), (a == F.col(x)) & (b == F.col(y)), "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exactly or with other values."""
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), verbatim=True)


def _tokens_sql(text: str) -> str:
    mark = MID_SENTENCE.replace("'", "''")
    return f"regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '{mark}', '\\1{NAME_MARK}\\2', 'g')), '{TOKEN}')"


def _canon_sql() -> str:
    return (f"list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN tokens[i][1] BETWEEN '0' AND '9' THEN '{NUMBER}' WHEN tokens[i][1] = '{NAME_MARK}' THEN '{NAME}' "
            f"WHEN i > 1 AND tokens[i - 1][1] BETWEEN '0' AND '9' AND list_contains({list(UNITS)!r}, tokens[i]) THEN '{UNIT}' ELSE tokens[i] END)")


_FILLED_SQL = f"list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN canon[i] IN ('{NUMBER}', '{NAME}', '{UNIT}') THEN tokens[i] END)"
_MANY_SQL = "len(list_filter({0}, lambda v: v IS NOT NULL)) * 2 > k"
#: the key of a window: its canonical tokens, and the slots' values if they are most of it
_HASH_SQL = f"array_to_string(win, ' ') || CASE WHEN {_MANY_SQL.format('vals')} THEN '|' || CAST(to_json(vals) AS VARCHAR) ELSE '' END"

SQL = f"""
WITH dt AS (SELECT DISTINCT coalesce(text, '') AS text, {_tokens_sql('text')} AS tokens FROM documents),
bt AS (SELECT item_id AS item, {_tokens_sql('text')} AS tokens FROM benchmark WHERE item_id IS NOT NULL),
dc AS (SELECT *, {_FILLED_SQL} AS filled FROM (SELECT *, {_canon_sql()} AS canon FROM dt)),
bc AS (SELECT DISTINCT *, {_FILLED_SQL} AS filled FROM (SELECT *, {_canon_sql()} AS canon FROM bt WHERE len(tokens) >= {LEAST})),
bp AS (SELECT *, least(len(canon), {WINDOW}) AS k, list_transform(filled, lambda v: CASE WHEN v IS NOT NULL THEN list_position(filled, v) END) AS pattern FROM bc),
bo AS (SELECT *, CASE WHEN len(list_filter(range(0, len(canon) - k + 1), lambda i: {_MANY_SQL.format('filled[i + 1:i + k]')})) > 0 THEN filled END AS own FROM bp),
tpl AS (SELECT min(item) AS item, count(DISTINCT item) AS n_items, arg_min(filled, item) AS filled, canon, k FROM bo GROUP BY canon, k, pattern, own),
bw AS (SELECT item, n_items, k, spot, canon[spot + 1:spot + k] AS win, filled[spot + 1:spot + k] AS vals
  FROM (SELECT *, unnest(range(0, len(canon) - k + 1)) AS spot FROM tpl)),
bx AS (SELECT *, {_MANY_SQL.format('vals')} AS equal, {_HASH_SQL} AS hash FROM bw),
cm AS (SELECT hash, k, count(DISTINCT item) <= {COMMON} AS rare FROM bx GROUP BY hash, k),
bm AS (SELECT bx.*, cm.rare, bool_or(cm.rare) OVER (PARTITION BY bx.item) AS has_rare FROM bx JOIN cm ON cm.hash = bx.hash AND cm.k = bx.k),
bi AS (SELECT * FROM bm WHERE rare OR NOT has_rare),
sz AS (SELECT item, len(list_distinct(flatten(list(range(spot, spot + k))))) AS size FROM bi GROUP BY item),
ks AS (SELECT DISTINCT k FROM bi),
dw AS (SELECT text, k, pos, canon[pos + 1:pos + k] AS win, filled[pos + 1:pos + k] AS vals
  FROM (SELECT text, canon, filled, k, unnest(range(0, len(canon) - k + 1)) AS pos FROM dc, ks WHERE len(canon) >= k)),
dx AS (SELECT *, {_HASH_SQL} AS hash FROM dw),
hit AS (SELECT d.text, b.item, b.n_items, sz.size, d.pos, b.spot, b.k, b.equal,
    list_transform(list_filter(range(1, b.k + 1), lambda s: b.vals[s] IS NOT NULL), lambda s: {{'b': b.vals[s], 'd': d.vals[s]}}) AS filled
  FROM dx d JOIN bi b ON d.hash = b.hash AND d.k = b.k JOIN sz ON sz.item = b.item),
line AS (SELECT text, item, n_items, size, list_distinct(flatten(list(range(spot, spot + k)))) AS covered, list_distinct(flatten(list(filled))) AS filled, min(pos) AS pos,
    list_distinct(flatten(coalesce(list(range(spot, spot + k)) FILTER (WHERE equal), []))) AS same_covered,
    list_distinct(flatten(coalesce(list(filled) FILTER (WHERE equal), []))) AS same_filled, min(pos) FILTER (WHERE equal) AS same_pos,
    list_distinct(flatten(coalesce(list(filled) FILTER (WHERE NOT equal), []))) AS free FROM hit GROUP BY text, item, n_items, size, pos - spot),
fit AS (SELECT *, len(list_distinct(list_transform(free, lambda p: p.b))) = len(free) AS fits FROM line),
part AS (SELECT text, item, n_items, size, CASE WHEN fits THEN covered ELSE same_covered END AS covered, CASE WHEN fits THEN filled ELSE same_filled END AS filled,
    CASE WHEN fits THEN pos ELSE same_pos END AS pos FROM fit WHERE fits OR len(same_covered) > 0),
total AS (SELECT text, item, n_items, size, len(list_distinct(flatten(list(covered)))) AS n, max(len(filled)) AS n_slots,
    bool_and(len(list_filter(filled, lambda p: p.b <> p.d)) = 0) AS same_values, min(pos) AS pos FROM part GROUP BY text, item, n_items, size)
SELECT DISTINCT d.doc_id, item AS item_id, CAST(n_items AS BIGINT) AS n_items, CAST(n AS BIGINT) AS n_tokens, n / size AS share,
    CAST(n_slots AS BIGINT) AS n_slots, same_values, CAST(pos AS BIGINT) AS first_token
FROM total JOIN documents d ON coalesce(d.text, '') = total.text WHERE n >= size * {SHARE} OR n >= {ENOUGH}
"""
