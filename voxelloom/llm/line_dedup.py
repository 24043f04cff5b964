"""Near-duplicate lines by an exact set-similarity join, with DataFrame and SQL
functions only.

A line is the set of its lower-case words.  Words are ordered by rarity (their
count level over all lines, ties by hash), and two sets of Jaccard similarity
``t`` or more must share a word among the first ``n - ceil(t * n) + 1`` of
each.  So only those prefixes are joined, under the length filter, the
positional filter (what can still overlap behind the matching places) and a
bound from parity sketches of 64 or 256 bits (each word that differs flips one bit).
Pairs that remain are verified on the words themselves.  A line goes if any
earlier line, by doc_id and line number, is equal or similar.

Word counts live in a table of fixed size (``2 ** BUCKET_BITS`` hash buckets),
read as a session variable; a word whose bucket counts one can have no partner
and is not joined.  Equal sets are one row of the join, with map-side combining,
however many lines have them.  Words with more than ``2 ** HOT_BITS`` lines are
joined in rounds, so that a large group of similar lines does not meet in all
pairs: in each round every open line meets the earliest open line of the word,
and only lines that are similar to none of these go on to meet all the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.llm.common import fresh, let, query, table, whole_text
from voxelloom.session import cut

THRESHOLD = 0.8
BUCKET_BITS, FLAG_BITS, BLOCK, HOT_BITS = 22, 21, 1024, 8
ROUNDS = 2  # of leaders; what they leave open still meets all lines
WINDOWS = (1, 8)  # candidates of a line up to which it is compared in the first steps
LEVELS = 3  # per doubling of the count
LONG = 96  # words from which a line has the wide sketch too
LEVEL_SHIFT = 57
EPS = 1e-9
BLANKS = " \t\x0b\f\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, _th`` (the document), ``line_no, line``, ``_pos`` (order of all
    lines) and 128 bits of identity, ``h1`` and ``h2``.  Null text is one empty
    line; rows without a doc_id count as one document, before all others."""
    base = docs.select("doc_id", F.xxhash64(whole_text()).alias("_th"), F.posexplode(F.split(whole_text(), "\n")).alias("line_no", "line"))
    place = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    return base.select("*", place.cast("decimal(38,0)").alias("_pos"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def words_of(line: Column) -> Column:
    """Lower-case words between blanks; lines with single blanks take the cheap split."""
    low = F.lower(line)
    awkward = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | (line == "")
    for c in BLANKS[1:]:
        awkward = awkward | line.contains(c)
    return F.when(awkward, F.array_remove(F.split(low, f"[{BLANKS}]+"), "")).otherwise(F.split(low, " "))


def hashes_of(line: Column) -> Column:
    return F.transform(words_of(line), lambda w: F.xxhash64(w))


def bucket(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def levels(counts: DataFrame, bits: int) -> DataFrame:
    """One row: an array with the level of each bucket.  ``counts``: bucket, n."""
    zero = counts.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    total = counts.unionByName(zero).groupBy("bucket").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(62), F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * LEVELS + EPS)).cast("tinyint")
    blocks = total.select((F.col("bucket") / BLOCK).cast("int").alias("block"), "bucket", level.alias("level")).groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "level"))), lambda x: x["level"]).alias("levels"))
    return blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "levels"))), lambda x: x["levels"])).alias("levels"))


def flags(keys: DataFrame) -> DataFrame:
    """One row: an array that is above zero where a key (column ``key``) falls."""
    hit = keys.select(bucket(F.xxhash64("key"), FLAG_BITS).alias("bucket"), F.lit(2).cast("long").alias("n")).distinct()
    return levels(hit, FLAG_BITS)


def flagged(flag: Column, key: str) -> Column:
    return flag[bucket(F.xxhash64(key), FLAG_BITS)] > 0


class Lookup:
    """A fixed-size array as a session variable: unlike a joined column it is
    one constant in the plan, and unlike a subquery it may stand in a lambda."""

    def __init__(self, one_row: DataFrame, kind: str):
        self.spark, self.name = one_row.sparkSession, f"lookup_{uuid.uuid4().hex}"
        one_row.createOrReplaceTempView(self.name)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {self.name} ARRAY<{kind}>")
        self.spark.sql(f"SET VAR {self.name} = (SELECT * FROM {self.name})")
        self.spark.catalog.dropTempView(self.name)

    def __enter__(self):
        return F.expr(f"session.{self.name}")

    def __exit__(self, *_):
        self.spark.sql(f"DROP TEMPORARY VARIABLE {self.name}")  # plans made so far hold its value


def ordered(level: Column) -> Column:
    """Word keys of ``_set``, rarest first: the level above the hash."""
    mask = F.lit((1 << LEVEL_SHIFT) - 1)

    def key(h):
        return F.shiftleft(level[F.shiftrightunsigned(h, 64 - BUCKET_BITS)].cast("long"), LEVEL_SHIFT).bitwiseOR(h.bitwiseAND(mask))

    return F.sort_array(F.transform("_set", key))


def prefix_length(n: Column, t: float) -> Column:
    return (n - F.ceil(n * t - EPS) + 1).cast("int")


SKETCH = ["n", "s", "x0", "x1", "x2", "x3"]


def wide(quarter: int) -> Column:
    """Quarter of a 256-bit parity sketch of ``_set``, for long lines only: 64
    bits are full where more words may differ than they can show."""
    step = f"if(shiftrightunsigned(x, 62) = {quarter}, a ^ shiftleft(1L, cast(shiftrightunsigned(x, 56) & 63 as int)), a)"
    return F.when(F.size("_set") > LONG, F.expr(f"aggregate(_set, 0L, (a, x) -> {step})"))


def distinct_lines(lines: DataFrame, level: Column, t: float) -> DataFrame:
    """One row per distinct line with words, materialised: ``sid, h1, h2, pos``
    (its first place), ``n`` words, sketches ``s`` and ``x``, and ``prefix`` from place ``skip`` on."""
    # a test on the set itself would be pushed below it and hash every word twice
    some = lines.where(F.ltrim(F.col("line"), F.lit(BLANKS)) != "")
    sets = some.select("h1", "h2", "_pos", F.array_distinct(hashes_of(F.col("line"))).alias("_set"))
    size = F.size("_set")
    sketch = F.expr("aggregate(_set, 0L, (a, x) -> a ^ shiftleft(1L, cast(shiftrightunsigned(x, 58) as int)))")
    full = sets.select("h1", "h2", "_pos", size.alias("n"), sketch.alias("s"), *[wide(q).alias(f"x{q}") for q in range(4)], F.slice(ordered(level), F.lit(1), prefix_length(size, t)).alias("_front"))
    shared = F.filter("_front", lambda w: w >= F.lit(1 << LEVEL_SHIFT))  # words that occur once stand before these
    full = full.select("h1", "h2", "_pos", *SKETCH, shared.alias("prefix"), (F.size("_front") - F.size(shared)).alias("skip"))
    return cut(full.groupBy("h1", "h2", *SKETCH, "prefix", "skip").agg(F.min("_pos").alias("pos"))).withColumn("sid", F.monotonically_increasing_id())


def postings(sets: DataFrame, *columns: str) -> DataFrame:
    """A row per line and prefix word: the columns, ``i`` (place) and ``word``."""
    rows = sets.select(*columns, "skip", F.posexplode("prefix").alias("_i", "word"))
    return rows.select(*columns, (F.col("_i") + F.col("skip")).alias("i"), "word")


def near(t: float) -> Column:
    """What a pair a, b with a common word at places ``i`` must meet to be similar."""
    na, nb = F.col("a.n"), F.col("b.n")
    least = F.ceil((na + nb) * (t / (1 + t)) - EPS)
    differ = F.bit_count(F.col("a.s").bitwiseXOR(F.col("b.s")))
    more = sum((F.bit_count(F.col(f"a.x{q}").bitwiseXOR(F.col(f"b.x{q}"))) for q in range(4)), F.lit(0))  # null unless both are long
    # the first test is implied by the last, but cheap, and nearly all pairs fail it
    sketch = differ <= (na + nb) * ((1 - t) / (1 + t)) + 2 * EPS
    differ = F.greatest(differ, more)
    return (sketch & (F.least(na, nb) >= F.greatest(na, nb) * t - EPS) & (F.least(na - F.col("a.i"), nb - F.col("b.i")) >= least) & (differ <= na + nb - 2 * least))


def pair() -> list[Column]:
    return [F.col("a.sid").alias("a"), F.col("b.sid").alias("b")]


def verify(pairs: DataFrame, sets: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """``late``: the later line of each pair ``a, b`` whose word sets are really
    similar, materialised.

    One similar earlier line is enough, so each later line is compared with its
    earliest partner first, those that fail with the next few, and only lines
    that fail all of these with all the others.
    """
    place = sets.select("sid", "pos", "h1")
    known = pairs.distinct()
    for side in "ab":
        known = known.join(place.select(F.col("sid").alias(side), F.struct("pos", "h1").alias(f"at_{side}")), side)
    swap = F.col("at_b") < F.col("at_a")
    known = known.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("late"), F.greatest("at_a", "at_b").alias("at"), F.least("at_a", "at_b").alias("before"))
    place = F.row_number().over(Window.partitionBy("late").orderBy("before"))
    known = cut(known.withColumn("place", place))
    settled, low = None, 0
    for high in (*WINDOWS, None):
        some = known.where(F.col("place") > low) if high is None else known.where(F.col("place").between(low + 1, high))
        some = some.drop("place") if settled is None else cut(some.drop("place").join(settled, "late", "left_anti"))
        found = cut(similar(some, lines, t).distinct())
        settled, low = found if settled is None else settled.unionByName(found), high
    return settled


def similar(pairs: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """``late`` of the pairs of places (``at``, ``before``) that are similar.

    Only lines that may be in a pair are read again for it: a bucket table of
    their places thins them out before they are joined.
    """
    wanted = pairs.select(F.col("at.pos").alias("key")).unionByName(pairs.select(F.col("before.pos").alias("key")))
    with Lookup(flags(wanted), "TINYINT") as flag:
        some = lines.where(flagged(flag, "_pos")).select(F.struct(F.col("_pos").alias("pos"), "h1").alias("place"), "line")
    some = some.groupBy("place").agg(F.min("line").alias("line"))
    both = pairs.join(some.select(F.col("place").alias("before"), F.col("line").alias("one")), "before")
    both = both.join(some.select(F.col("place").alias("at"), F.col("line").alias("two")), "at")
    # each line is split once; a plain condition would split it anew wherever its words stand
    alike = let(words_of(F.col("one")), lambda one: let(words_of(F.col("two")), lambda two: F.size(F.array_intersect(one, two)) >= F.size(F.array_union(one, two)) * t - EPS))
    return both.where(alike).select("late")


def late_lines(sets: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """``sid``: the distinct lines that have a similar earlier one."""
    hot = F.lit((HOT_BITS * LEVELS) << LEVEL_SHIFT)
    word = F.col("word")
    cold = postings(sets, "sid", *SKETCH).where(word < hot)
    pairs = cold.alias("a").join(cold.alias("b"), F.col("a.word") == F.col("b.word")).where((F.col("a.sid") < F.col("b.sid")) & near(t)).select(*pair())

    def often(some):
        return postings(some, "sid", "pos", "h1", *SKETCH).where(word >= hot)

    ahead = F.struct("a.pos", "a.sid") < F.struct("b.pos", "b.sid")
    settled, open_ = None, sets
    for _ in range(ROUNDS):
        found = led(often(open_), near(t) & ahead, lines, t)
        settled = found if settled is None else settled.unionByName(found)
        open_ = without(open_, found)
    rest = often(sets).alias("a").join(often(open_).alias("b"), F.col("a.word") == F.col("b.word")).where(near(t) & ahead).select(*pair())
    return settled.unionByName(verify(pairs.unionByName(rest), sets, lines, t)).select(F.col("late").alias("sid")).distinct()


def led(posted: DataFrame, ahead: Column, lines: DataFrame, t: float) -> DataFrame:
    """``late``: the lines similar to the earliest line of one of their words; of
    several such lines the first is compared, the others are left to later steps."""
    first = posted.groupBy("word").agg(F.min(F.struct("pos", "sid", "h1", *SKETCH, "i")).alias("a"), F.count(F.lit(1)).alias("lists")).where("lists > 1")
    met = posted.alias("b").join(first.select(F.col("word").alias("w"), "a"), F.col("b.word") == F.col("w")).where(ahead)
    pairs = met.select(F.col("b.sid").alias("late"), F.struct("b.pos", "b.h1").alias("at"), F.struct("a.pos", "a.h1").alias("before"))
    return cut(similar(cut(pairs.groupBy("late", "at").agg(F.min("before").alias("before"))), lines, t))


def without(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` less those in ``found.late``; a bucket table spares most of them the join."""
    with Lookup(flags(found.select(F.col("late").alias("key"))), "TINYINT") as flag:
        maybe = flagged(flag, "sid")
        return sets.where(~maybe).unionByName(sets.where(maybe).join(found, F.col("sid") == F.col("late"), "left_anti"))


def removals(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``doc_id, _th, removed``: per document (id and text hash) that loses lines
    the ascending numbers of these.

    Lines without words stay.  Rows that repeat a doc_id and its text are one
    document; rows that share a doc_id are read line by line, as one.
    """
    lines = lines_of(docs)
    words = lines.select(F.explode(words_of(F.col("line"))).alias("word")).select(bucket(F.xxhash64("word"), BUCKET_BITS).alias("bucket"))
    with Lookup(levels(words.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), BUCKET_BITS), "TINYINT") as level:
        sets = distinct_lines(lines, level, t)
    late = late_lines(sets, lines, t).withColumn("_late", F.lit(True))
    first = sets.join(late, "sid", "left").select("h1", "h2", F.col("pos").alias("_first"), F.coalesce("_late", F.lit(False)).alias("_late"))
    # a line that a large share of documents has is one row on the right, and skew handling splits the left
    told = lines.select("doc_id", "_th", "line_no", "_pos", "h1", "h2").join(first, ["h1", "h2"])
    gone = told.where(F.col("_late") | (F.col("_pos") != F.col("_first")))  # the lines that stay are most and need no grouping
    return gone.groupBy("doc_id", "_th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def deduplicate(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the lines that go; documents keep their
    row even when no line is left."""
    id_, hash_, list_ = fresh(docs, "_id", "_hash", "_removed")
    gone = removals(docs, t).select(F.col("doc_id").alias(id_), F.col("_th").alias(hash_), F.col("removed").alias(list_))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(whole_text()) == F.col(hash_)), "left")

    def kept(lines):  # a set difference of line numbers takes no square of them
        stay = F.array_except(F.transform(lines, lambda x, i: i), F.col(list_))
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    text = F.when(F.col(list_).isNull(), F.col("text")).otherwise(let(F.split(whole_text(), "\n"), kept))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH l AS (SELECT doc_id, line_no - 1 AS line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\x0b\f\r]+'), lambda w: w <> ''))) AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)),
s AS (SELECT w, min((doc_id, line_no)) AS pos, len(w) AS n FROM l WHERE len(w) > 0 GROUP BY w),
t AS (SELECT pos, n, unnest(w) AS word FROM s),
f AS (SELECT word, count(*) AS f FROM t GROUP BY word),
r AS (SELECT pos, n, word, row_number() OVER (PARTITION BY pos ORDER BY f, word) AS i FROM t JOIN f USING (word)),
p AS (SELECT pos, n, word FROM r WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.pos AS a, b.pos AS b FROM p a JOIN p b USING (word) WHERE a.pos < b.pos AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
v AS (SELECT DISTINCT c.b FROM c JOIN s x ON x.pos = c.a JOIN s y ON y.pos = c.b
  WHERE len(list_intersect(x.w, y.w)) >= 0.8 * (x.n + y.n - len(list_intersect(x.w, y.w))) - 1e-9),
g AS (SELECT l.doc_id, l.line_no FROM l JOIN s USING (w) LEFT JOIN v ON v.b = s.pos WHERE (l.doc_id, l.line_no) <> s.pos OR v.b IS NOT NULL)
SELECT d.doc_id, coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS removed_lines, count(g.line_no) AS n_removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op1_line_dedup", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = removals(docs).groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("removed"))).alias("removed"))
    numbers = F.coalesce("removed", F.array().cast("array<int>"))
    return docs.select("doc_id").join(removed, "doc_id", "left").select(
        "doc_id", F.concat_ws(",", F.transform(numbers, lambda x: x.cast("string"))).alias("removed_lines"), F.size(numbers).cast("long").alias("n_removed"))
