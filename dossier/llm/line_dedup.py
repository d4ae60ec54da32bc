"""Line dedup by a deletion-neighbourhood join, from built-in functions only.

Two lines are near-duplicates if one word inserted, deleted or replaced turns one into the other. Of lines that are equal
or near-duplicates, each that has an earlier one (by doc_id, then line number) goes.

1. Every line of ``exact_words`` words or more gets a 128-bit hash, and one of ``min_words`` the hashes of its halves. An edit leaves one half
   whole, so only lines that share a half with a different line can have a near-duplicate; this loses none.
2. Those lines emit all variants within the bound as hashed keys: the line without word i, for each i. Two lines with a
   variant in common at the same i differ by a replacement; a variant that equals a whole line shows an insertion.
3. Equal keys meet in an aggregation that keeps each group's earliest line, so a group of any size emits no pairs, and
   the edit distance of line and earliest is then verified on their words.

Defined results: words are separated by white space and compared as they stand; lines under ``min_words`` words
have no near-duplicates (one edit would change a large share of them), those under ``exact_words`` always stay, and so do
blank ones; null texts have no lines and stay; rows with equal doc_id and text
count as one document, those with equal doc_id and other texts as several; a null doc_id comes before all others; texts and
lines of any length are compared whole; input columns named n_lines or n_removed are replaced, all others stay as they are;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, few, keyed, materialise, with_columns_of, words_of


def _hashed(docs: DataFrame, min_words: int, exact_words: int) -> DataFrame:
    """doc, line_no, k1, k2 (the line's hash), halves (hashes of the halves that one edit may leave whole; null for short lines)."""
    words = F.transform(F.split("text", "\n"), lambda x: F.split(F.btrim(x, F.lit(SPACE_CHARS)), f"[{SPACE_CLASS}]+"))
    lines = docs.select("doc", F.posexplode(words).alias("line_no", "__w")).where((F.size("__w") >= exact_words) & (F.element_at("__w", 1) != ""))
    near = F.size("__w") >= max(min_words, 2)
    halves = []
    for m in ("size(__w)", "size(__w) - 1"):  # as the shorter line of a pair, and as the longer one
        head = f"({m}) div 2"
        halves.append(F.expr(f"xxhash64(0, {m}, slice(__w, 1, {head}))"))
        halves.append(F.expr(f"xxhash64(1, {m}, slice(__w, size(__w) - ({m}) + {head} + 1, {m} - {head}))"))
    return lines.select("doc", "line_no", F.expr("xxhash64(__w)").alias("k1"), F.expr("xxhash64(1, __w)").alias("k2"), F.when(near, F.array(*halves)).alias("halves"))


def _variants(lines: DataFrame) -> DataFrame:
    """Keys of each line's deletion neighbourhood: key1, key2, role (replaced, long or short), place.

    A line's hash is the sum of the hashes of its (word, position) pairs, so that each variant costs one running sum:
    the terms of the words before the deleted one, and those after it moved up by one place. The terms have 40 bits, and
    two sums make a key.
    """
    # the lines move once, before their words become rows: the windows below find each line's words together
    words = lines.repartition("place").select("place", "sides", F.size("__w").alias("n"), F.posexplode("__w").alias("i", "word"))
    term = lambda seed, at: F.expr(f"shiftrightunsigned(xxhash64({seed}, word, {at}), 24)")
    words = words.select("place", "sides", "n", "i", *[term(s, "i").alias(f"own{s}") for s in (1, 2)], *[term(s, "i - 1").alias(f"moved{s}") for s in (1, 2)])
    line = "OVER (PARTITION BY place)"
    so_far = "OVER (PARTITION BY place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    words = words.select(
        "place", "sides", "n", "i",
        *[F.expr(f"sum(own{s}) {so_far} - own{s} + sum(moved{s}) {line} - sum(moved{s}) {so_far}").alias(f"without{s}") for s in (1, 2)],
        *[F.expr(f"sum(own{s}) {line}").alias(f"whole{s}") for s in (1, 2)],
    )

    def key(role: str, tag: str, n, at, of: str):
        return F.struct(*[F.xxhash64(F.lit(tag), n, at, F.col(f"{of}{s}"), F.lit(s)).alias(f"key{s}") for s in (1, 2)], F.lit(role).alias("role"))

    # a shared head leaves the edit to the words behind it, a shared tail to those before it
    replaced = "(sides & 1 > 0 AND i >= n div 2) OR (sides & 2 > 0 AND i < n div 2)"
    deleted = "(sides & 4 > 0 AND i >= (n - 1) div 2) OR (sides & 8 > 0 AND i < n - (n - 1) + (n - 1) div 2)"
    emitted = F.array(
        F.when(F.expr(replaced), key("replaced", "replaced", F.col("n"), F.col("i"), "without")),
        F.when(F.expr(deleted), key("long", "moved", F.col("n") - 1, F.lit(-1), "without")),
        F.when(F.expr("i = 0 AND sides & 3 > 0"), key("short", "moved", F.col("n"), F.lit(-1), "whole")),
    )
    return words.select("place", F.explode(emitted).alias("e")).where("e IS NOT NULL").select("place", "e.*")


def near_lines(lines: DataFrame) -> DataFrame:
    """place of the given lines (place, sides, __w) that have an earlier near-duplicate among them.

    sides has bits 1 and 2 set if the line's head or tail, as the shorter or equal line of a pair, is another line's too,
    and bits 4 and 8 for its halves as the longer one.
    """
    keys = _variants(lines)
    # most keys are nobody else's
    shared = few(keys.groupBy("key1").count().where("count > 1").select("key1"))
    keys = materialise(keys.join(shared, "key1", "left_semi"))
    least = keys.groupBy("key1", "key2").agg(*[F.expr(f"min(CASE WHEN role = '{r}' THEN place END)").alias(f"first_{r}") for r in ("replaced", "long", "short")])
    least = least.where("first_replaced IS NOT NULL OR (first_long IS NOT NULL AND first_short IS NOT NULL)")
    earlier = F.expr("CASE role WHEN 'replaced' THEN first_replaced WHEN 'long' THEN first_short ELSE first_long END").alias("earlier")
    found = keys.join(least, ["key1", "key2"]).select("place", earlier).where("earlier < place").groupBy("place").agg(F.min("earlier").alias("earlier"))
    both = found.join(lines.select("place", F.col("__w").alias("a")), "place")
    both = both.join(lines.select(F.col("place").alias("earlier"), F.col("__w").alias("b")), "earlier")
    same = "coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0) - 1, least(size(a), size(b)))"
    within = f"{same.format(a='a', b='b')} + {same.format(a='reverse(a)', b='reverse(b)')} >= greatest(size(a), size(b)) - 1"
    return both.where(F.expr(f"abs(size(a) - size(b)) <= 1 AND {within}")).select("place")


def removed_lines(docs: DataFrame, *, min_words: int = 5, exact_words: int | None = None, often: int = 10_000) -> DataFrame:
    """doc, line_no (from 0) of every line that goes; docs has doc, text."""
    place = F.struct("doc", "line_no").alias("place")
    occurrences = materialise(_hashed(docs, min_words, max(min_words, 2) if exact_words is None else exact_words))
    distinct = occurrences.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.first("halves").alias("halves"))
    by_half = distinct.select("place", F.posexplode("halves").alias("side", "half"))
    shared = few(by_half.groupBy("half").count().where("count > 1").select("half"))
    candidates = by_half.join(shared, "half", "left_semi").groupBy("place").agg(F.expr("bit_or(shiftleft(1, side))").alias("sides"))
    candidates = candidates.groupBy("place.doc").agg(F.collect_list(F.struct("place.line_no", "sides")).alias("wanted"))
    lines = docs.join(candidates, "doc").dropDuplicates(["doc"])
    # the lines of a text are bound once, and found by their number
    wanted = F.expr("transform(array(split(text, '\n')), l -> transform(wanted, c -> struct(c.line_no, l[c.line_no] AS line, c.sides)))[0]")
    lines = lines.select("doc", F.explode(wanted).alias("l")).select(F.struct("doc", "l.line_no").alias("place"), "l.sides", words_of(F.col("l.line")).alias("__w"))
    near = materialise(near_lines(materialise(lines)))
    # equal lines share one hash: all but the earliest go, and the earliest too if it has an earlier near-duplicate
    first = occurrences.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.count("*").alias("copies"))
    doomed = materialise(first.join(near.withColumn("near", F.lit(True)), "place", "left").where("copies > 1 OR near"))
    # occurrences of the commonest lines don't meet: those lines are few, and the others have few occurrences each
    common, mark = few(doomed.where(F.col("copies") > often).select("k1", "k2")), F.lit(True).alias("common")
    rows = occurrences.select("doc", "line_no", "k1", "k2").join(common.select("*", mark), ["k1", "k2"], "left")
    out = rows.where("common IS NULL").join(doomed.where(F.col("copies") <= often), ["k1", "k2"]).drop("common", "copies")
    out = out.unionByName(rows.where("common").join(few(doomed.where(F.col("copies") > often)), ["k1", "k2"]).drop("common", "copies"))
    return out.where(F.coalesce("near", F.lit(False)) | (F.struct("doc", "line_no") != F.col("place"))).select("doc", "line_no")


def dedup_lines(docs: DataFrame, *, min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """docs with duplicate lines removed from the text, and n_lines, n_removed (both of the given text; 0 for null).

    Near-duplicates are sought among lines of min_words words or more, equal ones among those of exact_words (if None, of
    min_words) or more; 1 takes all lines that have a word.
    """
    texts = keyed(docs.select("doc_id", "text")).select("doc", "text")
    gone = removed_lines(texts, min_words=min_words, exact_words=exact_words).groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    out = docs.select(with_columns_of(docs, ("n_lines", "n_removed", "text")).alias("row"), "doc_id", "text")
    out = keyed(out).join(gone, "doc", "left")
    kept = F.expr("CASE WHEN gone IS NULL OR text IS NULL THEN text ELSE transform(array(split(text, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\n'))[0] END")
    columns = [kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.expr("CASE WHEN text IS NULL THEN 0L ELSE CAST(size(split(text, '\n')) AS BIGINT) END").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
