"""License scans by diagonal voting, from built-in functions only.

Every rolling window of ``k`` words of a text is joined by its hash to the positions at which license templates hold that
window; the windows' words are compared too, so hashes that meet by chance don't count. A match votes for a diagonal, the
text position minus the template position. Votes are gathered by document, template and diagonal, neighbouring diagonals
(words inserted or missing) are merged, and the merged votes are cut into spans where more than ``max_gap`` words have none.
A span is verified by the share of its words that votes cover, so a part of a license counts as well as the whole; one that
is shorter than the template and than ``enough`` words is held against the lesser of these. Where verified spans overlap,
the best one counts: the text of one license often stands within another's.

Besides, plain phrases are counted wherever their words stand consecutively; their labels always stay.

Templates are whole texts of any length. Their index is broadcast if it has at most ``max_broadcast_rows`` windows, which
the templates' words bound before anything runs, and joined by shuffle otherwise.

Defined results: a null or empty text has no words and the score 0; words are runs of ASCII letters or digits and of all
characters beyond ASCII, with A-Z lower-cased; rows with equal doc_id and text get equal results; a text of any length is
read whole; columns besides doc_id and text are not looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed
from .license_texts import TEMPLATES

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_words(text: Column) -> Column:
    """The words, joined by single blanks. The Kelvin sign is set aside first, as lower() would make an ASCII k of it."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.btrim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _split(norm: str) -> Column:
    return F.expr(f"CASE WHEN {norm} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({norm}, ' ') END")


def _windows(words: str, k: int) -> Column:
    """All windows of k words, joined by blanks. Text and hash travel without the array that they come from."""
    gram = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> concat_ws(' ', {gram})) ELSE CAST(array() AS ARRAY<STRING>) END")


def base_counts(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word (null without a phrase) and __base, the labels of its phrases."""
    out = docs.withColumn("__norm", license_words(F.col("text"))).withColumn("__w", _split("__norm"))
    places, labels = [], []
    for phrase, label in phrases.items():
        own = phrase.split()
        stands = " AND ".join(f"__w[i + {j}] = '{w}'" for j, w in enumerate(own))
        # looked for word by word only where the text holds the phrase at all
        found = f"contains(__norm, '{phrase}') AND size(__w) >= {len(own)}"
        places.append(F.expr(f"CASE WHEN {found} THEN filter(sequence(0, size(__w) - {len(own)}), i -> {stands}) ELSE CAST(array() AS ARRAY<INT>) END"))
        labels.append(label)
    out = out.withColumns({f"__p{i}": p for i, p in enumerate(places)})
    out = out.withColumn("__all", F.concat(*[F.col(f"__p{i}") for i in range(len(places))]))
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "n_base": F.size("__all").cast("long"),
            "first_word": F.array_min("__all").cast("long"),
            "last_word": F.array_max("__all").cast("long"),
            "__base": F.array_compact(F.array(*[F.when(F.size(f"__p{i}") > 0, F.lit(x)) for i, x in enumerate(labels)])),
        }
    )
    return out.drop("__norm", "__w", "__all", *[f"__p{i}" for i in range(len(places))])


def template_index(spark: SparkSession, templates=TEMPLATES, k: int = 3) -> DataFrame:
    """h, gram, template, label, at, n_template: a row for each window of each template."""
    given = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)])
    t = spark.range(1).select(F.inline(given)).withColumn("__norm", license_words(F.col("text"))).withColumn("__w", _split("__norm"))
    t = t.select("template", "label", F.size("__w").alias("n_template"), F.posexplode(_windows("__w", k)).alias("at", "gram"))
    return t.select(F.xxhash64("gram").alias("h"), "gram", "template", "label", "at", "n_template")


def votes(docs: DataFrame, templates=TEMPLATES, *, k: int = 3, max_broadcast_rows: int = 200_000) -> DataFrame:
    """doc, template, label, n_template, diagonal, pos of every window that a document (doc, __norm) shares with a template, once."""
    words = docs.select("doc", _split("__norm").alias("__w"))
    rolled = words.select("doc", F.posexplode(_windows("__w", k)).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    index = template_index(docs.sparkSession, templates, k)
    # a template has at most a word for every two characters
    if sum(len(text) // 2 + 1 for _, text in templates) <= max_broadcast_rows:
        index = F.broadcast(index)
    # repeated rows of a document vote once: they are gathered before the shuffle
    return rolled.join(index, ["h", "gram"]).select("doc", "template", "label", "n_template", F.expr("pos - at").alias("diagonal"), "pos").distinct()


def spans(docs: DataFrame, templates=TEMPLATES, *, k: int = 3, slack: int = 3, max_gap: int = 8, enough: int = 12, min_score: float = 0.75, **index) -> DataFrame:
    """doc, label, template, first, last (words of the text), covered, score, verified of every span."""
    found = votes(docs, templates, k=k, **index).repartition("doc", "template")
    by_diagonal = Window.partitionBy("doc", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= slack, 0).otherwise(1)
    found = found.withColumn("__new", apart).withColumn("band", F.sum("__new").over(by_diagonal))
    by_place = Window.partitionBy("doc", "template", "band").orderBy("pos")
    step = F.coalesce(F.col("pos") - F.lag("pos").over(by_place), F.lit(max_gap + 1))
    found = found.withColumn("__step", step).withColumn("span", F.sum(F.when(F.col("__step") > max_gap, 1).otherwise(0)).over(by_place))
    # a window covers as many words as the last one has not covered
    found = found.groupBy("doc", "template", "label", "n_template", "band", "span").agg(
        F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"), F.sum(F.least("__step", F.lit(k))).alias("covered")
    )
    score = F.col("covered") / F.greatest(F.expr("last - first + 1"), F.least("n_template", F.lit(enough)))
    found = found.withColumn("score", score).withColumn("stands", F.col("score") >= min_score)
    # of those that stand, the best of each group that overlaps
    earlier = Window.partitionBy("doc", "stands").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.when(F.col("first") <= F.max("last").over(earlier), 0).otherwise(1)
    found = found.withColumn("__new", beyond).withColumn("__group", F.sum("__new").over(Window.partitionBy("doc", "stands").orderBy("first")))
    rank = F.struct("score", F.col("covered") / F.col("n_template"), "covered")
    best = F.max(rank).over(Window.partitionBy("doc", "stands", "__group"))
    return found.select("doc", "label", "template", "first", "last", "covered", "score", (F.col("stands") & (rank == best)).alias("verified"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs.

    score is 1 where a phrase stands, else that of the best span, verified or not; 0 if none.
    """
    rows = keyed(docs.select("doc_id", "text"))
    base = base_counts(rows, phrases).drop("text")
    found = spans(rows.select("doc", license_words(F.col("text")).alias("__norm")), templates, **how)
    found = found.groupBy("doc").agg(F.array_distinct(F.expr("collect_set(CASE WHEN verified THEN label END)")).alias("__more"), F.max("score").alias("__score"))
    out = base.join(found, "doc", "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("__base")).alias("base_labels"),
        joined(F.concat("__base", F.coalesce("__more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("__base") > 0, 1.0).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
    )
