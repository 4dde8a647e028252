"""I-Match document fingerprints from randomised lexicons.

The lexicon holds the terms (words in lower case, as hashes) that are not in too large a share of all documents,
however rare they are. Random subsets of a document's terms give its tokens: in a lane, a term is in the subset of
scale s if its hash for the lane begins with s zeros, so subsets are nested, each half of the one before, from all
terms down to one in 2**24. A token is the hash of the document's distinct terms in the subset and counts if
these are one to four; an edit leaves such a token alone with a fair chance. Texts of up to some 60 million
distinct terms have subsets of one to four. Four lanes take the terms of the lexicon; six take all terms, so
that texts of few or no rare words are described too, by the same rule as all others. The likeness of two
fingerprints is the share of equal tokens.

Only the terms that are too common are listed. Their number has a bound that does not grow with the corpus: such
a term is in more than ``high`` of all documents, so there are at most (mean distinct terms per document) / ``high``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import written
from quayside.llm.decontaminate import words

_NO_ID = -(2**63)  # stands for a null doc_id: before all others
#: Lanes of the lexicon's terms and lanes of all terms; the scales of a lane's subsets.
RARE_LANES, ALL_LANES, SCALES = 4, 6, 24
LANES = RARE_LANES + ALL_LANES
_FEW = 4
_LEAST_LONG = -(2**63)
#: Documents of a stretch of the order, whose fingerprints one window compares; copies of a row that one array stands for.
_BLOCK, _COPIES = 4096, 1000


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w)))


def common_terms(docs: DataFrame, high: float) -> DataFrame:
    """One row ``common``: the terms in more than ``high`` of all documents."""
    total = docs.count()
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    listed = written(counts.where(F.col("df") > high * total).select("term"), "common-terms")
    return listed.agg(F.collect_list("term").alias("common"))


def _lowest(terms: Column, lane: int) -> Column:
    """The ``_FEW + 1`` lowest hashes of ``terms`` for a lane, ascending.

    Hashes under a bound that some 32 terms pass are enough, but for the rare text that has too few of them; so
    mostly a handful of hashes is sorted and not all.
    """
    hashes = F.transform(terms, lambda t: F.xxhash64(t, F.lit(lane)))
    width = F.lit(2.0**63) / F.greatest(F.size(terms) / 64, F.lit(1.0))  # half the range of hashes for each 64 terms
    bound = F.when(F.size(terms) <= 64, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + width).cast("long"))

    def enough(every: Column) -> Column:
        under = F.filter(every, lambda h: h <= bound)
        return F.when(F.size(under) > _FEW, under).otherwise(every)

    return F.slice(F.sort_array(F.transform(F.array(hashes), enough)[0]), 1, _FEW + 1)


def _hex(hashed: Column) -> Column:
    return F.lower(F.lpad(F.hex(hashed), 16, "0"))


def _token(terms: Column) -> Column:
    """32 bits of the hash of sorted terms."""
    return F.substring(_hex(F.xxhash64(terms)), 1, 8)


def _lane(kept: Column) -> Column:
    """The tokens of a lane's subsets, one for each scale and a dot after each, from the lowest hashes.

    The subset of scale s holds the hashes that begin with s zeros. So the token of the first k hashes stands
    at the scales that the k-th reaches and the next one does not.
    """
    zeros = []  # leading zeros of each of the lowest hashes, SCALES at most
    for i in range(_FEW + 1):
        top = F.shiftrightunsigned(F.get(kept, F.lit(i)).bitwiseXOR(F.lit(_LEAST_LONG)), 63 - SCALES)
        bits = F.when(top > 0, F.floor(F.log2(top) + 1e-9) + 1).otherwise(0)
        zeros.append(F.when(top.isNull(), 0).otherwise(F.least(F.lit(SCALES), SCALES + 1 - bits)).cast("int"))
    parts = [F.repeat(F.lit("-."), zeros[_FEW])]
    for k in range(_FEW, 0, -1):
        parts.append(F.repeat(F.concat(_token(F.slice(kept, 1, k)), F.lit(".")), zeros[k - 1] - zeros[k]))
    return F.concat(*parts, F.repeat(F.lit("-."), F.lit(SCALES) - zeros[0]))


def _whole_set(terms: Column) -> Column:
    return F.when((F.size(terms) > 0) & (F.size(terms) <= _FEW), _token(F.array_sort(terms))).otherwise(F.lit("-"))


def _or_text(tokens: Column, whole: Column) -> Column:
    """A text without any token is known by its own hash."""
    none = "-" + ".-" * (LANES * SCALES)
    return F.when(tokens == none, F.concat(F.lit("text:"), _hex(whole))).otherwise(tokens)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tokens among the places where either fingerprint has one; 0 to 1, and 1 for equal fingerprints."""
    pairs = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.when((x == "-") & (y == "-"), -1).when(x == y, 1).otherwise(0))
    share = F.size(F.filter(pairs, lambda p: p == 1)) / F.greatest(F.size(F.filter(pairs, lambda p: p >= 0)), F.lit(1))
    return F.when(a == b, 1.0).when(a.startswith("text:") | b.startswith("text:"), 0.0).otherwise(share)


def _in_order(keys: DataFrame) -> DataFrame:
    """Unique ``sid, version`` with the keys before and after; the first follows the last. Other columns stay.

    Tasks of a range partitioning number their own rows; only each task's first and last key are ordered together.
    ``part, block`` are stretches of up to ``_BLOCK`` rows of this order, and ``opens`` marks the first of each.
    """
    ranged = written(keys.repartitionByRange("sid", "version").withColumn("part", F.spark_partition_id()), "ordered-keys")
    own = Window.partitionBy("part").orderBy("sid", "version")
    key, place = F.struct("sid", "version", "n"), F.row_number().over(own) - 1
    inside = ranged.withColumn("before", F.lag(key).over(own)).withColumn("after", F.lead(key).over(own))
    inside = inside.withColumn("block", F.floor(place / _BLOCK).cast("int")).withColumn("opens", place % _BLOCK == 0)
    ends = ranged.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts = Window.orderBy("part")
    every = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lag("last").over(parts), F.last("last").over(every)).alias("gone"),
        F.coalesce(F.lead("first").over(parts), F.first("first").over(every)).alias("next"))
    joined = inside.join(ends, "part")
    return joined.select(*keys.columns, "part", "block", "opens", F.coalesce("before", "gone").alias("before"), F.coalesce("after", "next").alias("after"))


def _with_next(prints: DataFrame) -> DataFrame:
    """``prints`` with the ``next_fingerprint``: one shuffle by blocks, of which only the first rows are sent to all."""
    own = Window.partitionBy("part", "block").orderBy("sid", "version")
    first = prints.where("opens").select(F.col("sid").alias("next_sid"), F.col("version").alias("next_version"), F.col("fingerprint").alias("first"))
    led = prints.withColumn("led", F.lead("fingerprint").over(own)).join(F.broadcast(first), ["next_sid", "next_version"], "left")
    return led.withColumn("next_fingerprint", F.coalesce("led", "first"))


def _a_row_each(documents: DataFrame) -> DataFrame:
    """A row for each of a document's ``copies``, with ``doc_id``: its sid in ``known`` of them, null in the others."""
    blocks = documents.withColumn("at", F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)")))
    each = blocks.withColumn("copy", F.explode(F.expr(f"sequence(at + 1, least(copies, at + {_COPIES}))")))
    return each.withColumn("doc_id", F.when(F.col("copy") <= F.col("known"), F.col("sid")))


def imatch(docs: DataFrame, high: float = 0.1) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness; a row per document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited
    text has its last quarter of code points replaced by the beginning of the next document in ascending
    doc_id, as many code points or all there are. A null text is empty; an empty text has no terms and is known by its
    own hash. Rows without doc_id come first; of one doc_id, different texts follow in the order of their
    hashes, and equal ones are one document in the order, whose result each of the rows gets. A single
    document is its own next. Other columns are not read. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common = F.broadcast(common_terms(plain, high))
    keyed = plain.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("sid"), F.xxhash64("text").alias("version"), "text")
    keys = keyed.groupBy("sid", "version").agg(
        F.max(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("copies"), F.count("doc_id").alias("known"))
    order = written(_in_order(keys), "document-order")
    texts = keyed.select("sid", "version", "text").join(order, ["sid", "version"])
    given = texts.select(
        F.col("before.sid").alias("to_sid"), F.col("before.version").alias("to_version"),
        F.expr("substring(text, 1, cast(before.n div 4 as int))").alias("prefix"),
    ).groupBy("to_sid", "to_version").agg(F.min("prefix").alias("prefix"))
    both = texts.join(given, (F.col("sid") == F.col("to_sid")) & (F.col("version") == F.col("to_version")))
    place = ("copies", "known", "part", "block", "opens", "next_sid", "next_version")
    both = both.select("*", F.col("after.sid").alias("next_sid"), F.col("after.version").alias("next_version"))
    both = both.select("sid", "version", "n", *place, "text", F.expr("concat(substring(text, 1, cast(n - n div 4 as int)), prefix)").alias("edited"))
    both = both.dropDuplicates(["sid", "version"])
    # both texts of a document stay in its row, so fingerprints are not shuffled to meet
    sides = {"text": "fingerprint", "edited": "edited_fingerprint"}
    named = ("sid", "version", *place, "n_chars", "edited_sha256")
    made = both.crossJoin(common).select(
        *named[:-2], F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "common",
        *[F.xxhash64(t).alias(f"whole_{t}") for t in sides], *[_terms(F.col(t)).alias(f"all_{t}") for t in sides])
    made = made.select("*", *[F.array_except(f"all_{t}", "common").alias(f"rare_{t}") for t in sides])
    lanes = [(t, i, f"{'rare' if i < RARE_LANES else 'all'}_{t}") for t in sides for i in range(LANES)]
    wholes = [f"whole_{t}" for t in sides]
    made = made.select(*named, *wholes, *[_whole_set(F.col(f"rare_{t}")).alias(f"every_{t}") for t in sides], *[_lowest(F.col(c), i).alias(f"lane_{t}_{i}") for t, i, c in lanes])
    tokens = {t: F.concat(f"every_{t}", F.lit("."), *[_lane(F.col(f"lane_{t}_{i}")) for i in range(LANES)]) for t in sides}
    made = made.select(*named, *wholes, *[F.rtrim(tokens[t], F.lit(".")).alias(f"tokens_{t}") for t in sides])
    made = made.select(*named, *[_or_text(F.col(f"tokens_{t}"), F.col(f"whole_{t}")).alias(name) for t, name in sides.items()])
    prints = written(made.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))), "imatch", "zstd")
    whole = _with_next(prints).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    return _a_row_each(whole).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
