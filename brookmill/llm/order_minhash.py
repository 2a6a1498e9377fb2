"""Order MinHash fingerprints, sensitive to edit distance.

A text is a string of units: words, cut after 16 code points so that texts without white
space have units too. Its k-mers are runs of three units, numbered by occurrence, and each
(k-mer, occurrence) has a place on a circle given by its hash. From each of 64 points of
the circle the next two places are taken (a smallest-hash selection: each point orders the
k-mers by their distance from it), put back into text order and hashed as a tuple. A
fingerprint is the 64 tuple hashes, and likeness is the share of equal ones: tuples agree
only where both texts hold the same k-mers in the same order. Short texts have all 64
tuples too.

Units instead of characters keep the work at one k-mer per word; every step is a built-in
function, with sorts of packed longs (38 bits of hash, 26 bits of place).

Defined cases: null texts are empty; a text without units has an empty fingerprint, like
(1.0) only another such; texts that differ in white space alone have equal fingerprints;
rows equal in id and text count as one in the order of documents and share results; ids
that repeat with other texts are ordered by a digest of the text; a null id is the
smallest; a table with one document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import rank_rows
from ..session import cut_lineage
from .common import HASH, ID, TEXT, held_rows, let, row_hash

UNIT, KMER, TUPLES = 16, 3, 64
_PLACE = 26
_MASK = 2**_PLACE - 1


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(h, _PLACE).bitwiseOR(place)


def _kmers(units: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` units, or of the whole text where it is shorter."""
    run = lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(k)])
    return (
        F.when(F.size(units) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(units) - k, F.lit(0))), run))
        .when(F.size(units) > 0, F.array(F.xxhash64(units)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _numbered(sorted_kmers: Column) -> Column:
    """(hash of k-mer and occurrence, place in the text) of each entry of the sorted list."""
    p = sorted_kmers
    head = lambda x: F.shiftright(x, _PLACE)
    numbered = lambda x, occurrence: _packed(F.xxhash64(head(x), occurrence), _place(x))
    first = lambda x, j: F.when(j == 0, True).otherwise(head(x) != head(F.get(p, j - 1)))
    starts = F.filter(F.transform(p, lambda x, j: F.when(first(x, j), j)), lambda j: j.isNotNull())

    def of_runs(s: Column) -> Column:
        end = lambda r: F.coalesce(F.get(s, r + 1), F.size(p))
        singles = F.transform(s, lambda at: numbered(F.get(p, at), F.lit(0)))
        longer = F.filter(F.transform(s, lambda at, r: F.when(end(r) - at > 1, F.struct(at.alias("at"), end(r).alias("end")))), lambda r: r.isNotNull())
        others = F.flatten(F.transform(longer, lambda r: F.transform(
            F.sequence(r["at"] + 1, r["end"] - 1), lambda j: numbered(F.get(p, j), (j - r["at"]).cast("int")))))
        return F.concat(singles, others)

    return let(starts, of_runs)


def fingerprint(text: Column, k: int = KMER, tuples: int = TUPLES) -> Column:
    """The tuple hashes of a text, 16 bits each, as a list; empty for a text without units."""
    points = F.array(*[F.lit(((-(2**37) + j * (2**38 // tuples)) << _PLACE) | _MASK) for j in range(tuples)])
    is_point = lambda x: _place(x) == _MASK

    def select(circle: Column) -> Column:
        spots = F.filter(F.transform(circle, lambda x, i: F.when(is_point(x), i)), lambda i: i.isNotNull())

        def tuples_of(entries: Column) -> Column:
            def one(at: Column, j: Column) -> Column:
                pick = lambda q: F.get(entries, (at - j + q) % F.size(entries))
                a, b = F.shiftright(pick(0), _PLACE), F.shiftright(pick(1), _PLACE)
                ordered = F.when(_place(pick(0)) <= _place(pick(1)), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
                return F.shiftrightunsigned(ordered, 48).cast("int")

            return F.when(F.size(entries) > 0, F.transform(spots, one)).otherwise(F.array().cast("array<int>"))

        return let(F.filter(circle, lambda x: ~is_point(x)), tuples_of)

    units = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]{1,%d})" % UNIT), F.lit(1))
    kmers = let(units, lambda u: F.sort_array(F.transform(_kmers(u, k), lambda h, i: _packed(h, i.cast("bigint")))))
    return let(F.sort_array(F.concat(let(kmers, _numbered), points)), select)


def as_string(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples; 1 for two empty fingerprints, 0 if one is empty."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).otherwise(equal / F.greatest(F.size(a), F.size(b)))


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, in which the second half gives
    way to the start of the next document by descending id (after the last: the first)."""
    rows = held_rows(docs, id_col, text_col).select(ID, TEXT, row_hash().alias(HASH))
    base = cut_lineage(rows.select(ID, HASH, F.char_length(TEXT).cast("bigint").alias("n_chars"), fingerprint(F.col(TEXT)).alias("print")))
    # rows equal in id and text are one document of the order
    once = base.select(ID, HASH).distinct().withColumn("_down", F.bitwise_not(ID))  # descending, without overflow
    numbered = cut_lineage(rank_rows(once, [], ["_down", HASH], "at").select(ID, HASH, "at"))
    total = numbered.count()
    following = numbered.select(F.col(ID).alias("_ni"), F.col(HASH).alias("_nh"), F.col("at").alias("_at"))
    pairs = numbered.join(following, F.col("at") % F.lit(max(total, 1)) + 1 == F.col("_at")).select(ID, HASH, "_ni", "_nh")
    one_each = base.groupBy(ID, HASH).agg(F.first("n_chars").alias("n_chars"), F.first("print").alias("print"))
    donor = one_each.select(F.col(ID).alias("_ni"), F.col(HASH).alias("_nh"), F.col("print").alias("next_print"))
    known = cut_lineage(one_each.join(pairs, [ID, HASH]).join(donor, ["_ni", "_nh"]))
    asked = known.select(F.col(ID).alias("_i"), F.col(HASH).alias("_h"), F.col("_ni").alias(ID), F.col("_nh").alias(HASH), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    donors = rows.join(asked, [ID, HASH]).select(F.col("_i").alias(ID), F.col("_h").alias(HASH), F.left(TEXT, F.col("need")).alias("head"))
    heads = donors.dropDuplicates([ID, HASH])  # equal rows gave equal heads
    left = (F.char_length(TEXT) - F.floor(F.char_length(TEXT) / 2)).cast("int")
    edited = rows.join(heads, [ID, HASH]).select(ID, HASH, F.concat(F.left(TEXT, left), F.col("head")).alias("edited"))
    edited = edited.select(ID, HASH, F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return edited.join(known, [ID, HASH]).select(
        ID, "n_chars", "edited_sha256", as_string(F.col("print")).alias("fingerprint"), as_string(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
