"""Quality rules: base counts and distribution divergence from language references.

A document is described by two histograms: code points by character class, and words by a
short list of its language's most frequent function words (and "other"). The reference of
a language is the mean histogram of its documents long enough to be judged, measured over
the whole table. A document is turned down when the Jensen-Shannon distance (base 2, from
0 to 1) of either histogram to its reference is above a limit. Short documents say little
about a distribution, so each histogram is judged from a least length on only, and a
reference needs a least number of documents.

All of it is built-in functions: texts are read once, their counts are written, and the
references are a small map-side combined fold of that table.

Defined cases: a null or empty text has counts of 0 and fails the base rules; a null or
unknown language is judged with the lists of all languages, as a language of its own;
equal rows get equal results; an empty table gives an empty result; columns of the table
stay, but for ones named like the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import ROW, TEXT, ascii_lower, held_rows, let, strip, words

# fixed values: frequent function words of four languages
COMMON = {
    "en": "the of and to in is that it for was on are as with be by at this have from or not you his they we an what had but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
LISTED = 16  # words of each list that are counted
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[\x20\x09-\x0D]+", r"""[.,;:!?'"()\-]+""", r"[#*$%&|<>]+")
SYMBOLS = CLASSES[-1]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED, MIN_REFERENCE = 200, 100, 20
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.27
_PLACE = 26  # bits of a word's place in a sort key


def _count(text: Column, pattern: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are sorted by hash with their places in the low bits; neighbours with the same
    hash are repeats.
    """
    size = F.greatest(F.size(ws) - 2, F.lit(0))
    window = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    hashes = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))
    place = lambda p: p.bitwiseAND(F.lit(2**_PLACE - 1)).cast("int")

    def covered(h: Column) -> Column:
        def repeats(p: Column) -> Column:
            same = lambda a, b: (F.shiftright(a, _PLACE) == F.shiftright(b, _PLACE)) & (F.get(h, place(a)) == F.get(h, place(b)))
            hit = lambda x, j: F.coalesce(same(x, F.get(p, j + 1)), F.lit(False)) | F.when(j > 0, same(x, F.get(p, j - 1))).otherwise(False)
            return F.sort_array(F.transform(F.filter(p, hit), place))

        keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, _PLACE).bitwiseOR(i.cast("bigint"))))
        gaps = lambda at: F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return let(let(keys, repeats), lambda at: F.aggregate(gaps(at), F.lit(0).cast("bigint"), lambda n, g: n + g))

    return let(hashes, covered)


def _listed(lang: Column) -> Column:
    """The words counted for a language."""
    every = list(dict.fromkeys(w for ws in COMMON.values() for w in ws[:LISTED]))
    chosen = F.array(*map(F.lit, every))
    for name, ws in COMMON.items():
        chosen = F.when(lang == name, F.array(*map(F.lit, ws[:LISTED]))).otherwise(chosen)
    return chosen


def counts(text: Column, lang: Column) -> Column:
    """A struct of all counts of one text."""
    lines = F.filter(F.split(text, "\n"), lambda l: strip(l) != "")
    classes = F.array(*[_count(text, c) for c in CLASSES])
    everyone = sorted({w for ws in COMMON.values() for w in ws[:LISTED]})
    bare = lambda w: F.btrim(ascii_lower(w), F.lit(".,;:!?"))

    def of_words(ws: Column) -> Column:
        common = F.filter(F.transform(ws, bare), lambda w: w.isin(everyone))
        found = let(common, lambda cs: F.transform(_listed(lang), lambda w: F.size(F.filter(cs, lambda c: c == w)).cast("bigint")))
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), repeat_words(ws).alias("n_repeat_words"), found.alias("found"))

    return let(F.struct(let(words(text), of_words).alias("w"), classes.alias("c")), lambda x: F.struct(
        x["w"]["n_words"].alias("n_words"),
        (F.char_length(text) - F.get(x["c"], 3)).cast("bigint").alias("word_chars"),
        F.get(x["c"], 5).alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
        x["w"]["n_repeat_words"].alias("n_repeat_words"),
        F.char_length(text).cast("bigint").alias("n_chars"),
        x["c"].alias("classes"), x["w"]["found"].alias("found"),
    ))


def _shares(parts: Column, total: Column) -> Column:
    """A histogram of shares, the last one being what ``parts`` leave over."""
    rest = F.array(F.greatest(total - F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    return F.transform(F.concat(parts, rest), lambda x: x / F.greatest(total, F.lit(1).cast("bigint")))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def _mean_histogram(rows: DataFrame, histogram: Column, name: str) -> DataFrame:
    """Per language the mean of each share, if enough documents carry it."""
    bins = rows.select("_lang", F.posexplode(histogram).alias("bin", "share"))
    means = bins.groupBy("_lang", "bin").agg(F.avg("share").alias("mean"), F.count(F.lit(1)).alias("n"))
    means = means.filter(F.col("n") >= MIN_REFERENCE)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bin", "mean"))), lambda x: x["mean"])
    return means.groupBy(F.col("_lang").alias(f"_{name}")).agg(ordered.alias(name))  # a few dozen bins


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """One row per document: id, the counts, ``class_distance`` and ``word_distance`` (null
    where not judged), ``base_failed`` and ``kept``."""
    lang = F.coalesce(F.col(f"{ROW}.`{lang_col}`").cast("string"), F.lit(""))
    known = F.when(lang.isin(*COMMON), lang).otherwise("")
    rows = held_rows(docs, id_col, text_col)
    counted = rows.select(F.col(f"{ROW}.`{id_col}`").alias(id_col), known.alias("_lang"), TEXT)
    counted = cut_lineage(counted.select(id_col, "_lang", counts(F.col(TEXT), F.col("_lang")).alias("m")).select(id_col, "_lang", "m.*"))
    classes, common = _shares(F.col("classes"), F.col("n_chars")), _shares(F.col("found"), F.col("n_words"))
    long_text, many_words = F.col("n_chars") >= MIN_CHARS_JUDGED, F.col("n_words") >= MIN_WORDS_JUDGED
    # at most one row per known language
    class_refs = F.broadcast(_mean_histogram(counted.filter(long_text), classes, "class_ref"))
    word_refs = F.broadcast(_mean_histogram(counted.filter(many_words), common, "word_ref"))
    judged = (
        counted.join(class_refs, F.col("_lang") == F.col("_class_ref"), "left").join(word_refs, F.col("_lang") == F.col("_word_ref"), "left")
        .withColumn("class_distance", F.when(long_text, js_distance(classes, F.col("class_ref"))))
        .withColumn("word_distance", F.when(many_words, js_distance(common, F.col("word_ref"))))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    off = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
        failed.alias("base_failed"), (~failed & ~off).alias("kept"),
    )
