"""Expressions and row handling shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# the white space of every word and line rule: blank, tab, \n, \v, \f, \r
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW, ID, TEXT, HASH = "_row", "_id", "_text", "_hash"
NO_ID = -(2**63)  # a null id takes part as the smallest one


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, also where ``body`` uses it
    inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; an empty list for a blank text."""
    return let(strip(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows as one column, so that no name of theirs can clash with a working
    column, beside an id and a text without nulls. The text is held once: in its place the
    row only tells whether it was null."""
    own = lambda c: F.col(f"`{c}`").isNull().alias(c) if c == text_col else F.col(f"`{c}`")
    return docs.select(
        F.struct(*map(own, docs.columns)).alias(ROW),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias(ID),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(TEXT),
    )


def row_hash() -> Column:
    """Tells rows of one id apart; rows equal in id and text may share what is found for either."""
    return F.xxhash64(TEXT)


def released(rows: DataFrame, columns: list[str], text_col: str = "text", /, **added: Column) -> DataFrame:
    """The held rows' own columns with ``added`` ones, which replace those of the same name."""

    def own(c: str) -> Column:
        if c in added:
            return added.pop(c)
        held = F.col(f"{ROW}.`{c}`")
        return F.when(~held, F.col(TEXT)) if c == text_col else held

    first = [own(c).alias(c) for c in columns]
    return rows.select(*first, *[value.alias(name) for name, value in added.items()])


def with_size(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of changed documents, with ``n_chars`` (if there) counted anew."""
    size = F.char_length(text_col).cast("bigint")
    return docs.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])
