"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Texts become token ids plus an end id; documents longer than a sequence are cut into
whole sequences and a rest. Packing looks at lengths only, and there are at most
``capacity`` of them, so Spark counts pieces per length and the plan is made on that
histogram: a table of runs "the pieces of this length with these ranks go to these
sequences at this offset". Its size depends on the capacity, not on the data (a sequence
holds under 91 different lengths, and each length splits at most one stretch of equal
sequences), so it is broadcast; each piece finds its place from its rank among the pieces
of its length. Ranks are counted in hashed buckets, with offsets from a table of bucket
counts, so a length that a third of all documents share is spread like any other.

The plan: pieces above a third of the capacity go one or two to a sequence: from the
longest down, each takes the longest partner that fits. The others, from the longest
down, go to the fullest sequence with room; what is left over opens new sequences.

Defined cases: a null text is empty, and an empty text is the end id alone; equal rows
are packed as separate pieces; an empty table gives an empty result; columns of the table
are not carried to pieces.
"""

from __future__ import annotations

import bisect
import sys
import types
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .common import BLANKS, ID, TEXT, held_rows

CAPACITY, END_ID = 4096, 1
MEMO_WORDS = 300_000  # words a worker remembers the ids of
SLICE_BYTES = 12 << 20  # of text tokenised at once
ENCODED_AT_ONCE = 4_096  # words whose encodings are held
WORDS_A_CALL = 128  # plain words of one encoding
PLAIN = r"^[\x21-\x7E]+$"  # words that keep their number of bytes when they are normalised
SUFFIX = "</w>"
BUCKET_ROWS = 65_536


# ---------------------------------------------------------------- tokens

def _worker_state(path: str):
    """Tokenizer and remembered words, kept for the life of a Python worker."""
    name = "_token_memo_of_this_worker"
    state = sys.modules.setdefault(name, types.ModuleType(name))
    if getattr(state, "path", None) != path:
        from tokenizers import Tokenizer

        state.path, state.tokenizer = path, Tokenizer.from_file(path)
        vocabulary = state.tokenizer.get_vocab(with_added_tokens=True)
        state.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of each token
        for token, i in vocabulary.items():
            state.bytes[i] = len(token.removesuffix(SUFFIX))
        state.words, state.ids, state.ends = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
    return state


def _ragged(ids: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``pick`` of a ragged table, end to end, and their lengths."""
    starts, sizes = ends[pick], ends[pick + 1] - ends[pick]
    total = np.cumsum(sizes)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)
    return ids[at], sizes


def _ids_of_each(state, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words end to end, and the number of each word's ids; a word is a call."""
    lists = [e.ids for e in state.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
    return np.fromiter((i for ids in lists for i in ids), np.int32), np.array([len(ids) for ids in lists], np.int64)


def _ids_of_plain(state, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_ids_of_each`, many words a call: no token goes over a blank, so the bytes
    of words and tokens tell where a word's ids end."""
    texts = words.to_pylist()
    calls = [" ".join(texts[k:k + WORDS_A_CALL]) for k in range(0, len(texts), WORDS_A_CALL)]
    found = state.tokenizer.encode_batch_fast(calls, add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
    word_ends, token_ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64)), np.cumsum(state.bytes[ids])
    last = np.searchsorted(token_ends, word_ends)
    if len(ids) and token_ends[-1] == word_ends[-1] and (token_ends[last] == word_ends).all():
        return ids, np.diff(np.r_[-1, last])
    return _ids_of_each(state, words)


def _encode(state, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words as a ragged table."""
    known = pc.index_in(words, value_set=state.words).to_numpy(zero_copy_only=False) if len(state.words) else np.full(len(words), np.nan)
    new = np.flatnonzero(np.isnan(known.astype(float)))
    fresh = words.take(pa.array(new))
    plain = pc.match_substring_regex(fresh, PLAIN).to_numpy(zero_copy_only=False).astype(bool)
    new = np.r_[new[plain], new[~plain]]
    fresh, n_plain = words.take(pa.array(new)), int(plain.sum())
    lists, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for part, read in ((fresh.slice(0, n_plain), _ids_of_plain), (fresh.slice(n_plain), _ids_of_each)):
        for at in range(0, len(part), ENCODED_AT_ONCE):
            some, n = read(state, part.slice(at, ENCODED_AT_ONCE))
            lists.append(some)
            sizes.append(n)
    fresh_ids = np.concatenate(lists)
    fresh_ends = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)
    ids, ends = np.concatenate([state.ids, fresh_ids]), np.concatenate([state.ends, state.ends[-1] + fresh_ends[1:]])
    row = np.where(np.isnan(known.astype(float)), 0, known).astype(np.int64)
    row[new] = len(state.words) + np.arange(len(new))
    if len(state.words) < MEMO_WORDS:
        state.words, state.ids, state.ends = pa.concat_arrays([state.words, fresh.cast(pa.string())]), ids, ends
    return _ragged(ids, ends, row)


def token_lists(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts end to end, and the number of each text's ids.

    The vocabulary breaks texts at white space, so a word has the same ids wherever it
    stands, and only words not seen before need the tokenizer.
    """
    state = _worker_state(path)
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    ids, sizes = _encode(state, coded.dictionary)
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    all_ids, per_word = _ragged(ids, ends, coded.indices.to_numpy().astype(np.int64))
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    word_ends = np.r_[0, np.cumsum(per_word)].astype(np.int64)
    return all_ids, np.diff(word_ends[bounds])


def _slices(batch: pa.RecordBatch, column: int):
    """The batch in parts of bounded text size (or of one row)."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of each document's token stretches."""

    def cut(batches):
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            doc_ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ids, sizes = token_lists(texts, path)
            out: list[tuple] = []
            end = 0
            for doc, size in zip(doc_ids.tolist(), sizes.tolist()):
                own = np.append(ids[end:end + size], np.int32(end_id)).astype("<u4")
                end += size
                for k, at in enumerate(range(0, size + 1, capacity)):
                    part = own[at:at + capacity]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [ID, "piece", "start", "length", "ids_crc32"])

    rows = held_rows(docs, id_col, text_col).select(ID, TEXT)
    return rows.mapInArrow(cut, f"{ID} bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- plan

class _Stretches:
    """Stretches of equal sequences (first id, number) by the room left in each."""

    def __init__(self):
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, first: int, number: int) -> None:
        if room and number:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((first, number))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """A stretch with the least room that holds ``size``."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, number = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.pop(at)
        return room, first, number


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, pieces, first sequence, offset): the
    ``i``-th piece of a run goes to sequence ``first + i // per`` at ``offset + i % per * length``."""
    left = {s: n for s, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_, following = _Stretches(), 0

    def put(size: int, per: int, number: int, first: int, offset: int) -> None:
        runs.append((size, used[size], per, per * number, first, offset))
        used[size] += per * number
        left[size] -= per * number

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - size)
        while at and not left[large[at - 1]]:  # spent as a partner before
            large.pop(at - 1)
            at -= 1
        if not at:
            number, mate = left[size], 0
        else:
            mate = large[at - 1]
            number = left[size] // 2 if mate == size else min(left[size], left[mate])
            if not number:  # one piece is left that only fits its own kind: look lower
                lower = [s for s in large[:at - 1] if left[s]]
                number, mate = 1, lower[-1] if lower else 0
        put(size, 1, number, following, 0)
        if mate:
            put(mate, 1, number, following, size)
        open_.add(capacity - size - mate, following, number)
        following += number

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = open_.take(size)
            if found is None:
                found = (capacity, following, -(-left[size] // (capacity // size)))
                following += found[2]
            room, first, number = found
            per = min(room // size, left[size])
            full = min(number, left[size] // per)
            put(size, per, full, first, capacity - room)
            open_.add(room - per * size, first, full)
            open_.add(room, first + full, number - full)
    return np.array(runs, np.int64).reshape(-1, 6)


# ---------------------------------------------------------------- places

def best_fit(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (from :func:`pieces`) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    parts = cut_lineage(parts)
    rows = parts.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    placed = parts.withColumn("_bucket", F.pmod(F.xxhash64(ID, "piece"), F.lit(buckets)))
    counts = cut_lineage(placed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_searchable(plan_runs(histogram, capacity)))
    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = W.partitionBy("length", "_bucket").orderBy(ID, "piece", "start", "ids_crc32")
    ranked = placed.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_bucket", "_before")
    out_columns = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id bigint, offset bigint"

    def look_up(batches):
        keys, table = runs.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = table[np.searchsorted(keys, _key(length, rank), "right") - 1]
            within = rank - run[:, 1]
            sequence = run[:, 4] + within // run[:, 2]
            offset = run[:, 5] + within % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out_columns), pa.array(sequence), pa.array(offset)], [*out_columns, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, schema)


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 48) | rank  # ranks stay below 2**48


def _searchable(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    return _key(runs[:, 0], runs[:, 1]), runs


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(pieces(docs, path, capacity, end_id, id_col, text_col), capacity)
