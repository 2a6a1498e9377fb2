"""Removal of byte strings that stand anywhere else too, by a hash-compared suffix sort.

Every byte that is covered by a string of ``window`` bytes which also starts at another
place, in the same document or another one, is removed. Strings are judged on the input.

Prefix polynomial hashes give the hash of any stretch of bytes from two of them, so the
common extension of two suffixes is found by binary search over its length, and a merge
sort compares suffixes in logarithmically many probes. A suffix array over all places
would hold a record per byte, so it is made in parts that cannot miss a repeat:

* The smallest hash of a window's grams depends on its bytes alone. Consecutive windows
  with the same one are a segment (some 70 windows). Each task counts the segments' grams
  in a sketch that stops at two; segments whose gram is estimated once hold no repeat.
* The others are shuffled with their bytes under their gram, so equal windows meet. First
  the suffix of each segment's start is sorted: where it agrees with a neighbour in the
  sorted order for ``window`` bytes or more, the windows up to there are repeats. Then the
  suffixes of all windows are sorted where any is left, one of equal segments standing for
  all. Windows that begin alike are sorted together, a bounded number (``PART``) at once;
  where more begin alike, further bytes tell them apart.
* Copies of a segment inside one batch of a task are settled there, and one is sent on, so
  a passage that stands in a large part of the corpus is a record per batch. What still
  is too large a group for one task (``HEAVY_BYTES``) is told apart by digests of whole
  windows instead, counted with map-side sums.

Every sorted order is verified: neighbours are compared byte by byte, and their common
extensions too; when hashes have collided, the part is sorted anew under another base.

Defined cases: null texts are empty; texts shorter than a window lose nothing; repeated
rows are places of their own, so they lose what they share; a null id is the smallest id;
an empty table gives an empty result; columns of the table stay, but for ones named like
the added ones. What is left need not be valid UTF-8 and is given as bytes. Rows of one id
are told apart by a 64-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import HASH, ID, TEXT, held_rows, released, row_hash
from .sketches import mix, repeated, seen_twice

WINDOW, GRAM = 200, 64
SKETCH_BITS, SKETCH_ROWS = 26, 2
BLOCK = 1 << 19  # bytes of text worked on at once
CHUNK = 1 << 20  # bytes of segments sorted at once, unless one group is larger
HEAVY_BYTES = 1 << 22
PART = 1 << 17  # windows sorted at once
_TABLE = mix(np.arange(256), 41)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _base(seed: int) -> int:
    return int(mix(np.array([seed]), 42)[0]) | 1


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    known = _powers.get(seed)
    if known is None or len(known[0]) < n:
        row = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)])
        with np.errstate(over="ignore"):
            known = _powers[seed] = row(_base(seed)), row(pow(_base(seed), -1, 2**64))
    return known


class Prefixes:
    """Prefix polynomial hashes of bytes: the hash of any stretch from two of them."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        up, down = powers(len(data) + 1, seed)
        self.data, self.down, self.seed = data, down, seed
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[data] * up[:len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` bytes."""
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size]

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the suffixes at ``a`` and ``b`` agree, up to ``most`` bytes."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        whole = self.of(a, most) == self.of(b, most)
        low[whole] = most[whole]
        left = np.flatnonzero(~whole)
        high[left] -= 1
        while len(left):
            middle = (low[left] + high[left] + 1) >> 1
            same = self.of(a[left], middle) == self.of(b[left], middle)
            low[left[same]] = middle[same]
            high[left[~same]] = middle[~same] - 1
            left = left[low[left] < high[left]]
        return low

    def order(self, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the suffix at ``a`` stands to that at ``b``; an end comes first."""
        most = np.minimum(size_a, size_b)
        agree = self.common(a, b, most)
        ends = agree == most
        last = len(self.data) - 1
        by_byte = self.data[np.minimum(a + agree, last)].astype(np.int64) - self.data[np.minimum(b + agree, last)]
        return np.sign(np.where(ends, size_a - size_b, by_byte))


def suffix_sort(text: Prefixes, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The suffixes (``size`` bytes from ``at``) in order inside each group, groups in order.

    A bottom-up merge sort of all groups at once: in every round each suffix finds its rank
    in the neighbouring run by binary search, and so its place in the merged one.
    """
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(order)])
    width = 1
    while len(sizes) and width < sizes.max():
        big = np.flatnonzero(sizes > width)
        n = sizes[big]
        slot = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        base, total = np.repeat(first[big], n), np.repeat(n, n)
        run = slot // width
        low = (run ^ 1) * width
        high = np.minimum(low + width, total)
        low = np.minimum(low, high)
        own, from_ = order[base + slot], low.copy()
        right = (run & 1).astype(bool)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            other, mine = order[base[todo] + middle], own[todo]
            sign = text.order(at[other], size[other], at[mine], size[mine])
            before = np.where(right[todo], sign <= 0, sign < 0)  # equal ones of the left run come first
            low[todo[before]] = middle[before] + 1
            high[todo[~before]] = middle[~before]
            todo = todo[low[todo] < high[todo]]
        order[base + (run >> 1) * 2 * width + slot - run * width + low - from_] = own
        width *= 2
    return order


def neighbours(text: Prefixes, at: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """For each place but the last of the order, how far it agrees with the next one (-1
    between groups). None if the bytes show that hashes have collided."""
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    agree = np.full(len(a), -1)
    a, b = a[same], b[same]
    found = text.common(at[a], at[b], np.minimum(size[a], size[b]))
    agree[same] = found
    raw = text.data.tobytes()
    for low in range(0, len(a), 1 << 14):
        some = slice(low, low + (1 << 14))
        x, y = a[some], b[some]
        for p, m, q, n, k in zip(at[x].tolist(), size[x].tolist(), at[y].tolist(), size[y].tolist(), found[some].tolist()):
            left, right = raw[p:p + m], raw[q:q + n]
            if left > right or left[:k] != right[:k] or left[k:k + 1] == right[k:k + 1] != b"":
                return None
    return agree


def _sorted(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, text: Prefixes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A verified order and the agreement of neighbours, under the first base that holds.
    ``text``: the hashes of the bytes, if they are known."""
    text = text or Prefixes(data)
    while True:
        order = suffix_sort(text, at, size, group)
        agree = neighbours(text, at, size, group, order)
        if agree is not None:
            return order, agree
        text = Prefixes(data, text.seed + 1)


def _best(order: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """The longest agreement of each suffix with another one of its group."""
    best = np.zeros(len(order), np.int64)
    best[order] = np.maximum(np.r_[agree, -1], np.r_[-1, agree])
    return best


def alike(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """``(windows, part)``: windows that begin like another one of their part, with at most
    ``most`` in a part and twice as many at once. Parts that are larger are told apart by
    further bytes; windows that agree in all of them come without a part."""
    open_ = [(np.arange(len(at), dtype=np.int32), 0)]
    while open_:
        which, depth = open_.pop()
        head = np.zeros(len(which), np.uint64)
        for k in range(depth, min(depth + 8, window)):
            head = head << np.uint64(8) | data[at[which] + k]
        by = np.lexsort((head, group[which])) if not depth else np.argsort(head, kind="stable")
        which, head = which[by], head[by]
        new = head[1:] != head[:-1]
        if not depth:
            new |= group[which[1:]] != group[which[:-1]]
        first = np.flatnonzero(np.r_[True, new])
        n = np.diff(np.r_[first, len(which)])
        for k in np.flatnonzero(n > most).tolist():
            rest = which[first[k]:first[k] + n[k]].copy()
            if depth + 8 < window:
                open_.append((rest, depth + 8))
            else:
                yield rest, None
        fits = (n > 1) & (n <= most)
        which, n = which[np.repeat(fits, n)], n[fits]
        total = np.cumsum(n)
        low = 0
        while low < len(n):
            done = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, done + most, "right")))
            yield which[done:total[high - 1]], np.repeat(np.arange(high - low), n[low:high])
            low = high


def repeats(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (segment, from, to) of segments that are covered by repeated windows.

    ``group`` is sorted; windows are compared inside their group only.
    """
    at, size = offsets[:-1], np.diff(offsets)
    text = Prefixes(data)
    order, agree = _sorted(data, at, size, group, text)
    best = _best(order, agree)
    whole = np.flatnonzero(best >= window)
    found = [(whole, np.zeros(len(whole), np.int64), best[whole])]
    # all windows of the groups in which some are not settled; of equal segments only one
    open_ = np.zeros(len(at), bool)
    open_[np.isin(group, group[best < size])] = True
    again = np.flatnonzero((agree == size[order[1:]]) & (size[order[:-1]] == size[order[1:]])) + 1
    copies = np.zeros(len(at), bool)
    copies[order[again]] = True
    several = np.zeros(len(at), bool)
    several[open_ & ~copies] = True
    each = np.where(several, size - window + 1, 0)
    of = np.repeat(np.arange(len(at), dtype=np.int32), each)
    place = np.arange(len(of)) + np.repeat(at - np.r_[0, np.cumsum(each)[:-1]], each)
    hit = np.zeros(len(of), bool)
    for which, part in alike(data, place, group[of], window, PART) if len(of) else ():
        if part is None:
            hit[which] = True
            continue
        order, agree = _sorted(data, place[which], np.full(len(which), window), part, text)
        hit[which[_best(order, agree) >= window]] = True
    of, start = of[hit], place[hit] - at[of[hit]]
    if len(of):  # they ascend
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] > start[:-1] + window)])
        last = np.r_[new[1:], len(of)] - 1
        found.append((of[new].astype(np.int64), start[new], start[last] + window))
    return united(*(np.concatenate(x) for x in zip(*found)))


def united(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching stretches of each owner as one."""
    by = np.lexsort((low, of))
    of, low, high = of[by], low[by], high[by]
    if not len(of):
        return of, low, high
    far = np.int64(max(int(high.max()), 0) + 1)
    reach = np.maximum.accumulate(high + of * far)  # owners ascend, so one scan serves all
    new = np.r_[True, (of[1:] != of[:-1]) | (low[1:] + of[1:] * far > reach[:-1])]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(of)] - 1
    return of[starts], low[starts], reach[ends] - of[starts] * far


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbouring values, by doubling."""
    length = 1
    while length * 2 <= span:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    rest = span - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Block:
    """The segments of a stretch of whole texts, or of a piece of one."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, window: int, gram: int):
        self.data, self.text, self.window = data, Prefixes(data), window
        span = window - gram + 1
        grams = mix(self.text.every(gram), 1)
        least = sliding_min(grams, span)
        # no window runs over the end of a text
        edge = np.zeros(len(least) + 1, np.int64)
        np.add.at(edge, np.clip(ends - window + 1, 0, len(least)), 1)
        np.add.at(edge, np.clip(ends, 0, len(least)), -1)
        valid = np.cumsum(edge[:-1]) == 0
        new = valid & np.r_[True, (least[1:] != least[:-1]) | ~valid[:-1]]
        last = valid & np.r_[new[1:] | ~valid[1:], True]
        self.start, self.count = np.flatnonzero(new), np.flatnonzero(last) - np.flatnonzero(new) + 1
        self.gram = least[self.start]
        self._grams, self._span, self._least = grams, span, least

    def counted(self) -> np.ndarray:
        """Each segment's gram once, or twice where it stands at two places in there."""
        many = np.zeros(len(self.start), np.int64)
        for at in range(0, len(self.start), 4096):
            part = slice(at, at + 4096)
            places = self.start[part, None] + np.arange(self._span)
            many[part] = (self._grams[places] == self.gram[part, None]).sum(axis=1)
        entering = np.r_[0, np.cumsum(self._grams[self._span - 1:] == self._least)]  # by window
        many += entering[self.start + self.count] - entering[self.start + 1]
        return np.r_[self.gram, self.gram[many > 1]]


def blocks(batch: pa.Array, window: int, gram: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray, int]]:
    """``(block, first row, text starts, bytes of the first text before it)`` over a batch of
    binary texts. Long texts are read in pieces that share ``window - 1`` bytes."""
    ends = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset:batch.offset + len(batch) + 1].astype(np.int64)
    values = np.frombuffer(batch.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(batch):
        stop = max(int(np.searchsorted(ends, ends[row] + BLOCK, "right")) - 1, row + 1)
        low, high = ends[row], ends[stop]
        if stop > row + 1 or high - low <= BLOCK:
            if high - low >= window:
                yield Block(values[low:high], ends[row + 1:stop + 1] - low, window, gram), row, ends[row:stop] - low, 0
        else:
            for at in range(0, int(high - low) - window + 1, BLOCK):
                data = values[low + at:min(low + at + BLOCK + window - 1, high)]
                yield Block(data, np.array([len(data)]), window, gram), row, np.zeros(1, np.int64), at
        row = stop


SPANS = f"{ID} bigint, {HASH} bigint, low bigint, high bigint"
SEGMENTS = f"{SPANS}, gram bigint, data binary"


def segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments that may hold a repeat, with their gram and bytes, and stretches of texts
    that are settled already (without them)."""
    texts = rows.select(ID, row_hash().alias(HASH), F.encode(TEXT, "UTF-8").alias("data"))

    def read(batch):
        found = [b.counted() for b, *_ in blocks(batch.column(0), window, gram)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    twice = rows.sparkSession.sparkContext.broadcast(seen_twice(texts.select("data"), SKETCH_BITS, SKETCH_ROWS, read))

    def table(ids, hashes, low, high, grams=None, data=None):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(hashes), pa.array(low), pa.array(high),
             pa.nulls(n, pa.int64()) if grams is None else pa.array(grams), pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())],
            [ID, HASH, "low", "high", "gram", "data"])

    def emit(batches):
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            seen: dict[bytes, tuple[int, int, int]] = {}
            settled: list[tuple[int, int, int]] = []
            for block, row, starts, before in blocks(batch.column(2), window, gram):
                hit = np.flatnonzero(repeated(twice.value, SKETCH_BITS, block.gram))
                if not len(hit):
                    continue
                at, size = block.start[hit], block.count[hit] + window - 1
                of = np.searchsorted(starts, at, "right") - 1
                low = at - starts[of] + before
                raw, rows_ = block.data.tobytes(), of + row
                sent, data = [], []
                for k, (a, n, r, l) in enumerate(zip(at.tolist(), size.tolist(), rows_.tolist(), low.tolist())):
                    part = raw[a:a + n]
                    first = seen.get(part)
                    if first is None:
                        seen[part] = (r, l, l + n)
                        sent.append(k)
                        data.append(part)
                    else:
                        settled += (first, (r, l, l + n))
                if sent:
                    yield table(ids[rows_[sent]], hashes[rows_[sent]], low[sent], (low + size)[sent], block.gram[hit[sent]].view(np.int64), data)
            if settled:
                of, low, high = united(*np.array(settled, np.int64).T)
                yield table(ids[of], hashes[of], low, high)

    return texts.mapInArrow(emit, SEGMENTS)


def covered(found: DataFrame, window: int, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """Stretches of texts that repeated windows cover, from the segments."""
    found = cut_lineage(found)
    open_, spans = found.filter(F.col("gram").isNotNull()), [found.filter(F.col("gram").isNull()).select(ID, HASH, "low", "high")]
    heavy = open_.groupBy("gram").agg(F.sum(F.col("high") - F.col("low")).alias("n")).filter(F.col("n") > heavy_bytes).select("gram")
    heavy = cut_lineage(heavy)
    if not heavy.isEmpty():
        many, open_ = open_.join(heavy, "gram"), open_.join(heavy, "gram", "left_anti")
        every = F.sequence(F.lit(0), F.octet_length("data") - window)
        windows = many.select(ID, HASH, "low", "data", F.explode(every).alias("at"))
        windows = windows.select(ID, HASH, (F.col("low") + F.col("at")).alias("low"), F.unhex(F.md5(F.substring("data", F.col("at") + 1, F.lit(window)))).alias("digest"))
        windows = cut_lineage(windows)
        often = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
        spans.append(windows.join(often, "digest").select(ID, HASH, "low", (F.col("low") + window).alias("high")))

    def settle(batches):
        held, held_bytes = [], 0

        def solve(batch: pa.RecordBatch):
            data = batch.column(batch.schema.get_field_index("data"))
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
            values = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            ids, hashes, low, grams = (batch.column(k).to_numpy() for k in (0, 1, 2, 3))
            of, a, b = repeats(values, offsets - offsets[0], grams, window)
            return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(hashes[of]), pa.array(low[of] + a), pa.array(low[of] + b)], [ID, HASH, "low", "high"])

        def joined():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column(3).to_numpy()
            ends = np.r_[0, np.cumsum(pc.binary_length(batch.column(4)).to_numpy())]
            edges = np.flatnonzero(np.r_[grams[0] != last, grams[1:] != grams[:-1]])
            start = 0
            for edge, stop in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                if held_bytes + ends[stop] - ends[start] > CHUNK and (held or edge > start):
                    if edge > start:
                        held.append(batch.slice(start, edge - start))
                    yield solve(joined())
                    held, held_bytes, start = [], 0, edge
            held.append(batch.slice(start))
            held_bytes += int(ends[-1] - ends[start])
            last = grams[-1]
        if held:
            yield solve(joined())

    met = open_.select(ID, HASH, "low", "gram", "data").repartition("gram").sortWithinPartitions("gram")
    spans.append(met.mapInArrow(settle, SPANS))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def without(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
    """Texts without the given stretches, null texts being those that lose nothing."""
    out = []
    for text, low, high in zip(texts, lows, highs):
        if text is None:
            out.append((None, 0, 0))
            continue
        _, low, high = united(np.zeros(len(low), np.int64), np.asarray(low, np.int64), np.asarray(high, np.int64))
        bounds = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
        out.append((kept, len(text) - len(kept), len(low)))
    return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy_bytes: int = HEAVY_BYTES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with the bytes that stay as ``kept``, ``n_bytes`` before, ``n_removed`` and
    the number of removed runs ``n_spans``."""
    rows = held_rows(docs, id_col, text_col)
    spans = covered(segments(rows, window, gram), window, heavy_bytes)
    lists = spans.groupBy(ID, HASH).agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    data = F.encode(TEXT, "UTF-8")
    joined = rows.withColumn(HASH, row_hash()).join(lists, [ID, HASH], "left")
    # only texts that lose something travel to Python
    cut = F.pandas_udf(without, "kept binary, n_removed bigint, n_spans bigint")
    joined = joined.withColumn("_cut", cut(F.when(F.col("_spans").isNotNull(), data), "_spans.low", "_spans.high"))
    return released(
        joined, docs.columns, text_col,
        kept=F.coalesce("_cut.kept", data), n_bytes=F.octet_length(data).cast("bigint"),
        n_removed=F.col("_cut.n_removed"), n_spans=F.col("_cut.n_spans"),
    )
