"""Suffix-array dedup: bytes covered by a long string that an earlier document holds are removed.

A string of SPAN bytes is a repeat if it also starts in a document with a smaller id. Suffixes are
compared at sampled places only: in every SPAN-byte window the GRAM-byte string of least hash is an
anchor, so equal windows have equal anchors. Three passes over whole texts:

1. Anchors meet by hash; those that stand in one document only are dropped.
2. The remaining anchors travel with the bytes around them. In each group the suffixes that begin at
   the anchor are merge-sorted; a comparison finds the common extension of two suffixes by binary
   search over prefix polynomial hashes. Runs of the sorted order that share enough to the right,
   parted by what they share to the left, are the equal windows; the smallest id of each decides.
   Bytes are compared before a window is declared a repeat, so a hash collision removes nothing.
3. Each document's removed spans are merged and its remaining bytes are hashed or rebuilt.

An anchor that many documents share is settled within its batch first (equal surroundings leave one
row for each batch), and the windows of very common anchors travel under their own hashes, so no
task gathers all holders of one string. A string that a document holds at many places travels once,
with the list of its places.

Defined results: null texts count as empty; texts shorter than SPAN lose nothing; texts are read
whole; rows that share an id never remove each other's bytes, and must hold one text (spans are kept
by id, so where texts differ each row loses the spans of all); a null id neither removes nor loses;
``deduplicate`` drops partial UTF-8 characters at the edges of removed spans; extra columns are never
read by ``report`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize
from ._text import BASE, BASE_INVERSE, BYTE_CODE, U64, free_name, mix, powers, prefix_hash, slices, text_chunks, tidy

SPAN = 50
GRAM = 25
LEFT = SPAN - GRAM  # most bytes before an anchor that can share a window with it
WIDTH = LEFT + SPAN
CROWD = 48  # documents in a batch from which an anchor is settled within the batch
COMMON_SHARE = 0.01
COMMON_ANCHORS = 1 << 17
ANCHORS_PER_TASK = 2_000_000
ROWS_PER_BLOCK = 20_000


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over ``width`` consecutive values, by doubling."""
    have, size = values, 1
    while size * 2 <= width:
        have = best(have[:-size], have[size:])
        size *= 2
    return best(have[: len(values) - width + 1], have[width - size : len(values) - size + 1]) if size < width else have


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, gram hash and document of every anchor of a chunk."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, np.zeros(0, np.uint64), none
    prefix = prefix_hash(data)
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(BASE_INVERSE, n + 1)[: n - GRAM + 1]) | U64(1)
    least = _slide(grams, LEFT + 1, np.minimum)  # for each window start
    valid = np.zeros(n - SPAN + 1, bool)
    # mark the window starts that stay inside their document
    length = np.diff(offsets)
    whole = np.flatnonzero(length >= SPAN)
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, offsets[whole], 1)
    np.add.at(change, offsets[whole] + length[whole] - SPAN + 1, -1)
    valid = np.cumsum(change[: n - SPAN + 1]) > 0
    least = np.where(valid, least, U64(0))
    padded = np.concatenate([np.zeros(LEFT, np.uint64), least, np.zeros(LEFT, np.uint64)])
    top = _slide(padded, LEFT + 1, np.maximum)  # the largest of the minima of the windows that hold each gram
    at = np.flatnonzero(grams == top)
    return at, grams[at], np.searchsorted(offsets, at, side="right") - 1


def _anchor_rows(documents: DataFrame) -> DataFrame:
    """(key, doc, known): an anchor under its hash, or, under the document's, one known to be shared.

    ``known`` is null for an ordinary anchor, and 0 for the one that stands for a crowd in its batch.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            grams, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                _, g, d = anchors(data, offsets)
                grams.append(g)
                docs.append(d + lo)
            gram, doc = np.concatenate(grams), np.concatenate(docs)
            order = np.lexsort((ids[doc], gram))
            gram, doc = gram[order], ids[doc[order]]
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
            gram, doc = gram[fresh], doc[fresh]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(gram)))
            crowd = np.repeat(size >= CROWD, size)
            common = size >= max(CROWD, COMMON_SHARE * len(ids))
            heads = first[size >= CROWD]
            head_flag = np.where(common[size >= CROWD], 0, -1)
            plain = ~crowd
            key = np.concatenate([gram[plain].view(np.int64), gram[heads].view(np.int64), mix(doc[crowd].astype(np.uint64)).view(np.int64)])
            who = np.concatenate([doc[plain], doc[heads], doc[crowd]])
            known = np.concatenate([np.zeros(int(plain.sum()), np.int64), head_flag, gram[crowd].view(np.int64)])
            absent = np.zeros(len(key), bool)
            absent[: int(plain.sum())] = True
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(known, mask=absent)], names=["key", "doc", "known"])

    return documents.mapInArrow(tidy(run), "key long, doc long, known long")


def _shared(rows: DataFrame, tasks: int) -> DataFrame:
    """(doc, gram) of the anchors that several documents hold; a null doc marks a very common anchor."""

    def run(batches):
        key, doc, known, absent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for batch in batches:
            column = batch.column("known")
            key.append(batch.column("key").to_numpy())
            doc.append(batch.column("doc").to_numpy())
            absent.append(column.is_null().to_numpy(zero_copy_only=False))
            known.append(column.fill_null(0).to_numpy())
        key, doc, known, absent = map(np.concatenate, (key, doc, known, absent))
        settled = ~absent & (known != 0) & (known != -1)
        out_doc, out_gram = [doc[settled]], [known[settled]]
        very_common = np.unique(key[~absent & (known == 0)])
        key, doc = key[~settled], doc[~settled]
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            several = np.repeat(np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first), size)
            out_doc.append(doc[several])
            out_gram.append(key[several])
        gone = np.concatenate([np.zeros(sum(map(len, out_doc)), bool), np.ones(len(very_common), bool)])
        who = np.concatenate([*out_doc, np.zeros(len(very_common), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(who, mask=gone), pa.array(np.concatenate([*out_gram, very_common]))], names=["doc", "gram"])

    return rows.repartition(tasks, "key").mapInArrow(tidy(run), "doc long, gram long")


def _surroundings(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray):
    """Bytes around each anchor, zero-padded to WIDTH, and how many before and after it are real."""
    left = np.minimum(LEFT, at - offsets[doc])
    right = np.minimum(SPAN, offsets[doc + 1] - at)
    place = at[:, None] + np.arange(-LEFT, SPAN)[None, :]
    real = (place >= (at - left)[:, None]) & (place < (at + right)[:, None])
    return np.where(real, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8), left, right


def _row_hash(matrix: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes along each row."""
    out = np.zeros((len(matrix), matrix.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_CODE[matrix] * powers(BASE, matrix.shape[1])[None, :], axis=1, out=out[:, 1:])
    return out


CONTEXT = "key long, doc long, pos long, size int, bytes binary, more binary"


def _context_rows(joined: DataFrame, common) -> DataFrame:
    """Rows of CONTEXT: an anchor with its bytes under its hash, or, with a null key, a span
    [pos, pos + size) that is known to repeat. ``size`` of an anchor packs left * 256 + right, and
    ``more`` its other places in the document with equal surroundings, as 64-bit integers."""

    def run(batches):
        very_common = common.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            lists = batch.column("grams")
            edges = lists.offsets.to_numpy()
            edges = edges - edges[0]
            wanted = lists.flatten().to_numpy().view(np.uint64)
            wanted = np.sort(mix(wanted ^ mix(np.repeat(np.arange(len(ids)), np.diff(edges)).astype(np.uint64))))
            parts = []
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                at, gram, doc = anchors(data, offsets)
                if not len(at) or not len(wanted):
                    continue
                test = mix(gram ^ mix((doc + lo).astype(np.uint64)))
                mine = wanted[np.minimum(np.searchsorted(wanted, test), len(wanted) - 1)] == test
                at, gram, doc = at[mine], gram[mine], doc[mine]
                if len(at):
                    parts.append((gram, ids[lo + doc], at - offsets[doc], *_surroundings(data, offsets, at, doc)))
            if parts:
                yield from _emit(*(np.concatenate([p[i] for p in parts]) for i in range(6)), very_common)

    return joined.mapInArrow(tidy(run), CONTEXT)


def _equals(key, ids, matrix, left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose key and surroundings equal those of a row with a smaller id (bytes compared); rows that
    equal another row of their own id; and, for these, that row."""
    full = np.concatenate([np.zeros(0, np.uint64), *(_row_hash(matrix[i : i + ROWS_PER_BLOCK])[:, -1] for i in range(0, len(key), ROWS_PER_BLOCK))])
    full = mix(full ^ mix(key) ^ (left * 256 + right).astype(np.uint64))
    order = np.lexsort((ids, full))
    first = np.ones(len(key), bool)
    first[1:] = full[order][1:] != full[order][:-1]
    head = np.repeat(order[first], np.diff(np.append(np.flatnonzero(first), len(order))))
    order, head = order[~first], head[~first]
    same = [(matrix[order[i : i + ROWS_PER_BLOCK]] == matrix[head[i : i + ROWS_PER_BLOCK]]).all(axis=1) for i in range(0, len(order), ROWS_PER_BLOCK)]
    same = np.concatenate([np.zeros(0, bool), *same])
    order, head = order[same], head[same]
    later, own, lead = np.zeros(len(key), bool), np.zeros(len(key), bool), np.arange(len(key))
    later[order] = ids[order] > ids[head]
    own[order] = ids[order] == ids[head]
    lead[order] = head
    return later, own, lead


def _folded(own, lead, pos) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of rows folded into it, and their places, row by row."""
    rows = np.flatnonzero(own)
    rows = rows[np.argsort(lead[rows], kind="stable")]
    return np.bincount(lead[rows], minlength=len(lead)), pos[rows]


def _emit(gram, ids, pos, matrix, left, right, very_common):
    """CONTEXT rows of a batch: of equal surroundings only the smallest id travels, once; the others repeat it."""
    repeats, own, lead = _equals(gram, ids, matrix, left, right)
    spans = [(ids[repeats], (pos - left)[repeats], (pos + right)[repeats])]
    slot = np.minimum(np.searchsorted(very_common, gram), max(len(very_common) - 1, 0))
    often = very_common[slot] == gram if len(very_common) else np.zeros(len(gram), bool)
    often_rows = np.flatnonzero(often & ~repeats)
    yield from _rows(gram, ids, pos, matrix, left, right, ~repeats & ~often, own & ~often, lead)
    if len(often_rows):  # the windows of very common anchors go under the windows' own hashes
        ids, pos, matrix, left, right = (x[often_rows] for x in (ids, pos, matrix, left, right))
        hashes = _row_hash(matrix)
        for a in range(LEFT + 1):
            rows = np.flatnonzero((left >= a) & (right >= SPAN - a))
            key = (hashes[rows, LEFT - a + SPAN] - hashes[rows, LEFT - a]) * powers(BASE_INVERSE, WIDTH + 1)[LEFT - a]
            block = np.zeros((len(rows), WIDTH), np.uint8)
            block[:, LEFT:] = matrix[rows, LEFT - a : LEFT - a + SPAN]
            made = [mix(key ^ U64(0xA5A5A5A5)), ids[rows], pos[rows] - a, block, np.zeros(len(rows), np.int64), np.full(len(rows), SPAN)]
            again, own, lead = _equals(made[0], made[1], *made[3:])
            spans.append((made[1][again], made[2][again], made[2][again] + SPAN))
            yield from _rows(*made, ~again, own, lead)
    who, start, end = (np.concatenate([s[i] for s in spans]) for i in range(3))
    if len(who):
        start, end, who = _merge(who, start, end)
        k = len(who)
        blank = pa.nulls(k, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(who), pa.array(start), pa.array((end - start).astype(np.int32)), blank, blank], names=["key", "doc", "pos", "size", "bytes", "more"])


def _binary(edges: np.ndarray, body: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def _rows(key, ids, pos, matrix, left, right, keep, own, lead):
    """Arrow batches of the anchors in ``keep`` with their surroundings; those in ``own`` go as places of their lead."""
    keep = np.flatnonzero(keep & ~own)
    count, places = _folded(own, lead, pos)
    first = np.cumsum(count) - count
    for lo in range(0, len(keep), ROWS_PER_BLOCK):
        part = keep[lo : lo + ROWS_PER_BLOCK]
        n = len(part)
        body = _binary(np.arange(n + 1) * WIDTH, matrix[part])
        more = _binary(np.concatenate([[0], np.cumsum(count[part])]) * 8, places[_ranges(first[part], count[part])])
        yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(ids[part]), pa.array(pos[part]), pa.array((left[part] * 256 + right[part]).astype(np.int32)), body, more], names=["key", "doc", "pos", "size", "bytes", "more"])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first .. first + count - 1 of every row, one row after another."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _merge(who: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of the spans of each document: start, end, document."""
    if not len(who):
        return start, end, who
    order = np.lexsort((start, who))
    who, start, end = who[order], start[order], end[order]
    _, block = np.unique(who, return_inverse=True)
    shift = block * (int(end.max()) + 2)  # documents apart, so one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    begin = np.ones(len(who), bool)
    begin[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(who)) - 1
    return start[first], reach[last] - shift[last], who[first]


class Suffixes:
    """Sorted suffixes of one block of anchor groups (rows of a group are consecutive)."""

    def __init__(self, matrix: np.ndarray, right: np.ndarray, group_start: np.ndarray, group_size: np.ndarray):
        self.matrix, self.right = matrix, right
        self.hashes = _row_hash(matrix)
        self.order = np.arange(len(matrix))
        self.start, self.size = group_start, group_size
        self._sort()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.right[a], self.right[b]).astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes[a, LEFT + mid] - self.hashes[a, LEFT] == self.hashes[b, LEFT + mid] - self.hashes[b, LEFT]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix a sorts before suffix b (or is equal)."""
        n = self.common(a, b)
        ends_a, ends_b = n == self.right[a], n == self.right[b]
        at = np.minimum(LEFT + n, WIDTH - 1)
        less = self.matrix[a, at] < self.matrix[b, at]
        return np.where(ends_a & ends_b, or_equal, np.where(ends_a, True, np.where(ends_b, False, less)))

    def _sort(self) -> None:
        """Bottom-up mergesort of all groups at once: an element's place is its own plus its rank in the sibling run."""
        width = 1
        while (self.size > width).any():
            group = np.flatnonzero(self.size > width)
            size = self.size[group]
            base = np.repeat(self.start[group], size)
            end = base + np.repeat(size, size)
            inner = np.arange(len(base)) - np.repeat(np.cumsum(size) - size, size)
            run = inner // width
            own = base + run * width
            sibling = np.where(run % 2 == 0, own + width, own - width)
            low = np.minimum(sibling, end)
            high = np.minimum(sibling + width, end)
            floor = low.copy()
            mine = self.order[base + inner]
            # an element of a left run counts the smaller ones of the right run; of a right run, also equal ones
            left_run = run % 2 == 0
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                other = self.order[mid]
                goes = np.empty(len(open_), bool)
                for side, equal in ((True, False), (False, True)):
                    pick = left_run[open_] == side
                    goes[pick] = self.before(other[pick], mine[open_][pick], equal)
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
            place = np.minimum(own, np.where(left_run, own, sibling)) + (inner - run * width) + (low - floor)
            order = self.order.copy()
            order[place] = mine
            self.order = order
            width *= 2


def _windows(matrix, left, right, ids, start, size) -> tuple[np.ndarray, np.ndarray]:
    """For every row the least and most bytes before the anchor of a window that an earlier id holds
    (LEFT + 1 and -1 where there is none)."""
    sorted_ = Suffixes(matrix, right, start, size)
    order = sorted_.order
    n = len(order)
    new_group = np.zeros(n, bool)
    new_group[start] = True
    shared = np.zeros(n, np.int64)
    if n > 1:
        shared[1:] = sorted_.common(order[1:], order[:-1])
    shared[new_group] = 0
    fewest, most = np.full(n, LEFT + 1), np.full(n, -1)
    hashes = sorted_.hashes
    for a in range(LEFT + 1):
        run = np.cumsum(shared < SPAN - a)
        fits = np.flatnonzero((left[order] >= a) & (right[order] >= SPAN - a))
        rows = order[fits]
        before = hashes[rows, LEFT] - hashes[rows, LEFT - a]
        key = mix(before ^ mix(run[fits].astype(np.uint64)))
        by = np.lexsort((ids[rows], key))
        rows, key = rows[by], key[by]
        if not len(rows):
            continue
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.repeat(rows[first], np.diff(np.append(np.flatnonzero(first), len(rows))))
        hit = np.flatnonzero(ids[rows] > ids[head])
        window = slice(LEFT - a, LEFT - a + SPAN)
        hit = hit[(matrix[rows[hit], window] == matrix[head[hit], window]).all(axis=1)]
        found = rows[hit]
        fewest[found] = np.minimum(fewest[found], a)
        most[found] = a
    return fewest, most


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of every value of a binary column, and all its bytes; a null is empty."""
    _, edges, body = column.buffers()
    n = len(column)
    if not n or body is None or not body.size:
        return np.zeros(n, np.int64), np.zeros(0, np.uint8)
    edges = np.frombuffer(edges, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.diff(edges), np.frombuffer(body, np.uint8)[edges[0] : edges[-1]]


def _resolve(rows: DataFrame, tasks: int) -> DataFrame:
    """(doc, pos, size) spans that repeat an earlier document, from anchors that meet by key."""

    def run(batches):
        columns = [[np.zeros(0, np.int64)] for _ in range(6)]
        bodies = [np.zeros((0, WIDTH), np.uint8)]
        for batch in batches:
            for store, name in zip(columns, ("key", "doc", "pos", "size"), strict=False):
                store.append(batch.column(name).to_numpy().astype(np.int64))
            bodies.append(_values(batch.column("bytes"))[1].reshape(-1, WIDTH))
            length, body = _values(batch.column("more"))
            columns[4].append(length // 8)
            columns[5].append(np.frombuffer(body.tobytes(), np.int64))
        key, ids, pos, size, count, places = map(np.concatenate, columns)
        matrix = np.concatenate(bodies)
        del bodies, columns
        left, right = size // 256, size % 256
        first = np.cumsum(count) - count
        out = []

        def found(at, before, after):
            """The span from ``before`` bytes before to ``after`` bytes after each place of the rows ``at``."""
            every = np.concatenate([np.arange(len(at)), np.repeat(np.arange(len(at)), count[at])])
            place = np.concatenate([pos[at], places[_ranges(first[at], count[at])]])
            out.append((ids[at][every], place - before[every], place + after[every]))

        if len(key):
            repeat = _equals(key.view(np.uint64), ids, matrix, left, right)[0]
            found(np.flatnonzero(repeat), left[repeat], right[repeat])
            keep = np.flatnonzero(~repeat)
            keep = keep[np.argsort(key[keep], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], key[keep][1:] != key[keep][:-1]]))
            size = np.diff(np.append(edge, len(keep)))
            several = np.maximum.reduceat(ids[keep], edge) != np.minimum.reduceat(ids[keep], edge)
            keep, size = keep[np.repeat(several, size)], size[several]
            ends = np.cumsum(size)
            g = 0
            while g < len(size):  # whole groups, about ROWS_PER_BLOCK rows at a time
                done = int(ends[g - 1]) if g else 0
                h = max(g + 1, int(np.searchsorted(ends, done + ROWS_PER_BLOCK, side="right")))
                rows_ = keep[done : int(ends[h - 1])]
                fewest, most = _windows(matrix[rows_], left[rows_], right[rows_], ids[rows_], ends[g:h] - size[g:h] - done, size[g:h])
                hit = most >= 0
                found(rows_[hit], most[hit], SPAN - fewest[hit])
                g = h
        if out:
            start, end, who = _merge(*(np.concatenate([x[i] for x in out]) for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(start), pa.array((end - start).astype(np.int32))], names=["doc", "pos", "size"])

    return rows.repartition(tasks, "key").mapInArrow(tidy(run), "doc long, pos long, size int")


def repeated_spans(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc, spans): each document's repeated spans, not yet merged; and the tables it reads."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND octet_length(text) >= 50")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 2 / (LEFT + 2) / ANCHORS_PER_TASK))
    shared, shared_path = materialize(_shared(_anchor_rows(docs), tasks), "shared-anchors")
    top = shared.where("doc IS NULL").groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(COMMON_ANCHORS).select("gram").toArrow()
    common = spark.sparkContext.broadcast(np.sort(top.column("gram").to_numpy().view(np.uint64)))
    lists = shared.where("doc IS NOT NULL").groupBy("doc").agg(F.collect_list("gram").alias("grams"))
    contexts, contexts_path = materialize(_context_rows(docs.join(lists, docs.doc_id == lists.doc).select("doc_id", "text", "grams"), common), "contexts")
    discard(spark, shared_path)
    found, found_path = materialize(_resolve(contexts.where("key IS NOT NULL"), tasks), "spans")
    spans = contexts.where("key IS NULL").select("doc", "pos", "size").unionByName(found)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("pos", "size")).alias("spans")), [contexts_path, found_path]


def _merged(spans) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and end arrays of each row's merged spans."""
    lists = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    items = lists.flatten()
    pos, size = items.field("pos").to_numpy().astype(np.int64), items.field("size").to_numpy().astype(np.int64)
    length = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    start, end, who = _merge(np.repeat(np.arange(len(length)), length), pos, pos + size)
    edge = np.searchsorted(who, np.arange(len(length) + 1))
    return [(start[a:b], end[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _with_spans(documents: DataFrame, name: str) -> DataFrame:
    found, _ = repeated_spans(documents)
    return documents.join(found.select(F.col("doc").alias(f"{name}_doc"), F.col("spans").alias(name)), F.col("doc_id") == F.col(f"{name}_doc"), "left").drop(f"{name}_doc")


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    if not len(start):
        return text
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    schema = documents.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            size, removed, spans, digest = [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, (start, end) in zip(texts, _merged(batch.column("spans")), strict=True):
                text = text or b""
                size.append(len(text))
                removed.append(int((end - start).sum()))
                spans.append(len(start))
                digest.append(hashlib.sha256(_kept(text, start, end)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string())], names=schema.names)

    return _with_spans(documents.select("doc_id", "text"), "spans").mapInArrow(tidy(run), schema)


def deduplicate(documents: DataFrame, minimum: int = 1) -> DataFrame:
    """The documents, with all their columns, their text without repeats; ``n_chars`` follows the text.

    Documents that are left with fewer than ``minimum`` bytes, having lost some, are dropped.
    """
    name = free_name(documents, "repeat_spans")
    schema = documents.schema
    has_chars = "n_chars" in documents.columns

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out, stay = [], []
            for text, (start, end) in zip(texts, _merged(batch.column(name)), strict=True):
                kept = text if text is None else _kept(text, start, end).decode("utf-8", "ignore")
                if isinstance(kept, bytes):
                    kept = kept.decode()
                stay.append(not len(start) or len(kept.encode()) >= minimum)
                out.append(kept)
            columns = [pa.array(out, pa.string()) if c == "text" else pa.array([None if t is None else len(t) for t in out], batch.column(c).type) if c == "n_chars" and has_chars else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(stay, pa.bool_()))

    return _with_spans(documents, name).mapInArrow(tidy(run), schema)
