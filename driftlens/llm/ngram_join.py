"""N-gram Jaccard self-join by prefix trees, to classes of linked documents.

A document is the set of its distinct word n-grams in one global order, rare n-grams first (rarity
follows from corpus word counts; ties by hash). Two sets as similar as the threshold share an n-gram
within a short prefix, so documents meet by prefix n-grams only. Equal sets are one class from the
start. Documents that meet are then compared in groups: a group's sets stand in lexicographic order,
which is a prefix tree walked depth first; sets that share a path share the overlap counted along it,
and a subtree is left as soon as the lengths that remain cannot make up the overlap needed.

The comparison has two passes. The first compares each document with one leader for every prefix
n-gram, which ties groups of copies together at linear cost. Documents that meet have a leader in
common; the second pass compares the pairs within a leader's group that are not yet connected, block
by block, first their prefixes and then, for those that may be linked, their sets. Members already
connected among themselves meet only the others, so a group of copies costs its size times the few
that are not of it. No pair that can be linked is left out, and no task gathers more than two blocks.

Sets are compared by 58-bit hashes of their n-grams, not by the words; two n-grams of one pair of
documents fall together with a chance of about their number of pairs in 2**58.

Defined results: texts without words, and null texts, have no n-gram and are linked with nothing;
texts with fewer words than n have their word sequence as the only n-gram; texts are read whole;
repeated rows fall into one class; the different texts of one id are compared each; a null id takes no
part (null component); extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from ._store import discard, materialize, materialize_parts
from ._text import LOWER, SPACE, U64, combine, fitting, mix, prefix_hash, runs, segment_hash, slices, text_chunks, tidy
from .components import connected_components

COMMON_WORDS = 1 << 16
COMMON_GRAMS = 1 << 18
COUNT_BYTES = 8 << 20
CLASSES = 12
CLASS_BITS = U64(6)
GROUP = 256
BLOCK_VALUES = 100_000
STEP = 64
NEVER = 1 << 40
HOT = 4096
SALTS = 64
POST_PARTS = 3
PREFIX_ROOM = 2
SET_SHARE = 4
LEAST_POSTS = 1 << 20
LEAST_ROOM = 1 << 24
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 26


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, doc = runs(~SPACE[data], offsets)
    return segment_hash(prefix_hash(LOWER[data]), starts, ends), doc


def common_values(documents: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and levels of the most frequent words, and of the most frequent n-grams, over all texts.

    At most COMMON_WORDS and COMMON_GRAMS come to the driver. What is rare within every COUNT_BYTES of
    text is not reported, so counts are lower bounds; they only order n-grams and never decide a link.
    """
    nothing = np.zeros(0, np.uint64)

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, limit=COUNT_BYTES)):
            words, grams = [nothing], [nothing]
            for _, _, data, offsets in text_chunks(batch.column("text")):
                hashes, doc = _words(data, offsets)
                words.append(hashes)
                at = fitting(doc, size)
                grams.append(combine(hashes, size)[at] >> CLASS_BITS)
            for kind, values, least in ((0, words, 2), (1, grams, 3)):
                # sorted in place; only the values that are frequent enough are ever copied
                every = np.concatenate(values)
                values.clear()
                every.sort()
                first = np.flatnonzero(every[least - 1 :] == every[: len(every) - least + 1]) if len(every) >= least else np.zeros(0, np.int64)
                first = first[(first == 0) | (every[first] != every[first - 1])]
                n = np.searchsorted(every, every[first], side="right") - first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), pa.array(every[first].view(np.int64)), pa.array(n)], names=["kind", "value", "n"])

    counts = documents.select("text").mapInArrow(tidy(count), "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts, path = materialize(counts, "frequent")
    out = []
    for kind, most in ((0, COMMON_WORDS), (1, COMMON_GRAMS)):
        top = counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(most).select("value", "n").toArrow()
        values, n = top.column("value").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = np.argsort(values)
        out += [values[order], np.minimum(1 + np.log2(n[order] / max(n.min(initial=1), 1)).astype(int), CLASSES).astype(np.uint64)]
    discard(documents.sparkSession, path)
    return tuple(out)


def _level(values: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), np.uint64)
    slot = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[slot] == values, level[slot], U64(0))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, common):
    """(values, document) of the distinct n-grams of a chunk, each document's in global order.

    A value holds the n-gram's frequency class in its top bits and its hash below.
    """
    hashes, doc = _words(data, offsets)
    n_docs = len(offsets) - 1
    words, word_level, grams, gram_level = common
    rank = _level(hashes, words, word_level)
    at = fitting(doc, size)
    values = combine(hashes, size)[at] >> CLASS_BITS
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total += rank[at + j]
    often = _level(values, grams, gram_level)
    # n-grams that are frequent themselves come last; the others by the frequency of their words
    level = np.where(often > 0, U64(40) + often, total * U64(39) // U64(size * CLASSES))
    values = level << (U64(64) - CLASS_BITS) | values
    owner = doc[at]
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):  # the whole sequence is the one n-gram
        first = np.searchsorted(doc, short)
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            whole[has] = mix(whole[has] * U64(0xD1342543DE82EF95) + hashes[first[has] + j] + U64(j + 1))
        values, owner = np.concatenate([values, whole >> CLASS_BITS]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], owner[fresh]


def _offsets_of(owner: np.ndarray, n_docs: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])


def signatures(documents: DataFrame, size: int, percent: int, common) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (set fingerprint) and the prefix of every document."""
    schema = documents.select("doc_id").schema.add("n", "long").add("f1", "long").add("f2", "long").add("prefix", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                values, owner = shingle_sets(data, offsets, size, common.value)
                edge = _offsets_of(owner, hi - lo)
                n = np.diff(edge)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ U64(salt)))]) for salt in (1, 0x5851F42D4C957F2D)]
                prints = [(s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums]
                # a set must share ceil(percent * n / 100) values with any partner, so this many may come first
                length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                place = np.arange(len(values)) - np.repeat(edge[:-1], n)
                prefix = values[place < np.repeat(length, n)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(prefix))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), *map(pa.array, prints), lists], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(tidy(run), schema)


def _sets(documents: DataFrame, size: int, common) -> DataFrame:
    """doc_id and the whole ordered set, as big-endian bytes (so byte order is set order)."""
    schema = documents.select("doc_id").schema.add("tokens", "binary")

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                values, owner = shingle_sets(data, offsets, size, common.value)
                edge, body = _offsets_of(owner, hi - lo) * 8, values.astype(">u8").tobytes()
                tokens = [body[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(tokens, pa.binary())], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(tidy(run), schema)


def trie_matches(query: bytes, members: list[bytes], percent: int) -> list[bool]:
    """Which members (in byte order) reach the similarity with ``query``; one walk over their prefix tree."""
    q = np.frombuffer(query, ">u8").astype(np.uint64)
    out: list[bool] = []
    path = np.zeros(0, np.uint64)  # the previous member
    overlap = np.zeros(1, np.int64)  # overlap[d]: values of the current path, to depth d, that the query holds
    used = np.zeros(1, np.int64)  # used[d]: values of the query below or at that depth's value
    for member in members:
        m = np.frombuffer(member, ">u8").astype(np.uint64)
        both = len(q) + len(m)
        need = -(-percent * both // (100 + percent))  # least intersection with 100 * i >= percent * (both - i)
        shared = min(len(m), len(path))
        differ = np.flatnonzero(m[:shared] != path[:shared])
        depth = min(int(differ[0]) if len(differ) else shared, len(overlap) - 1)
        overlap, used = overlap[: depth + 1], used[: depth + 1]
        path = m
        possible = True
        while True:
            reach = overlap[-1] + min(len(m) - depth, len(q) - used[-1])
            if reach < need:
                possible = False
                break
            if depth == len(m):
                break
            part = m[depth : depth + STEP]
            slot = np.searchsorted(q, part)
            hit = q[np.minimum(slot, len(q) - 1)] == part
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(hit)])
            used = np.concatenate([used, slot + hit])
            depth += len(part)
        out.append(possible and overlap[-1] >= need)
    return out


def _met(rows: DataFrame, sizes: DataFrame, key: str, total: int, by: str) -> DataFrame:
    """``rows`` with the columns of their ``key`` in ``sizes``, whose ``c`` is the number of rows with that key.

    Keys of more than one in HOT of all rows, of which there are HOT at most, are broadcast, and their rows
    are dealt over SALTS parts by the hash of ``by``, so that no key fills a task.
    """
    often = F.col("c") * HOT > total
    hot = sizes.where(often).select(key, F.lit(SALTS).alias("salts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), "salts"), F.lit(0)).cast("int")).drop("salts")
    every = F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0)))
    return dealt.join(sizes.withColumn("salt", every), [key, "salt"]).drop("c", "salt")


def _meetings(heads: DataFrame, total: int) -> list[DataFrame]:
    """(token, id, n, lead, lead_n) of each document and prefix value that others hold.

    Of more than LEAST_POSTS prefix values in all, POST_PARTS tables, to be written one by one: a value is in one of them.
    """
    parts = POST_PARTS if total > LEAST_POSTS else 1

    def part(k):
        posts = heads.select("id", "n", F.explode("tokens").alias("token")).where(F.pmod(F.xxhash64("token"), F.lit(parts)) == k)
        leaders = posts.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("leader")).where("c > 1").select("token", "c", F.col("leader.id").alias("lead"), F.col("leader.n").alias("lead_n"))
        return _met(posts, leaders, "token", total, "id")

    return [part(k) for k in range(parts)]


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough.

    Pairs are grouped by ``a``; large groups are parted by a salt, and ``a``'s set goes to every part.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / GROUP).cast("long"))
    salted = _met(pairs, many, "a", pairs.count(), "b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    members = salted.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "tokens")
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")).join(sets.withColumnRenamed("doc_id", "a"), "a")
    rows = members.unionByName(heads.select("a", "salt", F.lit(None).cast(members.schema["b"].dataType).alias("b"), "tokens"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(count, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull(), "tokens")
    schema = pairs.select("a", "b").schema

    def run(batches):
        now, head, ids, tokens = None, None, [], []

        def flush():
            kept = [i for i, ok in zip(ids, trie_matches(head, tokens, percent), strict=True) if ok] if head is not None else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept), schema_types[0]), pa.array(kept, schema_types[1])], names=["a", "b"])

        schema_types = None
        for batch in batches:
            schema_types = (batch.column("a").type, batch.column("b").type)
            for a, salt, b, body in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "tokens")), strict=True):
                if (a, salt) != now:
                    if ids:
                        yield flush()
                    now, head, ids, tokens = (a, salt), None, [], []
                if b is None:
                    head = body
                else:
                    ids.append(b)
                    tokens.append(body)
        if ids:
            yield flush()

    return grouped.mapInArrow(tidy(run), schema)


def _promising(meetings: DataFrame, percent: int) -> DataFrame:
    """The (a, b) that share enough prefix values, from one row for each value they meet by.

    Of the two prefixes, the one that ends first holds every common value up to its end; beyond it,
    at most the rest of its own set can be common. Pairs that cannot reach the overlap needed go.
    """
    needed = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent))
    beyond = F.greatest(*(F.ceil(F.lit(percent) * F.col(n) / 100) - 1 for n in ("a_n", "b_n")))
    fits = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    return meetings.where(fits).groupBy("a", "a_n", "b", "b_n").agg(F.count("*").alias("shared")).where(F.col("shared") + beyond >= needed).select("a", "b")


def _likely(wanted: DataFrame):
    """A test on long ids that every ``doc_id`` of ``wanted`` passes, and few others: one bit for a hashed id.

    There are 16 to 32 bits for each id, and LEAST_BITS at least. At most MOST_BITS come to the driver and go to
    the workers; beyond that more ids pass.
    """
    spark = wanted.sparkSession
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    slot = lambda i: F.pmod(F.xxhash64(i), F.lit(size))
    marks = wanted.select(slot(F.col("doc_id").cast("long")).alias("slot")).select(F.expr("slot div 64").alias("at"), F.expr("shiftleft(1L, int(slot % 64))").alias("bit"))
    marks = marks.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(size // 64, np.int64)
    filled[marks.column("at").to_numpy()] = marks.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(filled.view(np.uint64))

    def run(columns):
        bits = shared.value
        for column in columns:
            at = column.to_numpy(zero_copy_only=False)
            yield pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & U64(1)).astype(bool))

    test = F.arrow_udf(tidy(run), T.BooleanType(), ArrowUDFType.SCALAR_ITER)
    return lambda i: test(slot(i))


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of each ``doc_id`` of ``wanted``; few other texts are shuffled."""
    likely = docs.where(_likely(wanted)(F.col("doc_id").cast("long")))
    return likely.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _compare(docs: DataFrame, pairs: DataFrame, size: int, percent: int, common) -> tuple[DataFrame, str]:
    """The pairs that are similar enough, and their table's path; only their documents' sets are built."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets, sets_path = materialize(_sets(_chosen(docs, wanted), size, common), "sets")
    links, links_path = materialize(_verify(pairs, sets, percent).distinct(), "links")  # few rows from many tasks: few files
    discard(spark, sets_path)
    return links, links_path


def trie_overlaps(members: list[np.ndarray], queries: list[np.ndarray], need: np.ndarray) -> list[np.ndarray]:
    """For each member (in lexicographic order) the queries that share at least need[member] values.

    One walk over the members' prefix tree carries the overlap with every query; depths shared with
    the previous member are not counted again, and a path is left when no query can still make it.
    """
    known = np.intersect1d(np.concatenate(queries), np.concatenate(members))
    owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    flat = np.concatenate(queries)
    holds = np.zeros((len(known) + 1, len(queries)), bool)  # the last row: values no query holds
    if len(known):
        slot = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[slot] == flat
        holds[slot[hit], owner[hit]] = True
    none = np.zeros(0, np.int64)
    path, overlap, out = np.zeros(0, np.uint64), np.zeros((1, len(queries)), np.int32), []
    for member, least in zip(members, need, strict=True):
        shared = min(len(member), len(path), len(overlap) - 1)
        differ = np.flatnonzero(member[:shared] != path[:shared])
        depth = int(differ[0]) if len(differ) else shared
        path, overlap = member, overlap[: depth + 1]
        while (overlap[-1] + (len(member) - depth) >= least).any():
            if depth == len(member):
                break
            part = member[depth : depth + STEP]
            slot = np.minimum(np.searchsorted(known, part), max(len(known) - 1, 0))
            slot = np.where(known[slot] == part, slot, len(known)) if len(known) else np.full(len(part), 0)
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(holds[slot], axis=0, dtype=np.int32)])
            depth += len(part)
        out.append(np.flatnonzero(overlap[-1] >= least) if depth == len(member) else none)
    return out


def _block_links(first: list, second: list, percent: int, whole: bool) -> list[tuple[int, int]]:
    """Pairs of positions (first, second) of different roots that are similar enough, or may be.

    With ``whole`` sets a pair that earlier pairs already connect is left out.
    """
    second = sorted(second, key=lambda m: m[3].tobytes() if m[3].dtype.byteorder == ">" else m[3].astype(">u8").tobytes())
    n1, n2 = np.array([m[2] for m in first]), np.array([m[2] for m in second])
    r1, r2 = np.array([m[1] for m in first]), np.array([m[1] for m in second])
    need = -(-percent * (n1[None, :] + n2[:, None]) // (100 + percent))
    if not whole:
        need = np.maximum(need - (-(-percent * np.maximum(n1[None, :], n2[:, None]) // 100) - 1), 1)
    need[(r1[None, :] == r2[:, None]) | (np.minimum(n1[None, :], n2[:, None]) * 100 < np.maximum(n1[None, :], n2[:, None]) * percent)] = NEVER
    useful = (need < NEVER).any(axis=1)
    if not useful.any():
        return []
    second = [m for m, u in zip(second, useful, strict=True) if u]
    found = trie_overlaps([m[3].astype(np.uint64) for m in second], [m[3].astype(np.uint64) for m in first], need[useful])
    joined: dict = {}

    def top(x):
        while (y := joined.get(x, x)) != x:
            x = y
        return x

    out = []
    for m, hits in zip(second, found, strict=True):
        for h in hits.tolist():
            q = first[h]
            if whole:
                a, b = top(q[1]), top(m[1])
                if a == b:
                    continue
                joined[max(a, b)] = min(a, b)
            out.append((q[0], m[0]))
    return out


def _blocks(groups: DataFrame, values: DataFrame, percent: int, whole: bool, room: int) -> list[DataFrame]:
    """Compare all documents of different roots within each leader's group, in blocks of bounded size.

    Members of the group's most frequent root have blocks of their own, which meet the other blocks but
    not each other. Every pair of blocks that meet is one unit of work. Returns (lead, id): with ``whole``
    sets the two ends of links that connect roots, else the members that may have a link. A set goes to
    each unit its block is in; where that makes more than ``room`` n-grams of whole sets, and LEAST_ROOM at
    least, the units are dealt over several tables, to be written one by one.
    """
    spark = groups.sparkSession
    by_root = groups.groupBy("lead", "root").agg(F.count("*").alias("c"), F.sum("n").alias("v"))
    by_lead = by_root.groupBy("lead").agg(F.max(F.struct("c", "root", "v")).alias("home"), F.sum("c").alias("c"), F.sum("v").alias("v"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda c, v: F.ceil(F.greatest(c / GROUP, v / BLOCK_VALUES)).cast("long")
    parts = by_lead.select("lead", "c", "v", F.col("home.v").alias("home_v"), F.col("home.root").alias("home"), blocks(F.col("home.c"), F.col("home.v")).alias("at_home"), blocks(F.col("c") - F.col("home.c"), F.col("v") - F.col("home.v")).alias("away"))
    sent = parts.agg(F.sum(F.expr("home_v * away + (v - home_v) * (away + at_home)"))).first()[0] or 0
    units = max(1, -(-sent // max(room, LEAST_ROOM)))
    home, drawn = F.col("root") == F.col("home"), F.xxhash64("id")
    block = F.when(home, F.col("away") + F.pmod(drawn, F.col("at_home"))).otherwise(F.pmod(drawn, F.col("away")))
    placed = _met(groups, parts.drop("v", "home_v"), "lead", groups.count(), "id").withColumn("block", block)
    last = F.col("away") - 1 + F.when(home, 0).otherwise(F.col("at_home"))
    placed = placed.select("lead", "id", "root", "n", "block", F.sequence(F.lit(0).cast("long"), last).alias("others"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def grouped(k):
        at = lambda o: F.pmod(F.xxhash64("lead", F.least("block", o), F.greatest("block", o)), F.lit(units)) == k
        own = placed if units == 1 else placed.withColumn("others", F.filter("others", at)).where(F.size("others") > 0)
        rows = own.join(values, "id").withColumn("other", F.explode("others"))
        rows = rows.select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root", "n", "tokens")
        return rows.repartition(count, "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "block", "id")

    def run(batches):
        now, members = None, []

        def flush():
            lead, i, j = now
            first = [m for m in members if m[4] == i]
            second = first if i == j else [m for m in members if m[4] == j]
            pairs = _block_links(first, second, percent, whole) if first and second else []
            if not whole:
                ids = sorted({x for p in pairs for x in p})
                pairs = [(lead, x) for x in ids]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["lead", "id"])

        for batch in batches:
            for lead, i, j, block, i_d, root, n, body in zip(*(batch.column(c).to_pylist() for c in ("lead", "i", "j", "block", "id", "root", "n", "tokens")), strict=True):
                if (lead, i, j) != now:
                    if members:
                        yield flush()
                    now, members = (lead, i, j), []
                members.append((i_d, root, n, np.frombuffer(body, ">u8") if whole else np.array(body, np.int64).view(np.uint64), block))
        if members:
            yield flush()

    # few rows come from many tasks; the exchange of the distinct lets them stand in few files
    return [grouped(k).mapInArrow(tidy(run), "lead long, id long").distinct() for k in range(units)]


def _distinct(rows: DataFrame, path: str, tag: str) -> tuple[DataFrame, str]:
    found = materialize(rows.distinct(), tag)
    discard(rows.sparkSession, path)
    return found


def _keys(docs: DataFrame) -> DataFrame | None:
    """A key for each (doc_id, text_hash), ordered as the ids are, if some id has different texts; else None."""
    pairs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    if pairs.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high").isEmpty():
        return None
    ordered = pairs.distinct().orderBy("doc_id", "text_hash")
    return materialize(ordered.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("key")), "keys")[0]


def _linked_keys(docs: DataFrame, keys: DataFrame, size: int, percent: int) -> DataFrame:
    """What _linked returns, with keys in place of ids."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    keyed = hashed.join(keys.hint("merge"), ["doc_id", "text_hash"], "left").select(F.col("key").alias("doc_id"), "text")
    keyed, path = materialize(keyed, "keyed")
    found = _linked(keyed, size, percent)
    discard(docs.sparkSession, path)
    return found


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    docs = documents.select("doc_id", "text")
    keys = _keys(docs)
    if keys is None:
        return _linked(docs, size, percent)
    found = _linked_keys(docs, keys, size, percent).select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("lowest"))
    lowest = keys.select(F.col("key").alias("lowest"), F.col("doc_id").alias("component_id"))
    return found.join(keys.select("key", "doc_id"), "key", "left").join(lowest, "lowest", "left").select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, where no id stands on different texts."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_values(docs, size))
    signed, signed_path = materialize(signatures(docs.withColumn("doc_id", F.col("doc_id").cast("long")), size, percent, common), "signatures")
    classes = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    classes, classes_path = materialize(classes, "classes")
    heads = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    heads, heads_path = materialize(heads.select(F.col("doc_id").alias("id"), "n", F.col("prefix").alias("tokens")), "heads")
    few = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    bare, _ = materialize(signed.select("doc_id", "n", "f1", "f2").coalesce(few), "sizes")
    discard(spark, signed_path)
    total, n_grams = (x or 0 for x in heads.agg(F.sum(F.size("tokens")), F.sum("n")).first())
    met, met_path = materialize_parts(_meetings(heads, total), "meetings")
    # pass one: everyone with the leader of each prefix n-gram they share
    first = _promising(met.where(F.col("id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("lead_n").alias("a_n"), F.col("id").alias("b"), F.col("n").alias("b_n")), percent)
    first, first_path = materialize(first, "first-pairs")
    links, links_path = _compare(docs, first, size, percent, common)
    roots, roots_path = connected_components(links, "a", "b")
    # pass two: documents that meet share a leader, so all pairs left lie within leaders' groups
    met_leader = met.select("lead", "id", "n").unionByName(met.select("lead", F.col("lead").alias("id"), F.col("lead_n").alias("n"))).distinct()
    groups = met_leader.join(roots.withColumnRenamed("node", "id"), "id", "left").select("lead", "id", "n", F.coalesce("root", "id").alias("root"))
    groups, groups_path = materialize(groups, "groups")
    # 31 bits of a value will do here: values that fall together only add to what two prefixes seem to share
    halves = heads.select("id", F.transform("tokens", lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("tokens"))
    active, active_path = materialize_parts(_blocks(groups, halves, percent, False, n_grams * PREFIX_ROOM), "candidates")
    active, active_path = _distinct(active, active_path, "active")
    if not active.isEmpty():
        left = groups.join(active, ["lead", "id"], "left_semi")
        wanted = active.select(F.col("id").alias("doc_id")).distinct()
        sets, sets_path = materialize(_sets(_chosen(docs, wanted), size, common).select(F.col("doc_id").alias("id"), "tokens"), "sets")
        more, more_path = materialize_parts(_blocks(left, sets, percent, True, n_grams // SET_SHARE), "links")
        discard(spark, roots_path, sets_path)
        roots, roots_path = connected_components(links.unionByName(more.select(F.col("lead").alias("a"), F.col("id").alias("b"))), "a", "b")
        discard(spark, more_path)
    discard(spark, heads_path, met_path, first_path, links_path, groups_path, active_path)
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("component"))
    result = bare.join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that are the smallest id of their group.

    Rows with a null id are kept; of rows that repeat an id and its text, all or none stay. Different texts
    of one id stand for themselves; of those in one group, the one of the lowest hash stays.
    """
    docs = documents.select("doc_id", "text")
    keys = _keys(docs)
    groups = _linked(docs, size, percent) if keys is None else _linked_keys(docs, keys, size, percent)
    gone = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id")
    if keys is None:
        return documents.join(gone, "doc_id", "left_anti")
    gone = gone.distinct().join(keys.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("gone_id"), "text_hash"), "doc_id").select("gone_id", F.col("text_hash").alias("gone_hash"))
    same = (documents["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(documents["text"]) == gone["gone_hash"])
    return documents.join(gone, same, "left_anti")
