"""Near-duplicate records by multiple-global-order prefix filtering.

Two word sets with a Jaccard similarity of at least t share a word among the first ``n - ceil(t n) + 1`` words of
each, under any global order of the words. Three orders are used:

* order 1, rare words first, gives the candidates: records are listed under the words of their prefix;
* order 2, the words of one hash class first, rare first within it: it splits lists of order 1 that are longer than
  ``LIST_ROWS`` (the key becomes a prefix word of both orders), and every candidate must pass it;
* order 3, the other class first, which every candidate must pass too.

A list longer than ``EXTEND`` is split by the next word that two sets share under order 1, and by the third where it is still long:
similar sets share at least three words or are equal, and the words skipped before the k-th common one never exceed ``n - ceil(t n)``. Each row
carries 16 bits of each later prefix word for that; sets whose prefix is longer than ``TAIL`` words carry none and meet the sets of their size directly.
Within a list, sorted by size, a row meets the window of sizes that its place allows (how much can still overlap after this word), then
a 256-bit parity sketch of the whole set, whose differing bits never exceed the number of differing words. No filter loses a pair. Survivors are verified on the words of their texts. Lists that stay too long even under two orders are
cut into blocks and compared block by block, so no task holds an unbounded list.

Document frequencies come from a sketch of ``2^20`` counters over all records: any order is valid
as long as it is the same everywhere, so counters may be shared by words.

Records with the same set of words are one class and compared once. Defined results: null ids and contents
are left out, as are contents without words; an id in several rows counts once (smallest keys); an empty table gives an
empty result; other columns are ignored; the threshold is exact in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.words import canonical, fields, words
from quillstone.plans.scratch import Scratch

#: Similarity as a fraction; counters of the frequency sketch; rows of the longest list compared in one task.
T_NUM, T_DEN = 7, 10
SLOTS, LIST_ROWS = 1 << 20, 131_072
#: Listed rows in one task; rows of a list that is split by a further word; the longest prefix that rows carry.
TASK_ROWS, EXTEND, TAIL = 250_000, 1024, 64
#: Rows of lists extended, and pairs formed, at a time.
CHUNK_ROWS, CHUNK_PAIRS = 1 << 16, 1 << 20


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _flat(texts: list[list[str]], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, and the number of the text that each belongs to."""
    sets = [{*w} for w in texts]
    h = np.fromiter((known[w] for s in sets for w in s), np.uint64)
    return h, np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, total = _Hashes(), np.zeros(SLOTS, np.int64)
    for b in batches:
        h, _ = _flat([words(t) for t in b["content"]], known)
        total += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"page": (at >> 10).astype(np.int32), "slot": (at & 1023).astype(np.int32), "n": total[at]})


def _page(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(1024, np.uint32)
    out[pdf["slot"].to_numpy()] = np.minimum(pdf["n"].to_numpy(), 2**32 - 1)
    return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "counts": [out.tobytes()]})


def frequencies(records: DataFrame) -> np.ndarray:
    """Document frequencies over all ``content`` by slot; 4 MB whatever the input."""
    counted = records.select("content").mapInPandas(_slots, "page int, slot int, n bigint").groupBy("page", "slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, np.uint32)
    for page, counts in counted.groupBy("page").applyInPandas(_page, "page int, counts binary").collect():
        out[page << 10 : (page + 1) << 10] = np.frombuffer(counts, np.uint32)
    return out


PARITY = ["p0", "p1", "p2", "p3"]
FORMS = "id string, copy binary, w0 bigint, w1 bigint, n int, p0 bigint, p1 bigint, p2 bigint, p3 bigint, tok array<int>, first int, tails binary"


def _class(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(19)) & np.uint64(1)


def _prefix(n: int) -> int:
    """Words of a set of ``n`` of which similar sets share one, under any order."""
    return n - (T_NUM * n + T_DEN - 1) // T_DEN + 1


def _forms(shared, most: int) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = _Hashes(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):  # the number of the text takes 12 bits of the sort key
                b = whole.slice(at, 4096)
                contents = b.column(1).to_pylist()
                texts = [words(t) for t in contents]
                some = [i for i, w in enumerate(texts) if w]
                if not some:
                    continue
                contents, texts = [contents[i] for i in some], [texts[i] for i in some]
                copy = [xxhash.xxh3_128_digest((canonical(t) if fields(t) is not None else "\x1d" + " ".join(w)).encode("utf-8", "surrogatepass")) for t, w in zip(contents, texts, strict=True)]
                h, row = _flat(texts, known)
                n = np.bincount(row)
                start = np.cumsum(n) - n
                freq = np.minimum(df[(h & np.uint64(SLOTS - 1)).astype(np.int64)], SLOTS - 1).astype(np.uint64)
                order = np.sort((row.astype(np.uint64) << np.uint64(52)) | (freq << np.uint64(32)) | (h >> np.uint64(32)))
                place = np.arange(len(h)) - start[row]
                shared_word = ((order >> np.uint64(32)) & np.uint64(SLOTS - 1)) > 1  # all words after the first such
                prefix = _prefix(n)
                listed = shared_word & (place < prefix[row])
                later = shared_word & (place < prefix[row] + 2) & (prefix <= most)[row]
                first = np.bincount(row[~shared_word], minlength=len(n)).astype(np.int32)
                ends = lambda some, size=1: np.concatenate(([0], size * np.cumsum(np.bincount(row[some], minlength=len(n))))).astype(np.int32)
                tails = (order[later] & np.uint64(0xFFFF)).astype(np.uint16)
                bits = np.bincount(row * 256 + ((h >> np.uint64(20)) & np.uint64(255)).astype(np.int64), minlength=256 * len(n)).reshape(-1, 256) & 1
                parity = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
                twist = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                twist = (twist ^ (twist >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
                columns = [b.column(0).take(pa.array(some)), pa.array(copy, pa.binary()), pa.array(np.add.reduceat(h, start).view(np.int64)), pa.array(np.add.reduceat(twist, start).view(np.int64)), pa.array(n.astype(np.int32))]
                columns += [pa.array(np.ascontiguousarray(parity[:, i])) for i in range(4)]
                columns += [pa.ListArray.from_arrays(pa.array(ends(listed)), pa.array((order[listed] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))), pa.array(first)]
                columns += [pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends(later, 2)), pa.py_buffer(tails)])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "copy", "w0", "w1", "n", *PARITY, "tok", "first", "tails"])

    return run


def _windows(group: np.ndarray, n: np.ndarray, skipped: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of a group whose sizes and skipped words allow enough overlap; rows are sorted by group, then ``n``."""
    u = (T_NUM + T_DEN) * (n - skipped) - T_NUM * n
    last = np.searchsorted((group << 32) | n, (group << 32) | np.maximum(u // T_NUM, 0), "right")
    many = np.maximum(last - np.arange(1, len(n) + 1), 0)
    ends, start = np.cumsum(many), 0
    while start < len(n):
        done = ends[start] - many[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK_PAIRS, "right")))
        m = many[start:stop]
        i = np.repeat(np.arange(start, stop), m)
        j = np.arange(len(i)) - np.repeat(ends[start:stop] - m - done, m) + i + 1
        ok = T_NUM * n[i] <= u[j]
        yield i[ok], j[ok]
        start = stop


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each sorted key, and the sizes of the groups."""
    edge = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    return np.cumsum(edge) - 1, np.diff(np.append(np.flatnonzero(edge), len(key)))


def _compare(key: np.ndarray, place: np.ndarray, rid: np.ndarray, n: np.ndarray, pos: np.ndarray, parity: list[np.ndarray], tails: np.ndarray | None = None, ends: np.ndarray | None = None, extend: int = 0, most: int = TAIL) -> np.ndarray:
    """Candidate pairs of one task's lists; arrays are sorted by ``key``, then ``n``. Both rids of a pair, the smaller first.

    ``tails[ends[r] : ends[r + 1]]`` are the later prefix words of row ``r``; with them, lists of more than ``extend`` rows are split.
    """
    found = [np.zeros((0, 2), np.int64)]
    fewest = _prefix(n) - 1  # words that may be skipped

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        both = n[i] + n[j]
        left = both - 2 * ((T_NUM * both + T_NUM + T_DEN - 1) // (T_NUM + T_DEN))
        for p in parity:
            left -= np.bitwise_count(p[i] ^ p[j])
            ok = left >= 0
            i, j, left = i[ok], j[ok], left[ok]
        ok = ((place[i] < 0) | (place[i] != place[j])) & (rid[i] != rid[j])
        if ok.any():
            a, b = rid[i[ok]], rid[j[ok]]
            found.append(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0))

    def meet(group: np.ndarray, row: np.ndarray, skipped: np.ndarray) -> None:
        for i, j in _windows(group, n[row], skipped):
            keep(row[i], row[j])

    def split(group: np.ndarray, row: np.ndarray, at: np.ndarray, skipped: np.ndarray, word: int) -> None:
        """Rows meet those of their group with the same next word; ``at`` is the place in ``tails`` from which it is sought."""
        m = np.maximum(np.minimum(ends[row + 1] - at, fewest[row] - skipped + 1), 0)
        to = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(at, m)
        bits = int(len(tails)).bit_length()
        order = np.sort((((np.repeat(group, m).astype(np.uint64) << np.uint64(16)) | tails[to]) << np.uint64(bits)) | to.astype(np.uint64))
        to = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
        group, size = _groups(order >> np.uint64(bits))
        row = whose[to]
        skipped = pos[row] + to - ends[row] - (word - 2)
        more = (size > extend) & (word < 3)
        now = ((size > 1) & ~more)[group]
        meet(group[now], row[now], skipped[now])
        again = more[group]
        if again.any():
            group, row, to, skipped = _groups(group[again])[0], row[again], to[again], skipped[again]
            edge = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
            s = 0
            while s < len(edge) - 1:  # whole groups, up to so many rows
                e = max(s + 1, int(np.searchsorted(edge, edge[s] + CHUNK_ROWS, "right")) - 1)
                part = slice(edge[s], edge[e])
                split(group[part] - group[edge[s]], row[part], to[part] + 1, skipped[part], word + 1)
                s = e

    group, size = _groups(key)
    far = (size > extend) if extend else np.zeros(len(size), bool)
    whole = ~far[group]
    if far.any():
        whose = np.repeat(np.arange(len(n)), np.diff(ends))
        long = _prefix(n) > most  # these carry no words: they meet all of their sizes
        met = np.zeros(len(size), bool)
        met[group[long & ~whole]] = True
        whole |= met[group] & (T_DEN * n >= T_NUM * (n[long].min() if long.any() else 0))
        edge = np.concatenate(([0], np.cumsum(size)))
        for s in np.flatnonzero(far):
            row = np.arange(edge[s], edge[s + 1])
            row = row[~long[row]]
            split(np.zeros(len(row), np.int64), row, ends[row], pos[row], 2)
    row = np.flatnonzero(whole)
    meet(group[row], row, pos[row])
    return np.unique(np.concatenate(found), axis=0)


def _lists(extend: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key, place, rid, size, *parity = (t[c].to_numpy() for c in ("key", "place", "rid", "size", *PARITY))
        n = size >> 32
        o = np.lexsort((n, key))
        tails = ends = None
        if extend:
            tail = t["tail"].combine_chunks().take(pa.array(o))
            tail = tail.combine_chunks() if isinstance(tail, pa.ChunkedArray) else tail
            ends = np.frombuffer(tail.buffers()[1], np.int32)[tail.offset : tail.offset + len(tail) + 1].astype(np.int64) // 2
            tails = np.frombuffer(tail.buffers()[2] or b"", np.uint16)
        out = _compare(key[o], place[o], rid[o], n[o], (size & 0xFFFFFFFF)[o], [p[o].view(np.uint64) for p in parity], tails, ends, extend, most)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _sets(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, df = _Hashes(), shared.value
        for b in batches:
            out = []
            for rid, text in zip(b["rid"], b["content"], strict=True):
                h, _ = _flat([words(text)], known)
                freq, q = df[(h & np.uint64(SLOTS - 1)).astype(np.int64)], _prefix(len(h))
                out.append((rid, h.view(np.int64), h[np.lexsort((h, freq, _class(h)))[:q]].view(np.int64), h[np.lexsort((h, freq, 1 - _class(h)))[:q]].view(np.int64)))
            yield pd.DataFrame(out, columns=["rid", "tokens", "order2", "order3"])

    return run


def _texts(rows: DataFrame, classes: DataFrame, rids: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """``rid, tokens, order2, order3`` of some classes, from the text of one member each."""
    sets = rows.join(rids.join(classes.select("rid", "id"), "rid"), "id").select("rid", "content").mapInPandas(_sets(shared), "rid bigint, tokens array<bigint>, order2 array<bigint>, order3 array<bigint>")
    return sets.groupBy("rid").agg(F.min(F.struct("tokens", "order2", "order3")).alias("x")).select("rid", "x.*")


def _candidates(rows: DataFrame, classes: DataFrame, shared, scratch: Scratch) -> DataFrame:  # noqa: ANN001
    """``a, b``: pairs of classes that share a prefix word under order 1 and pass sizes, places and parity.

    ``place`` is negative in a list that is compared as a whole; else the row's own block of two that are compared.
    """
    size = F.shiftleft(F.col("n").cast("long"), 32) + F.col("first")
    listed = classes.select("rid", size.alias("size"), *PARITY, "tails", F.posexplode("tok").alias("i", "key")).select(F.col("key").cast("long"), "rid", (F.col("size") + F.col("i")).alias("size"), *PARITY, F.expr("substring(tails, 2 * i + 3)").alias("tail"))
    counts = listed.groupBy("key").count()
    whole = counts.agg(F.sum("count")).first()[0] or 0
    tasks = lambda rows: max(1, -(-rows // TASK_ROWS))
    columns, pair = ["key", "place", "rid", "size", *PARITY], "a bigint, b bigint"
    long = scratch.cut(counts.where(F.col("count") > LIST_ROWS), "long")
    short = listed if long.isEmpty() else listed.join(long, "key", "left_anti")
    # in two halves of the words, of which only one is on disk at a time
    half = lambda k: short.where(F.pmod("key", F.lit(2)) == k).withColumn("place", F.lit(-1)).select(*columns, "tail").repartition(tasks(-(-whole // 2)), "key").mapInArrow(_lists(EXTEND, TAIL), pair)
    out = scratch.cut(half(0), "half").unionByName(scratch.cut(half(1), "half"))
    if not long.isEmpty():
        hot = listed.drop("tail").join(long.select("key"), "key", "left_semi")
        order2 = scratch.cut(_texts(rows, classes, hot.select("rid").distinct(), shared).select("rid", F.explode("order2").alias("t2")), "order2")
        twice = hot.join(order2, "rid").withColumn("key", F.xxhash64("key", "t2")).drop("t2")
        counts = scratch.cut(twice.groupBy("key").count().where(F.col("count") > 1), "counts")
        blocks = F.ceil(F.col("count") / LIST_ROWS).cast("int")
        many = counts.agg(F.sum(F.col("count") * blocks)).first()[0] or 0
        rest, big = twice.join(counts.select("key"), "key", "left_semi"), counts.where(F.col("count") > LIST_ROWS)
        if not big.isEmpty():
            cut = rest.join(big.withColumn("k", blocks).select("key", "k"), "key").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("k")).cast("int"))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("place", F.when(F.col("other") == F.col("own"), -1).otherwise(F.col("own")))
            cut = cut.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            rest = rest.join(big, "key", "left_anti").withColumn("place", F.lit(-1)).select(*columns).unionByName(cut.select(*columns))
        else:
            rest = rest.withColumn("place", F.lit(-1)).select(*columns)
        out = out.unionByName(rest.repartition(tasks(many), "key").mapInArrow(_lists(0, TAIL), pair))
    return out.distinct()


def near_duplicates(records: DataFrame, scratch: Scratch, id_col: str = "id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Members ``id, rid, copy`` with the class of every record, and the similar classes ``a, b``."""
    spark: SparkSession = records.sparkSession
    rows = records.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).where("id is not null and content is not null")
    shared = spark.sparkContext.broadcast(frequencies(rows))
    forms = scratch.cut(rows.mapInArrow(_forms(shared, TAIL), FORMS), "forms")
    classes = forms.groupBy("w0", "w1").agg(F.min(F.struct("id", "n", *PARITY, "tok", "first", "tails")).alias("x")).select("w0", "w1", "x.*")
    classes = scratch.cut(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    members = forms.groupBy("id").agg(F.min(F.struct("copy", "w0", "w1")).alias("x")).select("id", "x.*").join(classes.select("w0", "w1", "rid"), ["w0", "w1"]).select("id", "rid", "copy")
    members = scratch.cut(members, "members")
    scratch.drop(forms)
    pairs = scratch.cut(_candidates(rows, classes, shared, scratch), "candidates")
    used = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    sets = scratch.cut(_texts(rows, classes, used, shared), "sets")
    scratch.drop(classes)
    side = lambda s: sets.select(F.col("rid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("tokens", "order2", "order3")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("arrays_overlap(order2_a, order2_b) and arrays_overlap(order3_a, order3_b)")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    similar = both.where(common * (T_NUM + T_DEN) >= (F.size("tokens_a") + F.size("tokens_b")) * T_NUM).select("a", "b")
    return members, scratch.cut(similar, "similar")


def member_pairs(members: DataFrame, similar: DataFrame) -> DataFrame:
    """``block_a < block_b``: the members of similar classes, and of one class if they are not copies."""
    left, right = members.select(F.col("rid").alias("a"), F.col("id").alias("x")), members.select(F.col("rid").alias("b"), F.col("id").alias("y"))
    across = similar.join(left, "a").join(right, "b").select(F.least("x", "y").alias("block_a"), F.greatest("x", "y").alias("block_b"))
    mixed = members.groupBy("rid").agg((F.min("copy") != F.max("copy")).alias("mixed")).where("mixed").select("rid")
    inner = members.join(mixed, "rid", "left_semi")
    other = inner.select("rid", F.col("id").alias("block_b"), F.col("copy").alias("copy_b"))
    within = inner.select("rid", F.col("id").alias("block_a"), "copy").join(other, "rid").where("block_a < block_b and copy <> copy_b").select("block_a", "block_b")
    return across.unionByName(within)
