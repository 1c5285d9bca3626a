"""Similarity join on word n-grams with rare-first prefix filtering.

Texts with equal shingle sets are one class. Shingles are ordered rare first: by the logarithm
of their count in a fixed-size table of hashed counts, then by hash. Two sets with Jaccard
similarity of at least t share a shingle in their prefixes of n - ceil(t n) + 1 shingles, so classes
meet in the buckets of their prefix shingles.

A group of near copies would fill a bucket with all its pairs. Only links between components matter,
so a bucket first compares all its members to its most central one, its pivot, whose shingles are the
commonest on the whole (a star). Members of one component need no further comparison. In a bucket of
few members, what still differs is compared pair by pair. In a larger one, prefix filtering is applied
once more, to the shingles in which a member differs from the pivot p: similar sets a and b differ in
at most D = (1 - t) / (1 + t) (|a| + |b|) shingles, so the differences A = a ^ p and B = b ^ p share
at least (|A| + |B| - D) / 2 shingles. Were that nothing, both were linked to p and in one component.
So members meet in the rarest of their differences (what p lacks comes before what p has), and near
copies with edits of their own never meet. See ``around_pivots``.

Length, positional and suffix filters are conditions of the joins; each pair that is left is verified
once, on the words of both texts. The suffix filter compares the shingle counts in 256 parts of the
hash range: each unit of difference is a shingle that only one set has. The join itself compares their
parities, which are a few integers; the counts follow for pairs that pass.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import bitmap_has, free_shuffles, materialise, may_hold, membership_bitmap, release, trim
from lodeweave.llm.components import components
from lodeweave.llm.shingles import shingle_sets

#: Hashed counts: 2**COUNT_BITS in blocks of 2**16. Their size (2 MB as orders) is fixed.
COUNT_BITS = 21
#: The suffix filter's parities, 64 to a column.
PARITIES = ("q0", "q1", "q2", "q3")
#: Steps of an order to a doubling of the count, so that shingles stay apart when the table is full and all counts are near each other.
STEPS = 8
#: Shingles of this order and above (of the hashed counts) may fill a bucket, if their count also stands out from the usual one: their rows are salted.
HOT_ORDER = 9 * STEPS
SALTS = 1024
#: Buckets with up to so many members that still differ are compared pair by pair, larger ones by differences from the pivot.
BUCKET = 48
#: Distinct sets of one task that are remembered, so that copies give their prefix once.
REMEMBERED = 500_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _name(s: np.ndarray) -> int:
    """The 64-bit name of a shingle set."""
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes()))


def _names(s: np.ndarray) -> tuple[int, int]:
    """The name of a set and 64 more bits, by which two sets of one name are told apart."""
    data = s.tobytes()
    return _signed(xxhash.xxh3_64_intdigest(data)), _signed(xxhash.xxh3_64_intdigest(data, 1))


def _row(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of a row's id and text, by which decisions find their rows again."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("row2")]


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The least intersection that makes sets of these sizes similar."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - F.lit(1e-9))


def _counts(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes are in each 256th of their range."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)


def _parities(counts: np.ndarray) -> np.ndarray:
    """Whether each count is odd, as four integers."""
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), *_row(id_col, text_col), F.col(text_col).alias("text"))


def describe(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Per row: id, row hashes, set names (null if empty), set size and parities; and the orders of hashed counts."""
    source = _source(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row bigint, row2 bigint, sid bigint, sid2 bigint, n bigint, {', '.join(f'{q} bigint' for q in PARITIES)}, hist binary, task int, block int, counts binary"
    kinds = pa.schema(
        [("row", pa.int64()), ("row2", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64()), ("n", pa.int64()), *[(q, pa.int64()) for q in PARITIES], ("hist", pa.binary()), ("task", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        id_type, many, held = None, [], 0

        def add() -> None:
            nonlocal table
            table += np.bincount((np.concatenate(many) & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64), minlength=1 << COUNT_BITS)
            many.clear()

        for batch in batches:
            id_type = batch.column(0).type
            sids, sizes, parities, hists = [], [], [], []
            for s in shingle_sets(batch.column(3), k):
                sizes.append(len(s))
                sids.append(_names(s) if len(s) else (None, None))
                counts = _counts(s)
                parities.append(_parities(counts))
                hists.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                many.append(s)
                held += len(s)
                if held > 1 << 20:
                    add()
                    held = 0
            none = [None] * len(sids)
            q = np.array(parities, dtype=np.int64).reshape(-1, 4)
            rest = [batch.column(1), batch.column(2), *[pa.array([x[j] for x in sids], pa.int64()) for j in range(2)], pa.array(sizes, pa.int64()), *[pa.array(q[:, i]) for i in range(4)], pa.array(hists, pa.binary()), *[pa.array(none, kinds.field(x).type) for x in ("task", "block", "counts")]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], names=["id", *kinds.names])
        if many:
            add()
        if table.any():
            task = TaskContext.get().partitionId()
            for block, counts in enumerate(table.reshape(-1, 1 << 16)):
                row = [None] * (len(kinds) - 3) + [task, block, _pack(counts)]
                yield pa.RecordBatch.from_arrays([pa.array([None], id_type), *(pa.array([x], f.type) for x, f in zip(row, kinds, strict=True))], names=["id", *kinds.names])
        trim()

    both = materialise(source.mapInArrow(run, schema), "sets")
    counts = both.where("block is not null").select("task", "block", "counts")
    return both.where("block is null").select("id", "row", "row2", "sid", "sid2", "n", *PARITIES, "hist"), _orders(counts)


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.int64)


def _orders(counts: DataFrame) -> np.ndarray:
    """Sum the tasks' counts, 128 tasks at a time, and give each slot's order (``STEPS`` to a doubling)."""
    most = counts.agg(F.max("task")).first()[0] or 0

    def add(pdf):
        total = sum((_unpack(x) for x in pdf["counts"]), np.zeros(1 << 16, dtype=np.int64))
        return pdf.iloc[:1].assign(counts=[_pack(total)])

    while True:
        counts = counts.withColumn("task", F.floor(F.col("task") / 128).cast("int")).groupBy("task", "block").applyInPandas(add, "task int, block int, counts binary")
        most //= 128
        if not most:
            break
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for r in counts.toLocalIterator():  # 2**(COUNT_BITS - 16) rows
        out[r["block"] << 16 : (r["block"] + 1) << 16] = np.minimum(255, STEPS * np.log2(_unpack(bytes(r["counts"])) + 1)).astype(np.uint8)
    return out


def _hot_order(orders: np.ndarray) -> int:
    """The order from which shingles are salted: ``HOT_ORDER``, or four times the usual count if the table is so full that most slots have more.

    The usual count of a full table is a fixed share of all shingles, so what isn't salted stays a small part of a partition.
    """
    usual = int(np.median(orders))
    return max(HOT_ORDER, usual + 2 * STEPS if usual else 0)


def prefixes(docs: DataFrame, orders: np.ndarray, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The prefix shingles of each set: gram, sid, set size n and place i in the rare-first order (both in ``ni``),
    how rare the set's shingles are on the whole, and whether many sets may have the shingle."""
    shared, hot_order = docs.sparkSession.sparkContext.broadcast(orders), _hot_order(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        seen: set[int] = set()
        names = ["gram", "sid", "ni", "rare", "hot"]
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            held = 0
            for s in shingle_sets(batch.column(0), k):
                n = len(s)
                if not n or (sid := _name(s)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(sid)
                own = rank[(s & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)]
                order = np.argsort(own, kind="stable")
                length = n + (-percent * n) // 100 + 1  # n - ceil(percent n / 100) + 1
                out[0].append(s[order[:length]].view(np.int64))
                out[1].append(np.full(length, sid, dtype=np.int64))
                out[2].append((n << 32) + np.arange(length, dtype=np.int64))
                out[3].append(np.full(length, -int(1000 * own.mean()), dtype=np.int32))
                out[4].append(own[order[:length]] >= hot_order)
                held += length
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                    out, held = ([], [], [], [], []), 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram bigint, sid bigint, ni bigint, rare int, hot boolean")


def _may_match(percent: int) -> Column:
    """Length and positional filters for two members, a and b, of a bucket."""
    n, m, i, j = (F.col(x) for x in ("an", "bn", "ai", "bi"))
    length = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    return length & (F.least(i, j) + F.least(n - i, m - j) >= least_overlap(n, m, percent))


def _near(percent: int) -> Column:
    """The suffix filter for sets a and b: parts of the hash range whose counts differ in parity."""
    n, m = F.col("an"), F.col("bn")
    apart = sum((F.bit_count(F.col(f"a{q}").bitwiseXOR(F.col(f"b{q}"))) for q in PARITIES), F.lit(0))
    return apart <= n + m - 2 * least_overlap(n, m, percent)


def _member(letter: str) -> list[Column]:
    """The columns of a member, named for one side of a pair."""
    return [F.col(x).alias(f"{letter}{y}") for x, y in (("sid", ""), ("n", "n"), ("i", "i"), *[(q, q) for q in PARITIES])]


def _texts(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """sid and compressed text of the rows in ``wanted``; a bitmap of fixed size spares the other texts.

    The bitmap lets a few rows too many pass; a join by sid drops them. No exchange.
    """
    bitmap = membership_bitmap(wanted, "row")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, coder = np.frombuffer(shared.value, dtype=np.uint8), zstandard.ZstdCompressor(level=6)
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).filter(pa.array(bitmap_has(bitmap, batch.column(0).to_numpy())))
            sids, packs, held = [], [], 0
            for text, s in zip(texts, shingle_sets(texts, k), strict=True):
                sid = _name(s)
                if len(s) and sid not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(sid)
                    sids.append(sid)
                    packs.append(coder.compress(text.as_py().encode("utf-8", "surrogatepass")))
                    held += len(packs[-1])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(packs, pa.binary())], names=["sid", "text"])
                        sids, packs, held = [], [], 0
            if sids:
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(packs, pa.binary())], names=["sid", "text"])

    return _source(docs, id_col, text_col).select("row", "text").where(may_hold(bitmap, F.col("row"))).mapInArrow(run, "sid bigint, text binary")


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The suffix filter on counts, for pairs a and b; and the table of counts that it reads."""
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    own = materialise(need.join(sets.select("sid", "n", "hist"), "sid"), "counts")
    joined = pairs.join(own.withColumnsRenamed({"sid": "a", "n": "an", "hist": "ah"}), "a").join(own.withColumnsRenamed({"sid": "b", "n": "bn", "hist": "bh"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(x.as_py() for x in batch.column(h)), dtype=np.uint8).reshape(-1, 256).astype(np.int32) for h in ("ah", "bh"))
            total = batch.column("an").to_numpy() + batch.column("bn").to_numpy()
            least = -((-percent * total) // (100 + percent))
            keep = pa.array(np.abs(left - right).sum(axis=1) <= total - 2 * least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return joined.select("a", "b", "an", "bn", "ah", "bh").mapInArrow(run, "a bigint, b bigint"), own


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b and whether they are similar, by the intersection of both texts' shingle sets; once for each pair."""
    given = materialise(pairs, "pairs")
    free_shuffles(docs.sparkSession)
    close, counts = _close(given, sets, percent)
    pairs = materialise(close, "candidates")
    release(given, counts)
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    texts = materialise(_texts(docs, need.join(sets.select("sid", "row"), "sid"), k, id_col, text_col), "texts")
    joined = pairs.join(texts.withColumnsRenamed({"sid": "b", "text": "bt"}), "b").join(texts.withColumnsRenamed({"sid": "a", "text": "at"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        coder = zstandard.ZstdDecompressor()

        def get(sid: int, data: pa.Scalar) -> np.ndarray:
            s = kept.get(sid)
            if s is None:
                s = kept[sid] = next(shingle_sets(pa.array([coder.decompress(data.as_py()).decode("utf-8", "surrogatepass")]), k))
                if len(kept) > 64:
                    kept.popitem(last=False)
            return s

        for batch in batches:
            ok = []
            for a, b, at, bt in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("at"), batch.column("bt"), strict=True):
                x, y = get(a, at), get(b, bt)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    # a text that two tasks gave is joined twice
    found = materialise(joined.mapInArrow(run, "a bigint, b bigint, ok boolean").distinct(), "verified")
    release(pairs, texts)
    free_shuffles(docs.sparkSession)
    return found


def _buckets(grams: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows (gram, sid, n, i) of grams that several sets have, each gram's pivot and number of sets; and the scratch tables behind them.

    The rows are exchanged once. A gram that many sets may have is dealt over many partitions by its
    sets' names; its parts are then put together from their sums.
    """
    place = [F.shiftright("ni", 32).alias("n"), F.col("ni").bitwiseAND(F.lit(0xFFFFFFFF)).alias("i")]
    salted = grams.withColumn("salt", F.when(F.col("hot"), F.pmod("sid", F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salted = salted.repartition("gram", "salt").dropDuplicates(["gram", "salt", "sid"]).select("gram", "salt", "sid", *place, "rare", "hot")
    part = Window.partitionBy("gram", "salt")
    counted = salted.select("*", F.count("*").over(part).alias("size"), F.min(F.struct("rare", "sid", "n", "i")).over(part).alias("pivot"))
    parts = materialise(counted.where("hot or size > 1").drop("salt", "rare"), "buckets")
    free_shuffles(grams.sparkSession)  # all prefixes
    hot = parts.where("hot")
    # written, so that the join below is between two exchanges, of which a hot gram's rows can be split
    whole = materialise(hot.groupBy("gram").agg(F.count("*").alias("size"), F.min("pivot").alias("pivot")).where("size > 1"), "hot")
    out = parts.where("not hot").unionByName(hot.drop("size", "pivot").join(whole, "gram")).select("gram", "sid", "n", "i", "pivot", "size")
    return out, [parts, whole]


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _mixed(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, besides pivots, of buckets with members of several components; their ``label``, the bucket's
    ``main`` (largest) one and its number of ``members``. Counts are summed before they are exchanged. And the
    table of the buckets, which is written for the same reason as that of hot shingles."""
    # besides the pivot, two members are needed to differ
    left = _labelled(buckets.where("size > 2 and sid <> pivot.sid").drop("size"), labels)
    parts = left.groupBy("gram", "label").agg(F.count("*").alias("same"))
    spans = parts.groupBy("gram").agg(F.max(F.struct("same", "label"))["label"].alias("main"), F.count("*").alias("labels"), F.sum("same").alias("members"))
    spans = materialise(spans.where("labels > 1").drop("labels"), "spans")
    return left.join(spans, "gram"), spans


def _apart(n: int, percent: int) -> int:
    """No two similar sets whose sizes add up to n differ in more shingles."""
    return (100 - percent) * n // (100 + percent)


def around_pivots(members: DataFrame, sets: DataFrame, docs: DataFrame, orders: np.ndarray, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidate pairs (a, b) among the ``members`` (sid, label) of each pivot p that have different labels.

    With A = a ^ p and B = b ^ p, a and b are similar only if A and B share at least
    r = (|A| + |B| - D) / 2 shingles, D being the most in which sets of their sizes may differ. By a rarest-first
    order of these shingles the first shared one is among the first |A| - r + 1 of A and |B| - r + 1 of B.
    One of the two isn't linked to p, as both have different labels: it is the probe, with |A| >= |B| - D.
    The other is indexed. If it is linked to p, then r > (|A| + (1 - t) / (1 + t) (|p| - |a|)) / 2, since B is
    more than p allows; else the one that is nearer to p is indexed, so that r >= |A| - D / 2.
    """
    pivots = members.select("p").distinct()
    need = members.select("sid").union(pivots).distinct()
    texts = materialise(_texts(docs, need.join(sets.select("sid", "row"), "sid"), k, id_col, text_col), "texts")
    # pivots are few: written by themselves, their texts can be broadcast if Spark finds them small, and no member's text is exchanged twice
    centres = materialise(texts.withColumnRenamed("sid", "p").join(pivots, "p", "left_semi").withColumnRenamed("text", "pt"), "pivots")
    joined = members.join(texts.withColumnRenamed("text", "at"), "sid").join(centres, "p")
    shared = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, coder = shared.value, zstandard.ZstdDecompressor()
        kinds = [("p", pa.int64()), ("e", pa.int64()), ("sid", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("far", pa.int64()), ("i", pa.int64()), ("linked", pa.bool_()), ("probe", pa.bool_())]
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def opened(data: pa.Scalar) -> np.ndarray:
            return next(shingle_sets(pa.array([coder.decompress(data.as_py()).decode("utf-8", "surrogatepass")]), k))

        def ordered(s: np.ndarray) -> np.ndarray:
            return s[np.argsort(rank[(s & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)], kind="stable")]

        for batch in batches:
            out: list[list[np.ndarray]] = []
            for p, sid, label, at, pt in zip(*(batch.column(x) for x in ("p", "sid", "label", "at", "pt")), strict=True):
                own = kept.get(p.as_py())
                if own is None:
                    own = kept[p.as_py()] = opened(pt)
                    if len(kept) > 64:
                        kept.popitem(last=False)
                a = opened(at)
                more, less = np.setdiff1d(a, own, assume_unique=True), np.setdiff1d(own, a, assume_unique=True)
                n, m, far = len(a), len(own), len(more) + len(less)
                linked = 100 * (n - len(more)) >= percent * (m + len(more))
                e = np.concatenate([ordered(more), ordered(less)]).view(np.int64)
                most = _apart(n + 100 * n // percent, percent)
                if linked:
                    least = max(1, -(-((100 + percent) * far + (100 - percent) * (m - n)) // (2 * (100 + percent))))
                else:
                    least = max(1, far - most // 2)
                for probe, length in ((False, far - least + 1), (True, 0 if linked else most + 1)):
                    length = min(max(0, length), far)
                    fixed = (p.as_py(), sid.as_py(), label.as_py(), n, far, linked, probe)
                    cols = [np.full(length, x) for x in fixed]
                    out.append([cols[0], e[:length], cols[1], cols[2], cols[3], cols[4], np.arange(length, dtype=np.int64), cols[5], cols[6]])
                if sum(len(x[0]) for x in out) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)], names=[x for x, _ in kinds])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)], names=[x for x, _ in kinds])
        trim()

    rows = materialise(joined.select("p", "sid", "label", "at", "pt").mapInArrow(run, "p bigint, e bigint, sid bigint, label bigint, n bigint, far bigint, i bigint, linked boolean, probe boolean"), "differences")
    release(texts, centres)
    free_shuffles(docs.sparkSession)
    a = rows.where("not probe").select("p", "e", *[F.col(x).alias(y) for x, y in (("sid", "a"), ("label", "al"), ("n", "an"), ("far", "af"), ("i", "ai"), ("linked", "linked"))])
    b = rows.where("probe").select("p", "e", *[F.col(x).alias(y) for x, y in (("sid", "b"), ("label", "bl"), ("n", "bn"), ("far", "bf"), ("i", "bi"))])
    nearer = F.col("linked") | (F.col("af") < F.col("bf")) | ((F.col("af") == F.col("bf")) & (F.col("a") < F.col("b")))
    n, m = F.col("an"), F.col("bn")
    length = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    apart = n + m - 2 * least_overlap(n, m, percent)
    enough = 2 * F.least(F.col("af") - F.col("ai"), F.col("bf") - F.col("bi")) >= F.col("af") + F.col("bf") - apart
    return a.join(b, ["p", "e"]).where(F.col("al") != F.col("bl")).where(nearer & length & enough).select("a", "b")


def _sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The rows and orders of ``describe``, and the distinct sets."""
    rows, orders = describe(docs, k, id_col, text_col)
    # of two sets with one name the first stays; what the sets hold is exchanged once, and once for each task
    one = F.min(F.struct("sid2", "row", "n", *PARITIES, "hist")).alias("one")
    sets = materialise(rows.where("sid is not null").groupBy("sid").agg(one).select("sid", "one.*"), "classes")
    return rows, orders, sets


def all_links(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (id, sid, n, ``n_links``: other rows whose sets are similar, copies among them) and every link (a, b) between
    different sets; ``sid`` tells which rows have which set.

    All pairs that pass the filters are verified, also those of one component: the result has as many rows as there
    are links, the square of a group of near copies. ``link`` finds the components without that. Empty sets have no links.
    """
    rows, orders, sets = _sets(docs, k, id_col, text_col)
    buckets, behind = _buckets(prefixes(docs, orders, k, percent, id_col, text_col))
    held = buckets.join(sets.select("sid", *PARITIES), "sid")
    a, b = (held.select("gram", *_member(x)) for x in "ab")
    pairs = a.join(b, "gram").where("a < b").where(_may_match(percent) & _near(percent)).select("a", "b").distinct()
    links = _verify(pairs, sets, docs, k, percent, id_col, text_col).where("ok").select("a", "b")
    release(*behind)
    named = rows.join(sets.select("sid", "sid2", F.lit(True).alias("first")), ["sid", "sid2"], "left")
    size = named.where("first").groupBy("sid").agg(F.count("*").alias("size"))
    both = links.select(F.col("a").alias("sid"), F.col("b").alias("other")).union(links.select("b", "a"))
    linked = both.join(size.withColumnsRenamed({"sid": "other", "size": "more"}), "other").groupBy("sid").agg(F.sum("more").alias("more"))
    counts = size.join(linked, "sid", "left").select("sid", F.lit(True).alias("first"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return named.join(counts, ["sid", "first"], "left").select("id", "sid", "n", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), links


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The rows (id, row, sid, n, label, component) and verified links between sets (a, b) that span each component.

    The links are not all true links: two sets that are in one component already are not compared with
    each other, so their number says nothing of how many links a document has; ``all_links`` counts them.
    ``label`` names a component by its smallest set. ``component`` is the smallest id that a row reaches by links; of an empty set its own id. Null
    and empty texts have empty sets, linked with nothing. Null ids are passed over as the smallest,
    unless a component has no other. Repeated rows are one class. An empty table gives no rows.
    Other columns are ignored. Shingles are told apart by 64-bit hashes, sets by 128-bit ones: should two sets have
    the same 64-bit name, the second is linked with nothing (it is never taken for the first). Buckets of up to
    ``bucket`` members are compared pair by pair.
    """
    rows, orders, sets = _sets(docs, k, id_col, text_col)
    buckets, behind = _buckets(prefixes(docs, orders, k, percent, id_col, text_col))
    stars = buckets.select(F.col("pivot.sid").alias("a"), F.col("pivot.n").alias("an"), F.col("pivot.i").alias("ai"), F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("i").alias("bi"))
    pairs = stars.where("a <> b").where(_may_match(percent)).select("a", "b").distinct()
    parities = sets.select("sid", "n", *PARITIES)
    for side in "ab":
        pairs = pairs.join(parities.withColumnsRenamed({"sid": side, "n": f"{side}n"} | {q: f"{side}{q}" for q in PARITIES}), side)
    tested = _verify(pairs.where(_near(percent)).select("a", "b"), sets, docs, k, percent, id_col, text_col)
    # what is left: buckets with members of different components
    left, spans = _mixed(buckets, components(tested.where("ok"), "a", "b"))
    left = materialise(left, "mixed")
    release(*behind, spans)
    free_shuffles(docs.sparkSession)
    few = left.where(F.col("members") <= bucket).join(parities.drop("n"), "sid")
    # the largest part of a bucket against the rest
    a = few.where("label <> main").select("gram", F.col("label").alias("al"), *_member("a"))
    b = few.select("gram", "main", F.col("label").alias("bl"), *_member("b"))
    pairs = a.join(b, "gram").where("al <> bl and (bl = main or a < b)").where(_may_match(percent) & _near(percent))
    many = materialise(left.where(F.col("members") > bucket).select("sid", F.col("pivot.sid").alias("p"), "label").distinct(), "members")
    pairs = pairs.select("a", "b").union(around_pivots(many, sets, docs, orders, k, percent, id_col, text_col))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    tested = tested.union(_verify(pairs, sets, docs, k, percent, id_col, text_col))
    release(left, many)
    links = tested.where("ok").select("a", "b")
    labels = components(links, "a", "b")
    ids = rows.where("sid is not null").groupBy("sid", "sid2").agg(F.min("id").alias("id"))
    named = sets.select("sid", "sid2").join(ids, ["sid", "sid2"]).join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    named = named.join(least, "label").select("sid", "sid2", "label", "component")
    out = rows.join(named, ["sid", "sid2"], "left").select("id", "row", "row2", "sid", "n", "label", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
    return out, links


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id, with all its columns.

    Rows without words all stay; of rows that repeat an id and text one stays.
    """
    rows, _ = link(docs, k, percent, id_col, text_col)
    rows = materialise(rows.where("label is not null"), "components")
    # null ids come last
    keep = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "row2")).alias("keep"))
    stays = (F.col("row") == F.col("keep.row")) & (F.col("row2") == F.col("keep.row2"))
    marked = rows.join(keep, "label").select("row", "row2", stays.alias("stays"))
    known = materialise(marked.groupBy("row", "row2").agg(F.min("stays").alias("stays"), F.count("*").alias("times")).where("not stays or times > 1"), "decisions")
    # the caller's columns travel in a struct, so that none of them can clash
    tagged = docs.select(*_row(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    out = tagged.join(known, ["row", "row2"], "left_anti")
    repeated = known.where("stays").select("row", "row2")
    if not repeated.isEmpty():
        out = out.unionByName(tagged.join(repeated, ["row", "row2"], "left_semi").dropDuplicates(["row", "row2"]))
    return out.select("all.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = link(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
