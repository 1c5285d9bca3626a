"""Removal of byte strings that start anywhere else as well, by distributed prefix doubling.

Doubling over every byte would sort each position several times. Here the positions are anchors:
bytes whose 16-byte hash is the least within a radius, which depends on nearby content only, so equal
strings have equal anchors. The text from one anchor to the next is a phrase. Round k sorts pairs of
ranks that are 2**k phrases apart and reranks them; an anchor whose run is unique drops out, and an
anchor whose run gets past what every string of the wanted length around it must hold is alive.

A string of the wanted length belongs to the first anchor in its inner part. Where the whole stretch
of an alive anchor's strings occurs elsewhere, all of them do; only at the edges of repeats (and where
there is no anchor for long, as in periodic text) are the strings compared one by one, by 128-bit
hashes of their bytes. Of strings without an anchor, each text gives every distinct one once.

Passages of many words may be shorter than that many bytes. They are counted beside, in texts that lose nothing:
word n-grams chosen by winnowing (any passage of the wanted number of words holds one that is the least around
it) are ranked with the phrases; where two texts share one, their windows of words around it are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import bitmap_has, materialise, may_hold, membership_bitmap, release
from lodeweave.llm.shingles import packed, pieces, random_odd, shingle_hashes, spread, word_hashes

#: Texts of one task that are remembered, so that copies give their anchors once.
REMEMBERED = 500_000
#: In place of a run: a string without an anchor, and one that its own text holds more than once.
_FAR, _TWICE = -2, -3
#: In place of a run: a word n-gram that winnowing has chosen.
_WORDS = -4
#: Passages of over 50 words are counted, also those below 400 bytes.
PASSAGE_WORDS = 51
_BYTES = random_odd(1 << 30, 256)


@dataclass(frozen=True)
class Shape:
    """How anchors are chosen for strings of ``length`` bytes."""

    length: int

    @property
    def gram(self) -> int:
        return max(1, min(16, self.length // 8))

    @property
    def radius(self) -> int:
        return max(1, min(24, self.length // 16))

    @property
    def reach(self) -> int:
        """A string belongs to an anchor at most so far into its inner part."""
        return max(1, self.length // 3)

    @property
    def ahead(self) -> int:
        """Anchors at most so far behind an anchor are inside each string that belongs to it."""
        return self.length - 2 * self.radius - self.gram - self.reach


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of some joined texts, and which text each is in."""
    w, r = shape.gram, shape.radius
    none = np.zeros(0, dtype=np.int64)
    if len(data) < w + 2 * r:
        return none, none
    with np.errstate(over="ignore"):
        value, have = _BYTES[data], 1
        power = np.uint64(0x9E3779B97F4A7C15)
        while have < w:
            step = min(have, w - have)
            # the hash of have + step bytes from two overlapping hashes
            value = value[: len(value) - step] * power + spread(value[step:]) if step == have else value[: len(value) - step] * power + value[step:]
            have += step
        value = spread(value)
    least = _slide(value, r)
    n = len(value)
    mid = value[r : n - r]
    chosen = np.flatnonzero((mid < least[: n - 2 * r]) & (mid <= least[r + 1 : r + 1 + n - 2 * r])) + r
    text = np.searchsorted(starts, chosen, side="right") - 1
    good = (chosen - r >= starts[text]) & (chosen + r + w <= starts[text + 1])
    return chosen[good], text[good]


@dataclass
class Marks:
    """The anchors of one text and the strings that belong to each."""

    at: np.ndarray
    run: np.ndarray  # phrases that each string of the anchor holds
    low: np.ndarray  # first and last start of the anchor's strings
    high: np.ndarray

    def far(self, n: int, shape: Shape) -> np.ndarray:
        """Starts of strings that belong to no anchor."""
        if n < shape.length:
            return np.zeros(0, dtype=np.int64)
        own = self.low <= self.high
        change = np.zeros(n - shape.length + 2, dtype=np.int64)
        np.add.at(change, self.low[own], 1)
        np.add.at(change, self.high[own] + 1, -1)
        return np.flatnonzero((np.cumsum(change) == 0)[:-1])


def far_strings(view: memoryview, starts: list[int], length: int) -> dict[bytes, list[int]]:
    """The starts of each distinct string among those at ``starts``."""
    out: dict[bytes, list[int]] = {}
    for p in starts:
        out.setdefault(xxhash.xxh3_128_digest(view[p : p + length]), []).append(p)
    return out


def marks(at: np.ndarray, n: int, shape: Shape) -> Marks:
    before = np.concatenate([[-1 << 40], at[:-1]]) if len(at) else at
    low = np.maximum(0, np.maximum(before - shape.radius + 1, at - shape.radius - shape.reach + 1))
    high = np.minimum(at - shape.radius, n - shape.length)
    run = np.searchsorted(at, at + shape.ahead, side="right") - 1 - np.arange(len(at))
    return Marks(at, run, low, high)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def winnowed(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the n-grams of some texts are the least of ``width`` in a row of their text; texts with fewer have none.

    Equal stretches of ``width`` n-grams choose the same ones, wherever they stand.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # no hash is zero, so a row that spans two texts chooses nothing
    least = np.where(text[: n - width + 1] == text[width - 1 :], _slide(hashes, width), np.uint64(0))
    around = np.zeros(n + width - 1, dtype=np.uint64)
    around[width - 1 : n] = least
    return np.flatnonzero(~_slide(~around, width) == hashes)


def _gram(words: int) -> tuple[int, int]:
    """The words of an n-gram and the n-grams in a row of which one is chosen, for passages of so many words."""
    k = max(1, words // 4)
    return k, words - k + 1


def _positions(docs: DataFrame, text_col: str, shape: Shape, words: int | None = None) -> DataFrame:
    """Every phrase and far string of all texts: tid, i (anchor number or start), run (-1: no string belongs to it) and hash.

    With ``words``, the chosen word n-grams too, each distinct one of a text once (i is the number of its first word there).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        digest, w, ahead, length = xxhash.xxh3_64_intdigest, shape.gram, shape.ahead, shape.length
        for batch in batches:
            tids = batch.column(0).to_pylist()
            data, starts = packed(batch.column(1))
            for a, b in pieces(starts):
                own = data[starts[a] : starts[b]]
                base = starts[a : b + 1] - starts[a]
                at, text = anchors(own, base, shape)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                view = memoryview(own.tobytes())
                out: tuple[list, list, list, list] = ([], [], [], [])
                fresh = np.zeros(b - a, dtype=bool)
                for t in range(b - a):
                    n, tid = int(base[t + 1] - base[t]), tids[a + t]
                    if n < least or tid in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(tid)
                    fresh[t] = True
                    if n < length:
                        continue
                    here = view[base[t] : base[t + 1]]
                    m = marks(at[cut[t] : cut[t + 1]] - base[t], n, shape)
                    where = m.at.tolist()
                    belongs = (m.low <= m.high).tolist()
                    for i, (x, k, ok) in enumerate(zip(where, m.run.tolist(), belongs, strict=True)):
                        if k:
                            h = digest(here[x : where[i + 1] + w])
                        elif ok:
                            h = digest(here[x : x + ahead + w], 1)
                        else:
                            continue
                        out[0].append(tid)
                        out[1].append(i)
                        out[2].append(k if ok else -1)
                        out[3].append(_signed(h))
                    for string, places in far_strings(here, m.far(n, shape).tolist(), length).items():
                        out[0].append(tid)
                        out[1].append(places[0])
                        out[2].append(_FAR if len(places) == 1 else _TWICE)
                        out[3].append(_signed(digest(string, 2)))
                if out[0]:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["tid", "i", "run", "h"])
                if words:
                    size, width = _gram(words)
                    hashes, at_text = shingle_hashes(*word_hashes(own, base), b - a, size)
                    hashes |= np.uint64(1)
                    chosen = winnowed(hashes, at_text, width)
                    text = np.searchsorted(at_text, chosen, side="right") - 1
                    keep = fresh[text]
                    chosen, text = chosen[keep], text[keep]
                    if len(chosen):
                        # periodic text chooses the same n-gram at every word
                        order = np.lexsort((hashes[chosen], text))
                        once = np.ones(len(order), dtype=bool)
                        once[1:] = (np.diff(text[order]) != 0) | (np.diff(hashes[chosen[order]]) != 0)
                        chosen, text = chosen[order[once]], text[order[once]]
                        columns = [np.array(tids[a:b])[text], (chosen - at_text[text]).astype(np.int32), np.full(len(chosen), _WORDS, dtype=np.int32), spread(hashes[chosen]).view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["tid", "i", "run", "h"])

    least = min(shape.length, 2 * words - 1) if words else shape.length
    return docs.select(F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text")).where(F.octet_length("text") >= least).mapInArrow(run, "tid bigint, i int, run int, h bigint")


def _repeated(rows: DataFrame, key: list[str], spot: list[str], keep: Column | None = None) -> DataFrame:
    """The rows (besides those to ``keep``) whose key occurs at another spot as well, with the key's new rank: the least name of its spots.

    Spark sorts the keys; equal neighbours get one rank. Repeated rows of one spot count once.
    """
    group = Window.partitionBy(*key)
    named = rows.withColumn("_u", F.xxhash64(*spot))
    return named.select("*", F.min("_u").over(group).alias("rank"), F.max("_u").over(group).alias("_most")).where(F.col("rank") != F.col("_most") if keep is None else keep | (F.col("rank") != F.col("_most"))).drop("_u", "_most")


def _doubled(first: DataFrame, shape: Shape) -> DataFrame:
    """Alive anchors: tid, i and the rank of the run that all their strings hold."""
    level, k, alive, levels = first, 0, None, []
    most = shape.ahead // (shape.radius + 1) + 1
    while True:
        step = 1 << k
        # runs of step to 2 step - 1 phrases: two overlapping runs of step
        ends = level.where((F.col("run") >= step) & (F.col("run") < 2 * step) | (F.lit(k == 0) & (F.col("run") == 0)))
        other = level.select("tid", F.col("i").alias("j"), F.col("rank").alias("rank2"))
        here = ends.withColumn("j", F.when(F.col("run") > step, F.col("i") + F.col("run") - step).otherwise(F.col("i"))).join(other, ["tid", "j"]).drop("j")
        done = _repeated(here.withColumnRenamed("rank", "rank1"), ["rank1", "rank2", "run"], ["tid", "i"]).select("tid", "i", "rank")
        alive = done if alive is None else alive.union(done)
        if most < 2 * step:
            out = materialise(alive, "alive")
            release(*levels)
            return out
        other = level.select("tid", (F.col("i") - step).alias("i"), F.col("rank").alias("rank2"))
        pairs = level.withColumnRenamed("rank", "rank1").join(other, ["tid", "i"])
        level = materialise(_repeated(pairs, ["rank1", "rank2"], ["tid", "i"]).select("tid", "i", "run", "rank"), f"ranks-{2 * step}")
        levels.append(level)
        k += 1


def _fetch(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with tid) and each text, compressed; a bitmap of fixed size spares the other texts the exchange."""
    bitmap = membership_bitmap(wanted, "tid")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, coder = np.frombuffer(shared.value, dtype=np.uint8), zstandard.ZstdCompressor(level=1)
        seen: set[int] = set()
        for batch in batches:
            hit = np.flatnonzero(bitmap_has(bitmap, batch.column(0).to_numpy()))
            ids, texts, held = [], [], 0
            for i in hit.tolist():
                tid = batch.column(0)[i].as_py()
                if tid in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(tid)
                ids.append(tid)
                texts.append(coder.compress(batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")))
                held += len(texts[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["tid", "text"])
                    ids, texts, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["tid", "text"])

    found = docs.select(F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text")).where(F.octet_length("text") > 0).where(may_hold(bitmap, F.col("tid"))).mapInArrow(run, "tid bigint, text binary")
    return wanted.join(found.dropDuplicates(["tid"]), "tid")


def _opened(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x.as_py()), dtype=np.uint8)


def _stretches(texts: DataFrame, shape: Shape) -> DataFrame:
    """For each alive anchor: its first and last start, and the hash of the stretch that its strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                alive = batch.column(2)[row].as_py()
                if not alive:
                    continue
                tid, data = batch.column(0)[row].as_py(), _opened(batch.column(1)[row])
                at, _ = anchors(data, np.array([0, len(data)]), shape)
                m, view = marks(at, len(data), shape), memoryview(data)
                i = np.array([x["i"] for x in alive])
                low, high = m.low[i].tolist(), m.high[i].tolist()
                stretch = [xxhash.xxh3_128_digest(view[a : b + shape.length], x - a) for a, b, x in zip(low, high, m.at[i].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tid] * len(i), pa.int64()), pa.array(i, pa.int32()), pa.array([x["rank"] for x in alive], pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(stretch, pa.binary())],
                    names=["tid", "i", "rank", "low", "high", "stretch"],
                )

    return texts.select("tid", "text", "alive").mapInArrow(run, "tid bigint, i int, rank bigint, low int, high int, stretch binary")


def _strings(texts: DataFrame, shape: Shape) -> DataFrame:
    """The 128-bit hash of each string that starts in a text's ``ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tid, view = batch.column(0)[row].as_py(), memoryview(_opened(batch.column(1)[row]))
                starts = np.unique(np.concatenate([np.arange(x["low"], x["high"] + 1) for x in batch.column(2)[row].as_py()]))
                for k in range(0, len(starts), 100_000):
                    part = starts[k : k + 100_000]
                    hashes = [xxhash.xxh3_128_digest(view[p : p + shape.length]) for p in part.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([tid] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array(hashes, pa.binary())], names=["tid", "p", "string"])

    return texts.select("tid", "text", "ranges").mapInArrow(run, "tid bigint, p int, string binary")


def _cleaned(texts: DataFrame, shape: Shape) -> DataFrame:
    """What is left of each text when the strings that start in ``ranges`` are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                data = _opened(batch.column(1)[row])
                change = np.zeros(len(data) + 1, dtype=np.int64)
                found = batch.column(2)[row].as_py()
                twice = {x["low"] for x in found if x["high"] < 0}
                if twice:  # every place of a string that the text holds more than once
                    at, _ = anchors(data, np.array([0, len(data)]), shape)
                    places = far_strings(memoryview(data), marks(at, len(data), shape).far(len(data), shape).tolist(), shape.length)
                    found = [x for x in found if x["high"] >= 0] + [{"low": p, "high": p} for own in places.values() if own[0] in twice for p in own]
                for x in found:
                    change[x["low"]] += 1
                    change[x["high"] + shape.length] -= 1
                gone = np.cumsum(change)[:-1] > 0
                begins = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
                ends = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]])) + 1
                rows.append((batch.column(0)[row].as_py(), hashlib.sha256(data.tobytes()).hexdigest(), int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(begins, ends, strict=True)], hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), span, pa.string()), strict=True)], names=["tid", "sha", "n_removed", "spans", "kept_sha256"])

    return texts.select("tid", "text", "ranges").mapInArrow(run, "tid bigint, sha string, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def _windows(texts: DataFrame, words: int) -> DataFrame:
    """The 128-bit hash of each window of ``words`` words around the n-grams that stand ``at`` some words of a text, wherever
    they occur in it: tid, p (first word) and string."""
    size, width = _gram(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = _opened(batch.column(1)[row])
                own, text = word_hashes(data, np.array([0, len(data)]))
                grams, _ = shingle_hashes(own, text, 1, size)
                at = np.flatnonzero(np.isin(grams, grams[np.array(batch.column(2)[row].as_py(), dtype=np.int64)]))
                change = np.zeros(len(own) + 1, dtype=np.int64)  # the windows that hold one of the n-grams
                np.add.at(change, np.maximum(0, at - width + 1), 1)
                np.add.at(change, at + 1, -1)
                p = np.flatnonzero(np.cumsum(change)[: max(0, len(own) - words + 1)] > 0)
                view = memoryview(own.tobytes())
                hashes = [xxhash.xxh3_128_digest(view[8 * i : 8 * (i + words)]) for i in p.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(p), pa.int64()), pa.array(p, pa.int32()), pa.array(hashes, pa.binary())], names=["tid", "p", "string"])

    return texts.select("tid", "text", "at").mapInArrow(run, "tid bigint, p int, string binary")


def _passages(docs: DataFrame, text_col: str, grams: DataFrame, settled: DataFrame, words: int) -> DataFrame:
    """tid and ``passages``: for texts not ``settled`` (tid), the runs of overlapping windows of ``words`` words that another text has too.

    ``grams`` are the chosen n-grams that occur at several places, with their rank. Those that no open text has are left out.
    """
    wanted = grams.join(settled, "tid", "left_anti").select("rank").distinct()
    need = materialise(grams.join(wanted, "rank", "left_semi").groupBy("tid").agg(F.collect_list("i").alias("at")), "grams")
    texts = _fetch(docs, text_col, need).select("tid", "text", "at")
    shared = _repeated(_windows(texts, words), ["string"], ["tid"]).select("tid", "p")
    before = F.lag("p").over(Window.partitionBy("tid").orderBy("p"))
    runs = shared.distinct().withColumn("new", before.isNull() | (F.col("p") - before > words))
    found = materialise(runs.where("new").groupBy("tid").agg(F.count("*").alias("passages")).join(settled, "tid", "left_anti"), "passages")
    release(need)
    return found


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``spans`` (array<struct<start,end>>, maximal runs) and ``kept_sha256``.

    With ``words``, also ``passages``: the spans of a text that loses bytes, and of one that loses none its passages of at least so
    many words (white space apart, A-Z in either case) that another text has too. They stay: only bytes decide what goes.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or
    another; overlaps count. Null and empty texts lose nothing, nor do texts below ``length`` bytes.
    Repeated rows are copies of each other and go whole. An empty table gives no rows. Other columns
    are ignored. Texts are told apart by SHA-256 where bytes are removed; should two texts have the same 64-bit name,
    one of them loses nothing. Strings are compared by 128-bit hashes.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    shape = Shape(length)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "rows")
    copies = rows.groupBy("tid", "sha").agg(F.count("*").alias("copies"))
    first = _repeated(_positions(docs, text_col, shape, words), ["h"], ["tid", "i"], F.col("run") == _TWICE).select("tid", "i", "run", "rank")
    first = materialise(first.dropDuplicates(["tid", "i", "run"]), "ranks-1")
    alive = _doubled(first.where(F.col("run") > _FAR), shape)
    twice = F.when(F.col("run") == _TWICE, F.lit(-1)).otherwise(F.col("i"))
    far = first.where(F.col("run").isin(_FAR, _TWICE)).groupBy("tid").agg(F.collect_list(F.struct(F.col("i").alias("low"), twice.alias("high"))).alias("far"))
    wanted = alive.groupBy("tid").agg(F.collect_list(F.struct("i", "rank")).alias("alive")).join(far, "tid", "full")
    texts = materialise(_fetch(docs, text_col, wanted), "texts")
    release(alive)
    stretches = materialise(_stretches(texts, shape), "stretches")
    # stretches that occur elsewhere settle all their strings; the rest are compared with one of each kind of their run
    spot = F.xxhash64("tid", "i")
    kinds = stretches.groupBy("rank", "stretch").agg(F.min(spot).alias("one"), F.max(spot).alias("most"))
    open_runs = kinds.where("one = most").select("rank").distinct()
    settled = stretches.join(kinds.where("one <> most"), ["rank", "stretch"])
    sole = stretches.join(kinds.where("one = most").select("rank", "stretch"), ["rank", "stretch"], "left_semi")
    samples = settled.where(F.col("one") == spot).join(open_runs, "rank", "left_semi")
    far = texts.select("tid", F.explode("far").alias("x"))
    single = sole.select("tid", "low", "high").union(samples.select("tid", "low", "high")).union(far.select("tid", "x.low", F.col("x.low").alias("high")))
    strings = _strings(texts.select("tid", "text").join(_ranges(single), "tid"), shape)
    found = _repeated(strings, ["string"], ["tid", "p"]).select("tid", F.col("p").alias("low"), F.col("p").alias("high"))
    ranges = _ranges(settled.select("tid", "low", "high").union(found).union(far.where("x.high = -1").select("tid", "x.low", "x.high")))
    cleaned = materialise(_cleaned(texts.select("tid", "text").join(ranges, "tid"), shape), "cleaned")
    release(texts, stretches)
    found = None
    if words:
        settled = cleaned.select("tid").union(rows.join(copies.where("copies > 1"), ["tid", "sha"], "left_semi").where(F.col("n_bytes") >= length).select("tid")).distinct()
        found = _passages(docs, text_col, first.where(F.col("run") == _WORDS).select("tid", "i", "rank"), settled, words)
    release(first)
    joined = rows.join(copies.where("copies > 1"), ["tid", "sha"], "left").join(cleaned, ["tid", "sha"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = joined.select(
        "id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, everything).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "tid",
    )
    if found is not None:
        out = out.join(found, "tid", "left").withColumn("passages", F.size("spans").cast("long") + F.coalesce("passages", F.lit(0)))
    return out.drop("tid").withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=PASSAGE_WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", F.col("passages").alias("n_passages"))
