"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders. Windows of five template tokens of the benchmark
are matched by hash against those of all documents; where enough of an item's windows are found at
one place, the slots' values are compared: each value of the item must stand for one value of the
document and the other way round. So a question is caught with its own values and with others, but
not a text that merely has numbers in the same places.

Whether a capitalised first word is a name can't be told, and capitals tell no names in a text in one
case. So windows are looked for in three forms: first words literal, first words as names, and all
names literal. Windows of the last two forms count where they fit the values of the others.

A name may have one word in the item and several in the document, or the other way round. Where an item has
windows at a place but doesn't fit, both are compared once more with runs of capitalised words as one name.

Copies word for word are found beside that: items without a window of enough literals (numbers, lists
of values or names) are looked for by windows of their raw tokens, and 13 raw tokens in a row of any
item are enough, whatever their share of the item.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lodeweave.llm.common import materialise, release, trim

WINDOW = 5
#: Share of an item's windows that a document must hold.
CONTAINMENT = 0.5
#: Literal tokens that a window must have to be looked for.
LEAST_LITERAL = 3
#: A run of raw tokens that is enough by itself is so many windows, each of which shares a token with the next: 13 tokens.
RUN_WINDOWS = 3
RUN = WINDOW + (RUN_WINDOWS - 1) * (WINDOW - 1)
#: Tokens more or less at one point of a document's copy.
MOST_INSERTED = 8
#: UTF-8 bytes of benchmark text in one broadcast block; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20
#: Words that are a unit when they follow a number (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "c f k celsius fahrenheit degree degrees percent pct hz khz mhz ghz w kw mw watt watts v volt volts amp amps j kj joule joules cal kcal calories "
    "b kb mb gb tb byte bytes bit bits usd eur gbp dollar dollars euro euros cent cents mph kmh kph kilometern meter stunden minuten jahre heures minutes ans horas minutos".split()
)
#: Words that often begin a sentence and are no part of a name behind them (fixed values).
OPENERS = frozenset(
    "a after all also although an and as at because before both but by can did do does during each every few first for from given has have he her his how i if in into it its "
    "last let many more most my next no not now of on once one or our over she since so some suppose that the their then there these they this those though to today under until "
    "we what when where which while who whose why will with would yesterday you your "
    "als am auf aus bei da das dem den der des die ein eine einer er es für gestern heute ihr im in ist jede jeder man mit nach sie so und von vor wann warum was wenn wer wie wir wo zu "
    "au aujourd avec ce cette chaque comment dans de des du elle en et hier il ils je la le les leur mais nous on ou par pour quand que quel quelle qui sa si son sur un une vous "
    "al ayer cada como con cuando cuándo cuánto cuántos de del desde el ella en entre es hoy la las los mi no para pero por que qué quien si su sus un una y".split()
)
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W_]+|[.!?:;\n\"«»“”]")
_NUMBER, _UNIT, _NAME = (int.from_bytes(hashlib.sha256(x).digest()[:8], "little") for x in (b"<number>", b"<unit>", b"<name>"))
_POWERS = np.array([int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "little") | 1 for i in range(64)], dtype=np.uint64)
_END, _DIGIT, _UNITS, _CAPITAL, _OPENER = 1, 2, 4, 8, 16


class _Vocabulary(dict):
    """Token -> its place in the arrays of hashes and flags."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.hashes, self.flags = np.zeros(most, dtype=np.uint64), np.zeros(most, dtype=np.uint8)

    def clear(self) -> None:
        super().clear()
        self.flags[:] = 0

    def __missing__(self, token: str) -> int:
        at = len(self)
        if len(token) == 1 and not token.isalnum():
            self.flags[at] = _END
        lower = token.lower()
        first = token[0]
        if first.isdigit():
            self.flags[at] |= _DIGIT
        if lower in UNITS:
            self.flags[at] |= _UNITS
        if lower in OPENERS:
            self.flags[at] |= _OPENER
        if first.isupper() and len(token) > 1 and token[1:].islower():
            self.flags[at] |= _CAPITAL
        self.hashes[at] = xxh3_64_intdigest(lower.encode("utf-8", "surrogatepass"))
        self[token] = at
        return at


@dataclass
class Template:
    """The template of one text: token hashes with placeholders, slot types (0: literal), raw tokens and capitalised first words."""

    raw: np.ndarray
    codes: np.ndarray
    slots: np.ndarray
    first: np.ndarray
    opener: np.ndarray
    adjacent: np.ndarray  # whether nothing stands between a token and the one before

    def joined(self) -> Template:
        """The template with each run of names as one; its raw token stands for the whole run."""
        part = (self.slots == 3) | (self.first & ~self.opener)
        begin = np.ones(len(self.raw), dtype=bool)
        begin[1:] = ~((self.slots[1:] == 3) & part[:-1] & self.adjacent[1:])
        at = np.flatnonzero(begin)
        place = np.arange(len(begin)) - np.repeat(at, np.diff(at, append=len(begin)))
        mixed = np.where(place > 0, (self.raw ^ (self.raw >> np.uint64(31))) * _POWERS[np.minimum(place, 63)], self.raw)
        raw = np.add.reduceat(mixed, at) if len(at) else self.raw
        many = np.diff(at, append=len(begin)) > 1
        # what is no name in the item's own words stays literal as a whole
        codes = np.where(many & (self.slots[at] != 3), raw, self.codes[at])
        return Template(raw, codes, self.slots[at], self.first[at], self.opener[at], self.adjacent[at])

    def forms(self) -> np.ndarray:
        """The codes with first words literal, with first words as names, with all names literal, and the raw tokens."""
        return np.stack([self.codes, np.where(self.first, np.uint64(_NAME), self.codes), np.where(self.slots == 3, self.raw, self.codes), self.raw])


def template(text: str, vocabulary: _Vocabulary) -> Template:
    """A text's template; sentence marks are dropped once they have told names from first words."""
    tokens = _TOKEN.findall(text)
    if len(vocabulary) + len(tokens) > vocabulary.most:
        distinct = set(tokens)
        vocabulary.clear()
        if len(distinct) > vocabulary.most:  # a single text with so many tokens gets arrays of its own
            vocabulary = _Vocabulary(len(distinct))
    at = np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    flags, raw = vocabulary.flags[at], vocabulary.hashes[at]
    keep = np.flatnonzero(flags & _END == 0)
    begins = np.ones(len(keep), dtype=bool)
    begins[1:] = np.diff(keep) > 1
    adjacent = ~begins
    flags, raw = flags[keep], raw[keep]
    number = flags & _DIGIT > 0
    unit = flags & _UNITS > 0
    unit[:1] = False
    unit[1:] &= number[:-1]
    capital = (flags & _CAPITAL > 0) & ~unit & ~number
    name, first = capital & ~begins, capital & begins
    slots = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0))).astype(np.uint8)
    codes = np.where(number, np.uint64(_NUMBER), np.where(unit, np.uint64(_UNIT), np.where(name, np.uint64(_NAME), raw)))
    return Template(raw, codes, slots, first, flags & _OPENER > 0, adjacent)


def windows(codes: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """The hash of each window of ``width`` codes, ``step`` apart (of each row)."""
    n = max(0, codes.shape[-1] - (width - 1) * step)
    out = np.zeros((*codes.shape[:-1], n), dtype=np.uint64)
    for k in range(width):
        x = codes[..., k * step : k * step + n] * _POWERS[k]
        out += x ^ (x >> np.uint64(29))
    out *= _POWERS[width]
    return out ^ (out >> np.uint64(32))


class _Table:
    """A hash table of windows with the items and places that they stand for: the build side of the join.

    A bucket is a range of entries with the same first bits; it is sorted by hash, so that a window's entries are neighbours.
    """

    def __init__(self, hashes: list[np.ndarray], items: list[np.ndarray], places: list[np.ndarray]):
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.items, self.places = h[order], np.concatenate(items)[order], np.concatenate(places)[order]
        bits = max(10, min(24, (16 * len(h)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.full = np.diff(self.starts) > 0

    def matches(self, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places in the document, places in the item) of the windows of a document, given in one or more forms."""
        n = own.shape[-1]
        own = own.ravel()
        bucket = own >> self.shift
        hit = np.flatnonzero(self.full[bucket])
        if not len(hit):
            return
        bucket = bucket[hit].astype(np.int64)
        low = self.starts[bucket]
        reps = self.starts[bucket + 1] - low
        probe = np.repeat(hit, reps)
        theirs = np.repeat(low, reps) + np.arange(len(probe)) - np.repeat(np.cumsum(reps) - reps, reps)
        same = self.hashes[theirs] == own[probe]
        ours, theirs = probe[same] % n, theirs[same]
        if not len(ours):
            return
        which, at = self.items[theirs], self.places[theirs]
        order = np.lexsort((at, ours, which))
        which, ours, at = which[order], ours[order], at[order]
        more = np.diff(which, prepend=-1) != 0  # a window may be the same in several forms
        more[1:] |= (np.diff(ours) != 0) | (np.diff(at) != 0)
        which, ours, at = which[more], ours[more], at[more]
        cuts = np.flatnonzero(np.diff(which)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(which)], strict=True):
            yield int(which[a]), ours[a:b], at[a:b]


def _wanted(t: Template, own: np.ndarray, width: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which windows of an item have enough literals to be looked for, and which in each of the first three forms."""
    enough = min(LEAST_LITERAL, width)
    good = np.convolve(t.slots == 0, np.ones(width, dtype=int), "valid") >= enough
    without_first = np.convolve((t.slots == 0) & ~t.first, np.ones(width, dtype=int), "valid") >= enough
    return good, (good, without_first & (own[1] != own[0]), good & (own[2] != own[0]))


class Index:
    """The windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[object, str | None]]):
        vocabulary = _Vocabulary()
        self.items, self.good, self.wanted, self.joined = [], [], [], {}
        by_width, runs = defaultdict(lambda: ([], [], [])), ([], [], [])

        def add(to: tuple[list, list, list], number: int, form: np.ndarray, which: np.ndarray) -> None:
            at = np.flatnonzero(which)
            for column, value in zip(to, (form[at], np.full(len(at), number), at), strict=True):
                column.append(value)

        for number, (key, text) in enumerate(items):
            t = template(text or "", vocabulary)
            width = min(WINDOW, len(t.codes))
            good = np.zeros(0, dtype=bool)
            if width:
                own = windows(t.forms(), width)
                good, wanted = _wanted(t, own, width)
                if good.any():
                    for form, which in zip(own, wanted, strict=False):
                        add(by_width[width], number, form, which)
                else:  # nothing but slots: word for word only
                    good = np.ones(len(good), dtype=bool)
                    add(by_width[width], number, own[3], good)
                if len(t.codes) >= RUN:
                    run = windows(own[3], RUN_WINDOWS, WINDOW - 1)
                    add(runs, number, run, np.ones(len(run), dtype=bool))
            self.good.append(good)
            self.wanted.append(int(good.sum()))
            self.items.append((key, t))
        self.by_width = {width: _Table(*columns) for width, columns in by_width.items()}
        self.runs = _Table(*runs) if runs[0] else None

    def _joined(self, number: int) -> tuple[Template, np.ndarray, _Table | None]:
        """An item with runs of names as one: its template, the windows wanted and their table."""
        if number not in self.joined:
            t = self.items[number][1].joined()
            width = min(WINDOW, len(t.codes))
            own = windows(t.forms(), width)
            good, wanted = _wanted(t, own, width)
            at = [np.flatnonzero(w) for w in wanted]
            table = _Table([form[i] for form, i in zip(own, at, strict=False)], [np.full(len(i), number) for i in at], at) if good.any() else None
            self.joined[number] = t, good, table
        return self.joined[number]

    def matches(self, t: Template) -> list[tuple[int, int, bool]]:
        """(number of the item, windows found, whether the whole item stands there word for word)."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        copied: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        forms = t.forms()
        for width, table in self.by_width.items():
            own = windows(forms, width)
            for number, ours, at in table.matches(own):
                found[number] = ours, at
            if width == WINDOW and self.runs:
                for number, ours, at in self.runs.matches(windows(own[3], RUN_WINDOWS, WINDOW - 1)):
                    copied[number] = ours, at
        out, joined = [], None
        for number in sorted(found.keys() | copied.keys()):
            item, wanted = self.items[number][1], self.wanted[number]
            got = self._placed(item, wanted, t, *found[number]) if number in found else None
            if number in copied and (got is None or got < (wanted, True)):
                run = self._copied(number, *copied[number])
                got = run if got is None else max(got, run)
            if got is None and number in found and wanted > 1:
                joined = joined or t.joined()
                own, good, table = self._joined(number)
                if table and (len(joined.raw) < len(t.raw) or len(own.raw) < len(item.raw)):
                    for _, ours, at in table.matches(windows(joined.forms(), min(WINDOW, len(own.codes)))):
                        got = self._placed(own, int(good.sum()), joined, ours, at)
            if got:
                shifts = np.concatenate([x[number][0] - x[number][1] for x in (found, copied) if number in x])
                out.append((number, min(got[0], wanted), any(np.array_equal(t.raw[s : s + len(item.raw)], item.raw) for s in np.unique(shifts[shifts >= 0]).tolist())))
        return out

    def _copied(self, number: int, ours: np.ndarray, at: np.ndarray) -> tuple[int, bool]:
        """The windows of an item that lie in runs of its raw tokens at one place of a document."""
        good, most = self.good[number], 0
        shift = ours - at
        for one in np.unique(shift).tolist():
            inside = np.zeros(len(good) + 1, dtype=int)
            begin = at[shift == one]
            np.add.at(inside, begin, 1)
            np.add.at(inside, begin + RUN - WINDOW + 1, -1)
            most = max(most, int((good & (np.cumsum(inside[:-1]) > 0)).sum()))
        return most, True

    def _placed(self, item: Template, wanted: int, t: Template, ours: np.ndarray, at: np.ndarray) -> tuple[int, bool] | None:
        """The best place of an item in a document that holds enough windows and whose slots agree."""
        width = min(WINDOW, len(item.codes))
        least = max(1, int(np.ceil(CONTAINMENT * wanted)))
        if len(np.unique(at)) < least:
            return None
        shift = ours - at
        order = np.lexsort((ours, shift))
        ours, at, shift = ours[order], at[order], shift[order]
        # each shift by itself, the fullest first and exact ones before others
        starts = np.flatnonzero(np.diff(shift, prepend=shift[0] - 1))
        counts = np.diff(starts, append=len(shift))
        places, theirs = at[:, None] + np.arange(width), ours[:, None] + np.arange(width)
        equal = (item.raw[places] == t.raw[theirs]).all(axis=1)
        best = None
        for k in np.lexsort((~np.logical_and.reduceat(equal, starts), -counts)).tolist():
            if counts[k] < least or (best and best[0] >= counts[k]):
                break
            part = slice(starts[k], starts[k] + counts[k])
            got = self._agreeing(item, t, ours[part], at[part], width)
            if got and got[0] >= least and (best is None or got > best):
                best = got
        # places with a few tokens more or less: runs of shifts, in which each window is used once
        cuts = np.flatnonzero(np.diff(shift) > MOST_INSERTED) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shift)], strict=True):
            if shift[a] == shift[b - 1] or len(np.unique(at[a:b])) < max(least, best[0] + 1 if best else 0):
                continue
            for chain in _chains(ours[a:b], at[a:b]):
                if len(chain) < least or (best and best >= (len(chain), True)):
                    break
                got = self._agreeing(item, t, ours[a:b][chain], at[a:b][chain], width)
                if got and got[0] >= least and (best is None or got > best):
                    best = got
        return best

    @staticmethod
    def _agreeing(item: Template, t: Template, ours: np.ndarray, at: np.ndarray, width: int) -> tuple[int, bool] | None:
        """How many windows of an alignment agree and whether all their values are equal; None if a value stands for two.

        Windows that are the same only with first words as names or with names literal are left out
        where they don't fit the others.
        """
        steps = np.arange(width)
        a, b = at[:, None] + steps, ours[:, None] + steps
        kinds, x, y = np.where(item.first[a], 3, item.slots[a]), item.raw[a], t.raw[b]
        sure = (item.codes[a] == t.codes[b]).all(axis=1)
        slot = item.slots[a[sure]] > 0
        pairs = set(zip(kinds[sure][slot].tolist(), x[sure][slot].tolist(), y[sure][slot].tolist(), strict=True))
        there, back = {p[:2]: p[2] for p in pairs}, {(p[0], p[2]): p[1] for p in pairs}
        if len(there) < len(pairs) or len(back) < len(pairs):
            return None
        n, same = int(sure.sum()), all(p[1] == p[2] for p in pairs)
        if n == len(sure):
            return n, same
        for word in np.unique(x[sure][item.first[a[sure]]]).tolist():  # first words that stay
            there.setdefault((3, word), word)
            back.setdefault((3, word), word)
        for i in np.flatnonzero(~sure).tolist():
            slot = kinds[i] > 0
            pairs = set(zip(kinds[i][slot].tolist(), x[i][slot].tolist(), y[i][slot].tolist(), strict=True))
            new, new_back = {p[:2]: p[2] for p in pairs}, {(p[0], p[2]): p[1] for p in pairs}
            if len(new) == len(new_back) == len(pairs) and all(there.get(k, v) == v for k, v in new.items()) and all(back.get(k, v) == v for k, v in new_back.items()):
                there |= new
                back |= new_back
                n += 1
                same = same and all(p[1] == p[2] for p in pairs)
        return n, same


def _chains(ours: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Alignments of an item with a document, the best first: matches that advance in both, with few changes of shift."""
    ends: dict[int, tuple[float, int]] = {}  # shift -> the best chain that ends there: its score and last match
    before = [-1] * len(ours)
    waiting: list[tuple[int, float, int]] = []
    us, them = ours.tolist(), at.tolist()
    last = None
    for j in np.lexsort((at, ours)).tolist():
        if us[j] != last:
            for shift, score, i in waiting:
                ends[shift] = (score, i)
            waiting.clear()
            last = us[j]
        shift, most, prior = us[j] - them[j], 1.0, -1
        for change in range(-MOST_INSERTED, MOST_INSERTED + 1):
            end = ends.get(shift + change)
            if end and them[end[1]] < them[j] and (score := end[0] + (0.5 if change else 1.0)) > most:
                most, prior = score, end[1]
        before[j] = prior
        waiting.append((shift, most, j))
    for shift, score, i in waiting:
        ends[shift] = (score, i)
    out = []
    for _, j in sorted(ends.values(), reverse=True):
        chain = []
        while j >= 0:
            chain.append(j)
            j = before[j]
        out.append(chain[::-1])
    return sorted(out, key=len, reverse=True)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark in blocks of about ``block_bytes`` of text, each small enough to broadcast, and whether there is one only."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()], n == 1


_INDEXES: dict[bytes, tuple[Index, _Vocabulary]] = {}


def _worker_index(items: list[tuple]) -> tuple[Index, _Vocabulary]:
    key = hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).digest()
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = (Index(items), _Vocabulary())
    return _INDEXES[key]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it holds: both ids, ``windows`` found, ``of_windows``, ``exact``.

    Whole texts are scanned without a shuffle, once for each block of the benchmark; one block is broadcast at a time. Null and empty
    texts and items hold and are held by nothing. An item shorter than a window is one window; one without
    a window of three literal tokens is looked for word for word. ``windows`` counts those found with
    half of the item's, or those inside 13 or more of its raw tokens in a row. ``exact`` says whether all of
    the item's tokens stand there in a row, in either case. Names of another number of words are seen through
    if at least one window of the item is found besides. Repeated documents and
    items each give rows. Empty tables give none. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = source.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for items, only in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, vocabulary = _worker_index(shared.value)
            for batch in batches:
                at, rest = [], ([], [], [], [])
                for i, text in enumerate(batch.column(1)):
                    for number, n, same in index.matches(template(text.as_py() or "", vocabulary)):
                        at.append(i)
                        for column, value in zip(rest, (index.items[number][0], n, index.wanted[number], same), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rest[0], _arrow(item_kind)), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int64()), pa.array(rest[3], pa.bool_())],
                    names=["id", "item", "windows", "of_windows", "exact"],
                )

        part = source.mapInArrow(run, f"id {id_kind}, item {item_kind}, windows bigint, of_windows bigint, exact boolean")
        if not only:  # one block is broadcast at a time
            part = materialise(part, "matches")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; no shuffle. Of a benchmark in several
    blocks, each reads what the one before it kept."""
    place = docs.columns.index(text_col)
    before = None
    for items, only in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, vocabulary = _worker_index(shared.value)
            for batch in batches:
                keep = [not index.matches(template(x.as_py() or "", vocabulary)) for x in batch.column(place)]
                yield batch.filter(pa.array(keep, pa.bool_()))
            vocabulary.clear()
            trim()

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = materialise(docs, "clean")
            shared.destroy()
            if before is not None:
                release(before)
            before = docs
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
