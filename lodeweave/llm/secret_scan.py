"""Secret scans: fixed patterns, and strings that a random-string model explains better than an identifier model.

Two character Markov models of order two are trained from labelled samples, one on random strings
(keys, digests, tokens), one on ordinary identifiers and words. A run of key characters whose
log-likelihood ratio passes a threshold is a ``markov`` span.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
# The key words match in either case of A-Z only, hence ASCII.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this drops just the shorter ones
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
WORDS = (
    "access account action active address admin after agent allow amount answer application argument array article attribute author average base batch before "
    "between block body boolean branch browser bucket buffer build button cache calendar callback cancel category change channel character chart check child class "
    "clean client close cluster code collection column command comment commit common compare component config connection constant container content context control "
    "convert cookie count country create current customer data database date debug decimal default delete depth description detail device dialog digest directory "
    "disable display document domain download driver duration dynamic element email enable encode endpoint engine entity entry error event example exception export "
    "factory feature field file filter folder format frame function gateway generate global graph group handler header height history host identifier image import "
    "index information initial input insert instance integer interface internal invoice item iterator journal kernel label language layer layout length library "
    "limit listener local location logger machine manager mapping margin match member memory message method metric minimum model module monitor network number "
    "object observer offset operation option order output package page parameter parent parser partition password path pattern payment percent permission pipeline "
    "platform player point policy position prefix previous priority process product profile project property protocol provider public query queue random range "
    "reader record reference region register release remote render report request resource response result return revision router sample schedule schema script "
    "search section security segment select sender sequence server service session setting shipping simple snapshot source status storage stream string structure "
    "style subject summary support system table target task template terminal thread timeout title token total track transaction transfer transform tree trigger "
    "type unique update upload user utility validate value variable vector version view visible volume warning widget width window worker writer"
).split()


def default_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` labelled samples of each kind: 1 for random strings, 0 for ordinary identifiers."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        alphabet = list(ALPHABETS.values())[i % len(ALPHABETS)]
        out.append(("".join(r.choice(alphabet) for _ in range(r.randint(20, 64))), 1))
        words = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        style = i % 12
        if style == 0:
            name = "_".join(words)
        elif style == 1:
            name = "-".join(words)
        elif style == 2:
            name = words[0] + "".join(w.title() for w in words[1:])
        elif style == 3:
            name = "".join(w.title() for w in words)
        elif style == 4:
            name = "_".join(words).upper()
        elif style == 5:
            name = "/".join(words)
        elif style == 6:
            name = "".join(words)
        elif style == 7:
            name = f"{'-'.join(words)}-{r.randint(1, 12)}"
        elif style == 8:  # rules and fill
            name = r.choice("-=_/+.x0") * r.randint(20, 80)
        elif style == 9:  # dates, times and counted numbers
            name = r.choice("-_/").join(f"{r.randint(1990, 2035)}{r.randint(1, 12):02}{r.randint(1, 28):02}" for _ in range(3)) if r.random() < 0.5 else "".join(str(r.randint(0, 9)) for _ in range(r.randint(20, 30)))
        elif style == 10:
            name = "".join(words).upper() if r.random() < 0.5 else words[0].title() + "".join(words[1:])
        else:
            name = r.choice("_-/").join(w.title() for w in words)
        if style < 8 and r.random() < 0.15:
            name += r.choice(("", "_", "-")) + str(r.choice((1, 2, 3, 10, 64, 100, 2020, 2024)))
        out.append((name, 0))
    return out


class Markov:
    """Order-two character model with additive smoothing that backs off to order one and none."""

    def __init__(self, strings: Iterable[str], weight: float = 4.0):
        self.counts: list[dict[str, int]] = [{}, {}, {}]
        self.totals: list[dict[str, int]] = [{}, {}, {}]
        self.weight = weight
        for s in strings:
            for i, c in enumerate(s):
                for order in range(3):
                    if i >= order:
                        past = s[i - order : i]
                        self.counts[order][past + c] = self.counts[order].get(past + c, 0) + 1
                        self.totals[order][past] = self.totals[order].get(past, 0) + 1
        self.log = lru_cache(maxsize=300_000)(self._log)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "log"}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.log = lru_cache(maxsize=300_000)(self._log)

    def _log(self, past: str, c: str) -> float:
        p = 1 / 66  # the alphabet of the runs
        for order in range(len(past) + 1):
            tail = past[len(past) - order :]
            p = (self.counts[order].get(tail + c, 0) + self.weight * p) / (self.totals[order].get(tail, 0) + self.weight)
        return math.log(p)

    def score(self, s: str) -> float:
        return sum(self.log(s[max(0, i - 2) : i], s[i]) for i in range(len(s)))


class Scanner:
    """Both models and the thresholds, in nats for the whole string and for each character.

    Runs of letters alone are words far more often than secrets, so they have to be the likelier by ``least_letters``.
    """

    def __init__(self, samples: list[tuple[str, int]], least: float = 12.0, least_each: float = 0.45, least_letters: float = 1.2):
        self.random = Markov(s for s, label in samples if label)
        self.ordinary = Markov(s for s, label in samples if not label)
        self.least, self.least_each, self.least_letters = least, least_each, least_letters

    def ratio(self, s: str) -> float:
        return self.random.score(s) - self.ordinary.score(s)

    def secret(self, s: str) -> bool:
        ratio = self.ratio(s)
        return ratio >= self.least and ratio >= (self.least_letters if s.isalpha() else self.least_each) * len(s)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end) of the patterns' matches, sorted."""
        found = []
        if ":" in text or "=" in text:
            found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def more(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the models that overlap no span of a pattern (``base``, sorted)."""
        out, at, covered = [], 0, 0
        for m in _RUN.finditer(text):
            start, end = m.span()
            while at < len(base) and base[at][0] < end:  # runs come in order, so each span is looked at once
                covered = max(covered, base[at][2])
                at += 1
            if covered <= start and self.secret(m[0]):
                out.append((start, 3, end))
        return out


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, samples: list[tuple[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 12.0) -> DataFrame:
    """One row per row of ``docs``: id, ``spans`` as array<struct<kind,start,end>> in code points.

    A map without a shuffle over whole texts. The models are trained once, on the driver, and broadcast; their
    size is bounded by the alphabet of the runs (counts of up to three characters), not by the samples. Null and empty texts have no spans; repeated
    rows each give a row; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(samples or default_samples(), least))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = own.base(text)
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + own.more(text, base))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=["id", "spans"])

    return source.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and listings of the spans that ``scan`` gives."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
