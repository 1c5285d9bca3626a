"""Language identification of mixed-language text.

Words are scored for each language by smoothed character n-grams and the whole word. The ranges of
the scripts narrow the candidates: a language in whose training text a script is rare isn't a
candidate for a word of that script. Viterbi's algorithm over the words, with a penalty for each
switch, then labels spans of one language. A text's language is that of most letters, unless it both
begins and ends in another one: a quotation stands inside the text that quotes it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import trim

UNKNOWN = "und"
#: First and last code points of scripts' letter ranges, and the script's name (fixed values).
SCRIPT_RANGES = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0700, 0x074F, "syriac"), (0x0750, 0x077F, "arabic"), (0x0780, 0x07BF, "thaana"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B00, 0x0B7F, "oriya"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"),
    (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1800, 0x18AF, "mongolian"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x2C60, 0x2C7F, "latin"), (0x2DE0, 0x2DFF, "cyrillic"), (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"),
    (0x3130, 0x318F, "hangul"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xA640, 0xA69F, "cyrillic"), (0xAC00, 0xD7AF, "hangul"),
    (0xF900, 0xFAFF, "han"), (0x20000, 0x3FFFF, "han"),
)
SCRIPTS = ("other", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES))
#: Slots of the hashed feature table; with the languages' number they bound the model's size.
SLOTS = 1 << 16
#: Least share of letters of a language that a text begins and ends in, to be the text's.
FRAME_SHARE = 0.2
#: Code points handled at a time (a longer text is handled alone and whole).
CHUNK = 1_200_000

_LETTER: np.ndarray | None = None
_SCRIPT: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its script."""
    global _LETTER, _SCRIPT
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
        _SCRIPT = np.zeros(0x110000, dtype=np.uint8)
        for first, last, name in SCRIPT_RANGES:
            _SCRIPT[first : last + 1] = SCRIPTS.index(name)
    return _LETTER, _SCRIPT


@dataclass
class Words:
    """The words (runs of letters) of some texts."""

    first: np.ndarray  # of each word, in code points of the joined texts
    last: np.ndarray  # one past its end
    doc: np.ndarray
    script: np.ndarray  # of its first letter
    slots: np.ndarray  # per feature kind and code point; SLOTS where there is none
    whole: np.ndarray  # per word


def words_of(texts: list[str]) -> Words:
    """The words and hashed features of texts that are lower case already."""
    letter, script = _tables()
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[points]
    code = np.where(is_letter, points, 32).astype(np.uint32)
    before = np.empty_like(is_letter)
    before[:1] = False
    before[1:] = is_letter[:-1]
    first = np.flatnonzero(is_letter & ~before)
    after = np.empty_like(is_letter)
    after[-1:] = False
    after[:-1] = is_letter[1:]
    last = np.flatnonzero(is_letter & ~after) + 1
    left = np.concatenate([code[:1] * 0 + 32, code[:-1]])
    right = np.concatenate([code[1:], code[:1] * 0 + 32])
    del before, after
    a, b, c = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)

    def slot(h):
        h ^= h >> np.uint32(15)
        h *= b
        return np.where(is_letter, (h >> np.uint32(16)) & np.uint32(SLOTS - 1), np.uint32(SLOTS))

    slots = np.stack([slot(code * a + right * b + np.uint32(1)), slot(left * a + code * b + right * c + np.uint32(7))])
    if len(first):
        heads = np.concatenate([[0], first]).astype(np.uint32)
        place = np.arange(len(code), dtype=np.uint32) - np.repeat(heads, np.diff(np.concatenate([[0], first, [len(code)]])))
        mixed = np.where(is_letter, (code + np.uint32(1)) * ((place * a + np.uint32(0x9E3779B9)) | np.uint32(1)), np.uint32(0))
        whole = np.add.reduceat(mixed, first, dtype=np.uint32)
        whole = (whole ^ (whole >> np.uint32(13))) * c
        whole = (whole >> np.uint32(16)) & np.uint32(SLOTS - 1)
    else:
        whole = np.zeros(0, dtype=np.uint32)
    del code, left, right
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Words(first, last, np.searchsorted(ends, first, side="right"), script[points[first]], slots, whole)


@dataclass
class Model:
    """Log-probabilities of the features in each language, and which scripts each language uses."""

    languages: list[str]
    grams: np.ndarray  # kind, slot (with one more for none), language
    whole: np.ndarray  # slot, language
    scripts: np.ndarray  # script, language

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, dtype=object).astype(str), grams=self.grams, whole=self.whole, scripts=self.scripts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return cls([str(s) for s in x["languages"]], x["grams"], x["whole"], x["scripts"])

    def scores(self, words: Words) -> np.ndarray:
        """Each word's score in each language; far down where the script rules a language out."""
        k = len(self.languages)
        if not len(words.first):
            return np.zeros((0, k), dtype=np.float32)
        out = self.whole[words.whole]
        for kind in range(2):
            for language in range(k):  # one column at a time keeps the gathered rows small
                out[:, language] += np.add.reduceat(self.grams[kind, :, language][words.slots[kind]], words.first)
        return out + np.where(self.scripts[words.script], np.float32(0), np.float32(-1e6))


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """The best label of each word, all texts at once: step t handles the t-th word of every text that has one."""
    n, k = scores.shape
    counts = np.bincount(doc, minlength=n_docs)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    start, sizes = start[order], counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    came = np.empty((n, k), dtype=np.int16)
    best = np.zeros((n_docs, k), dtype=np.float64)
    own = np.arange(k, dtype=np.int16)
    for t in range(longest):
        m = active[t]
        rows = start[:m] + t
        now = best[:m]
        top = now.argmax(axis=1)
        switched = (now[np.arange(m), top] - penalty)[:, None]
        switch = switched > now if t else np.zeros((m, k), dtype=bool)
        came[rows] = np.where(switch, top[:, None].astype(np.int16), own)
        best[:m] = np.where(switch, switched, now) + scores[rows]
    label = np.zeros(n, dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        rows = start[:m] + t
        label[rows] = state[:m]
        state[:m] = came[rows, state[:m]]
    return label


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def lowered(column: pa.Array) -> list[str]:
    return pc.utf8_lower(pc.fill_null(column, "")).to_pylist()


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, to bound what is held beside it."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def training_rows(docs: DataFrame, condition: Column, lang: str, id_col: str, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of the id: the bounded training sample."""
    labelled = docs.where(condition & F.col(lang).isNotNull())
    have = labelled.groupBy(lang).agg(F.count("*").alias("have"))
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # `have` has a row for each language: as bounded as the set of languages
    return labelled.join(F.broadcast(have), lang).where(share < F.lit(float(per_language)) / F.col("have")).drop("have")


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, script_share: float = 0.01) -> Model:
    """Count features in the whole texts of labelled rows and fit the model.

    Counting is distributed; what reaches the driver is a table of at most (languages x 3 x SLOTS)
    counts, which doesn't depend on the number of rows. Rows without text or language add nothing.
    """
    source = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), lowered(batch.column(1))
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                table = tables.setdefault(lang, np.zeros((4, SLOTS + 1), dtype=np.int64))
                for a, b in chunks(own):
                    w = words_of(own[a:b])
                    for kind in range(2):
                        table[kind] += np.bincount(w.slots[kind], minlength=SLOTS + 1)
                    table[2] += np.bincount(w.whole, minlength=SLOTS + 1)
                    np.add.at(table[3], w.script, w.last - w.first)
        for lang, table in tables.items():
            table[:2, SLOTS] = 0
            kind, slot = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(kind)), pa.array(kind.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(table[kind, slot])], names=["lang", "kind", "slot", "n"]
            )

    counted = source.mapInArrow(count, "lang string, kind int, slot int, n bigint").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique().tolist())
    k = len(languages)
    table = np.zeros((4, SLOTS + 1, k))
    table[counted["kind"], counted["slot"], counted["lang"].map(languages.index)] = counted["n"] if k else 0

    def logs(t: np.ndarray) -> np.ndarray:
        return np.log((t + smoothing) / (t.sum(axis=0, keepdims=True) + smoothing * SLOTS)).astype(np.float32)

    grams = np.stack([logs(table[0]), logs(table[1])])
    grams -= grams.mean(axis=2, keepdims=True) if k else 0
    grams[:, SLOTS] = 0
    whole = logs(table[2][:SLOTS])
    whole -= whole.mean(axis=1, keepdims=True) if k else 0
    used = table[3][: len(SCRIPTS)]
    scripts = used >= script_share * np.maximum(used.sum(axis=0, keepdims=True), 1)
    scripts[~scripts.any(axis=1)] = True  # a script that no language uses narrows nothing
    return Model(languages, grams, whole, scripts)


def spans_of(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: its language, the share of letters in it, and its spans in code points."""
    if not model.languages:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    out = []
    for a, b in chunks(texts):
        w = words_of(texts[a:b])
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        label = viterbi(model.scores(w), w.doc, b - a, penalty)
        letters = np.zeros((b - a, len(model.languages)))
        np.add.at(letters, (w.doc, label), w.last - w.first)
        new = np.ones(len(label), dtype=bool)
        new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(label)]]) - 1 if len(heads) else heads
        spans: list[list] = [[] for _ in range(b - a)]
        for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
            d = int(w.doc[h])
            spans[d].append((int(w.first[h] - base[d]), int(w.last[t] - base[d]), model.languages[label[h]]))
        total = letters.sum(axis=1)
        for d in range(b - a):
            if total[d]:
                top = int(letters[d].argmax())
                frame = model.languages.index(spans[d][0][2])
                if spans[d][0][2] == spans[d][-1][2] and letters[d, frame] >= FRAME_SHARE * total[d]:
                    top = frame
                out.append((model.languages[top], float(letters[d, top] / total[d]), spans[d]))
            else:
                out.append((UNKNOWN, 0.0, []))
    return out


def identify(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """The columns ``id_cols`` of each row with ``lang_pred``, ``score`` and ``spans``.

    ``score`` is the share of the text's letters in spans of ``lang_pred``; spans are in code points
    of the lower-cased text. A map without a shuffle over whole texts; the model's size depends on
    the languages only. Null texts and texts without a letter give ``und``, 0 and no spans, as does a
    model that was trained on no rows. Repeated rows each give a row; an empty table gives none. Ties
    go to the language whose name sorts first. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    ids = [F.col(c).alias(f"_{i}") for i, c in enumerate(id_cols)]
    source = docs.select(*ids, F.col(text_col).alias("text"))
    kinds = ", ".join(f"_{i} {source.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(id_cols)))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(shared.value)
        for whole in batches:
            for batch in _parts(whole):
                got = spans_of(lowered(batch.column(len(id_cols))), own, penalty)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(id_cols))]
                    + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                    + [pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in g[2]] for g in got], span)],
                    names=[f"_{i}" for i in range(len(id_cols))] + ["lang_pred", "score", "spans"],
                )
        trim()

    found = source.mapInArrow(run, f"{kinds}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
    return found.withColumnsRenamed({f"_{i}": c for i, c in enumerate(id_cols)})


def identified(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """The rows of ``docs`` whose language the model can tell, with all their columns; no shuffle.

    Rejected are null texts and texts without a letter.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model.to_bytes()), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(shared.value)
        for whole in batches:
            for batch in _parts(whole):
                got = spans_of(lowered(batch.column(place)), own, penalty)
                yield batch.filter(pa.array([g[0] != UNKNOWN for g in got], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model never learns from: a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


#: Rows of each language that the registered queries train on.
TRAINING_ROWS = 600


def trained(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = TRAINING_ROWS) -> Model:
    """The model of the registered queries: it learns from a bounded sample of the rows that aren't held out."""
    return train(training_rows(docs.select(id_col, lang_col, text_col), ~held_out(id_col), lang_col, id_col, per_language), text_col, lang_col)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, trained(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
