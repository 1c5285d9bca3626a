"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end the BPE encoding of that
prefix. Storing this *last token* for each prefix gives the encoding of the whole piece by walking
back, allows exact appends (only new prefixes are computed) and lets an edit in the middle be
re-encoded from the edit on, stopping where the stored table agrees again.

A token may follow another if merging their concatenation never joins bytes across the boundary.
The boundary between ``a`` and ``b`` is looked at over the life of the right-hand parts of ``a``
and the left-hand parts of ``b``: merges happen in the order of rank, so a part lives from its own
rank to the rank of the part that swallows it. A crossing merge wins if it ranks below both.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import trim

_NEVER = 1 << 60
#: Lengths of the beginnings of pieces whose tables are remembered.
BEGINNINGS = (4, 7)


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    out = {}
    for line in lines:
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class PrefixCoder:
    """Encodes pieces of bytes with a rank table; see the module's text for the method."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._spines: dict[int, tuple[list, list]] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, dict[int, bool]] = {}  # right token -> left token
        self._known = 0
        self._good: set[int] = set()  # tokens known to be reachable
        self._begun: dict[bytes, tuple[int, ...]] = {}  # the tables of short beginnings, which many pieces share
        # the tokens' bytes from the last to the first as a tree: node << 8 | byte -> node, and the token of each node
        self._nodes, self._ends = {}, [-1]
        for token, rank in ranks.items():
            node = 0
            for key in reversed(token):
                key |= node << 8
                node = self._nodes.get(key)
                if node is None:
                    node = self._nodes[key] = len(self._ends)
                    self._ends.append(-1)
            self._ends[node] = rank

    # -- how a token came to be -------------------------------------------------------------
    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or an unreachable token."""
        if token in self._parts:
            return self._parts[token]
        self._parts[token] = None
        text, found = self.tokens[token], None
        if len(text) > 1:
            table = self._merge(text)
            if len(table) == 2:
                found = (table[0], table[1])
        self._parts[token] = found
        return found

    def _merge(self, text: bytes) -> list[int]:
        """Plain merging of one token's bytes, stopped before the merge that would complete it."""
        piece = [text[i : i + 1] for i in range(len(text))]
        while len(piece) > 2:
            best = min(((self.ranks.get(piece[i] + piece[i + 1], _NEVER), i) for i in range(len(piece) - 1)))
            if best[0] == _NEVER:
                break
            i = best[1]
            piece[i : i + 2] = [piece[i] + piece[i + 1]]
        return [self.ranks[p] for p in piece]

    def spines(self, token: int) -> tuple[list, list]:
        """The parts at the left and right edge of a token: (token, swallowed at rank), outermost first."""
        got = self._spines.get(token)
        if got is None:
            sides = []
            for side in (0, 1):
                spine, now, end = [], token, _NEVER
                while True:
                    spine.append((now, end))
                    two = self.parts(now)
                    if two is None:
                        break
                    now, end = two[side], now
                sides.append(spine)
            got = self._spines[token] = (sides[0], sides[1])
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is what encoding their bytes gives."""
        own = self._fits.get(right)
        known = own.get(left) if own is not None else None
        if known is None:
            known = self._separate(self.spines(left)[1], self.spines(right)[0])
            if self._known >= 400_000:
                self._fits.clear()
                self._known = 0
            self._fits.setdefault(right, {})[left] = known
            self._known += 1
        return known

    def forget(self) -> None:
        """Free what has been remembered of tokens and beginnings."""
        self._fits.clear()
        self._known = 0
        self._spines.clear()
        self._begun.clear()

    def _separate(self, lefts: list, rights: list) -> bool:
        tokens, ranks = self.tokens, self.ranks
        for a, a_end in lefts:
            for b, b_end in rights:
                if b_end <= a or a_end <= b:  # these two parts are never there at the same time
                    continue
                joined = ranks.get(tokens[a] + tokens[b])
                if joined is not None and joined < a_end and joined <= b_end:
                    return False
        return True

    def reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes gives that token."""
        reached = len(self.tokens[token]) == 1 or self.parts(token) is not None
        if reached:
            self._good.add(token)
        return reached

    # -- the table --------------------------------------------------------------------------
    def extend(self, text: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Complete ``last`` (the last token of each prefix of ``text``, from length 1) in place."""
        nodes, ends, known, good = self._nodes.get, self._ends, self._fits.get, self._good
        for end in range(len(last), len(text) if upto is None else upto):
            node, start = 0, end
            while start >= 0:
                node = nodes(node << 8 | text[start])
                if node is None:  # no token ends in this part
                    break
                token = ends[node]
                if token >= 0:
                    fit = True
                    if start:
                        left = last[start - 1]
                        own = known(token)
                        fit = own.get(left) if own is not None else None
                        if fit is None:
                            fit = self.fits(left, token)
                    if fit and (token in good or self.reachable(token)):
                        last.append(token)
                        break
                start -= 1
            if len(last) <= end:
                raise ValueError("the vocabulary lacks a byte or isn't closed under merging")
        return last

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The tokens of the prefix of length ``end``."""
        out, end = [], len(last) if end is None else end
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a piece that is itself in the vocabulary is that token."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend(piece, self._beginning(piece)))

    def _beginning(self, piece: bytes) -> list[int]:
        """The table of the longest of a piece's short beginnings, remembered from other pieces: theirs are extended, as in an append."""
        last, begun = [], self._begun
        for n in reversed(BEGINNINGS):
            if n < len(piece) and (got := begun.get(piece[:n])) is not None:
                last = list(got)
                break
        for n in BEGINNINGS:
            if len(last) < n < len(piece):
                if len(begun) >= 200_000:
                    begun.clear()
                begun[piece[:n]] = tuple(self.extend(piece, last, n))
        return last

    def append(self, text: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The text and table after an exact append: only the new prefixes are computed."""
        text += more
        return text, self.extend(text, last)

    def edit(self, text: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The text and table after replacing ``text[start:stop]``.

        Prefixes before ``start`` keep their entries. Behind the edit, once a whole token length of
        consecutive entries agrees with the old table, all later entries agree as well and are kept.
        """
        changed, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
        table, same, at = last[:start], 0, start
        while at < len(changed):
            self.extend(changed, table, at + 1)
            old = at - shift
            same = same + 1 if at >= start + len(new) and 0 <= old < len(last) and table[at] == last[old] and old >= stop else 0
            at += 1
            if same >= self.longest:
                table += last[at - shift :]
                break
        return changed, table

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers.

    When it grows too large the older half of its life is forgotten: pieces are looked for among
    those of the last generation before they are encoded again.
    """

    def __init__(self, coder: PrefixCoder, most: int):
        super().__init__()
        self.coder, self.most, self.older = coder, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.coder.encode(piece.encode("utf-8", "surrogatepass"))
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    """Splits texts by a pattern and encodes each match on its own, as the tiktoken library does."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached_pieces: int = 500_000):
        self.coder = PrefixCoder(ranks)
        self.find = regex.compile(pattern).findall
        self.cache = _Pieces(self.coder, cached_pieces)
        size = max(self.coder.tokens, default=-1) + 1
        self.table = np.empty(size, dtype=object)
        self.table[:] = [self.coder.tokens.get(i, b"") for i in range(size)]

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def forget(self) -> None:
        """Free the caches at the end of a task: a worker that waits for other work shouldn't hold them."""
        self.cache.clear()
        self.cache.older = {}
        self.coder.forget()
        trim()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.table[np.frombuffer(ids, dtype="<u4")].tolist())


_CODECS: dict[tuple, Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """A worker's codec for a vocabulary; built once for each worker process."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(load_ranks(vocabulary.splitlines()), pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, digests and, if asked for, the ids.

    A map without a shuffle. The vocabulary (1 MB or so; its size doesn't depend on the data) goes
    to the workers as a broadcast. Null and empty texts have no tokens; repeated rows each give a
    row; an empty table gives none; other columns are ignored. A text is encoded whole; memory is
    bounded by the largest text and the piece cache.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digest, back, all_ids = [], [], [], []
                for text in part.column(1):
                    ids = own.encode_bytes(text.as_py() or "")
                    n.append(len(ids) // 4)
                    digest.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        own.forget()

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of little-endian 32-bit ids stands for; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.udf("binary", useArrow=True)
    def back(x):
        return None if x is None else codec(shared.value, r"\X").decode(bytes(x))

    return encoded.withColumn(out, back(F.col(ids)))


def read_vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode(docs, vocabulary, public_tokenizers.PATTERN, with_ids=False)
