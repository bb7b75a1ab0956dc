"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For a list of ranked tokens, every byte string has exactly one encoding, and every prefix of
it has exactly one valid last token: the token that ends there and may follow the last token
of the prefix before it. Storing that one token per prefix is enough to encode (walk back from
the end), to append exactly (earlier entries never change) and to encode again near an edit
(entries after it change only until they agree with the old ones for a whole token length).
Entries of different strings do not depend on each other, so many strings are worked out together,
one position after the other.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postloom.session import small_batches

# The pattern that cuts a text into the pieces that are encoded one by one: a fixed value that
# belongs to the rank file.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
# Two workers of an executor keep these caches, so they are bounded. A dict doubles at 174,763 and 349,526 entries: they end below that.
CACHED_PIECES = 170_000  # and at most as many older ones
CACHED_PAIRS = 340_000
CACHED_PREFIXES = 300_000
CACHED_PIECE_BYTES = 64
STEP_SLOTS, PAIR_SLOTS = 1 << 18, 1 << 20
ROWS_AT_ONCE = 500  # texts of a batch whose ids are held at the same time


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 token and rank."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Ranked tokens. Every single byte must be a token, and every token its own encoding."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.size = len(tokens)
        self._fits: dict[int, bool] = {}
        self._prefixes: dict[bytes, int] = {}
        self._left: dict[int, list[tuple[bytes, int]]] = {}
        self._right: dict[int, list[tuple[bytes, int]]] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes ``token``: join the neighbours of lowest rank, the
        leftmost first, until two are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, self.size) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at one end of ``token`` while it is put together, with the rank at which
        the next larger part replaces it; the whole token is never replaced."""
        spines = self._right if right else self._left
        if token not in spines:
            at, until, found = self.tokens[token], self.size, []
            while True:
                found.append((at, until))
                if len(at) == 1:
                    break
                at, until = self.parts(at)[right], self.rank[at]
            spines[token] = found
        return spines[token]

    def may_follow(self, left: int, right: int) -> bool:
        """:meth:`fits`, remembered."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= CACHED_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.fits(left, right)
        return known

    def fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``? Not if some merge over their border comes before the
        merges that use up its two sides. Of merges of equal rank the leftmost comes first."""
        rank, none = self.rank, self.size
        for a, a_until in self.edge(left, True):
            for b, b_until in self.edge(right, False):
                over = rank.get(a + b, none)
                if over < a_until and over <= b_until and over < none:
                    return False
        return True

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The valid last token of ``data[:end]``, given those of all shorter prefixes:
        ``last[i]`` belongs to the prefix of ``i`` bytes."""
        for begin in range(max(0, end - self.longest), end):
            token = self.rank.get(data[begin:end])
            if token is not None and (not begin or self.may_follow(last[begin], token)):
                return token
        raise ValueError(f"byte {data[end - 1]} is not a token")

    def encode(self, data: bytes) -> list[int]:
        """Ids of ``data``. Entries are kept for prefixes and shared by all strings that start
        alike, so a string costs only what follows its longest known prefix."""
        find, fit, known = self.rank.get, self._fits.get, self._prefixes
        if len(known) >= CACHED_PREFIXES:
            known.clear()
        size = at = len(data)
        while at and data[:at] not in known:
            at -= 1
        for end in range(at + 1, size + 1):
            for begin in range(max(0, end - self.longest), end):
                token = find(data[begin:end])
                if token is None:
                    continue
                if not begin:
                    break
                before = known[data[:begin]]
                fits = fit(before << 32 | token)
                if self.may_follow(before, token) if fits is None else fits:
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not a token")
            known[data[:end]] = token
        ids, at = [], size
        while at:
            ids.append(token := known[data[:at]])
            at -= len(self.tokens[token])
        return ids[::-1]

    def walk_back(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class EditableEncoding:
    """The encoding of a byte string that is appended to and edited.

    ``computed`` counts prefix entries worked out so far, to show how local the work is.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = [-1]
        self.computed = 0
        self.append(data)

    def append(self, data: bytes) -> None:
        """Earlier entries hold for every longer string, so only the new bytes are worked out."""
        start, self.data = len(self.data), self.data + data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last))
            self.computed += 1

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in the place of bytes ``start`` to ``end``.

        An entry depends on at most ``longest`` bytes and entries before it. Once that many
        consecutive entries after the edit equal the old ones, all later ones do.
        """
        old_last, old_tail = self.last, len(self.data) - end
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old_last[: start + 1]
        shift = start + len(data) - end
        agreed, longest = 0, self.vocabulary.longest
        for at in range(start + 1, len(self.data) + 1):
            if agreed >= longest:
                self.last.extend(old_last[at - shift :])
                break
            token = self.vocabulary.last_token(self.data, at, self.last)
            self.computed += 1
            self.last.append(token)
            past = at > len(self.data) - old_tail
            agreed = agreed + 1 if past and old_last[at - shift] == token else 0

    def ids(self) -> list[int]:
        return self.vocabulary.walk_back(self.last)


class Remembered:
    """Values of whole numbers below ``2 ** (63 - bits)``, themselves below ``2 ** bits``. A newer one takes the place of
    an older one in the same slot, so that the size is fixed."""

    def __init__(self, slots: int, bits: int, work_out: Callable[[int], int]):
        self.bits, self.work_out = bits, work_out
        self.shift = np.uint64(64 - (slots - 1).bit_length())
        self.held = np.full(slots, -1, np.int64)  # number and value

    def of(self, numbers: np.ndarray) -> np.ndarray:
        slots = (numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        held = self.held[slots]
        new = np.flatnonzero(held >> self.bits != numbers)
        if len(new):
            distinct, which = np.unique(numbers[new], return_inverse=True)
            values = np.array([self.work_out(n) for n in distinct.tolist()], np.int64)
            held[new] = (distinct << self.bits | values)[which]
            self.held[slots[new]] = held[new]
        return held & ((1 << self.bits) - 1)


class ManyStrings:
    """Encodes many byte strings at once: the entries of all their prefixes of one byte, then of two, and so on.

    A state stands for the longest end of the bytes so far that begins a token, 0 for none. It leads to the tokens that
    end there, the longest first: ``own`` is the token that a state spells, ``ending`` the state itself or the next
    shorter end that spells one, and ``after`` the next shorter end again.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lengths = np.array([len(token) for token in vocabulary.tokens], np.int32)
        self.longer: dict[int, int] = {}  # the state of a longer string, by state << 8 | byte
        own, levels = [-1], [[] for _ in range(vocabulary.longest)]
        for token, data in enumerate(vocabulary.tokens):
            state = 0
            for depth, byte in enumerate(data):
                key = state << 8 | byte
                state = self.longer.get(key, 0)
                if not state:
                    state = self.longer[key] = len(own)
                    own.append(-1)
                    levels[depth].append(key)
            if state:
                own[state] = token
        self.shorter, ending, after = [0] * len(own), [0] * len(own), [0] * len(own)
        for key in chain.from_iterable(levels):
            state, above = self.longer[key], key >> 8
            if above:
                self.shorter[state] = self.step(self.shorter[above] << 8 | key & 255)
            after[state] = ending[self.shorter[state]]
            ending[state] = state if own[state] >= 0 else after[state]
        self.own, self.ending, self.after = (np.array(x, np.int32) for x in (own, ending, after))
        self.steps = Remembered(STEP_SLOTS, len(own).bit_length(), self.step)
        self.pairs = Remembered(PAIR_SLOTS, 1, lambda pair: vocabulary.fits(*divmod(pair, vocabulary.size)))

    def step(self, key: int) -> int:
        """The state after a state and a byte."""
        state, byte = key >> 8, key & 255
        while not (found := self.longer.get(state << 8 | byte)):
            if not state:
                raise ValueError(f"byte {byte} is not a token")
            state = self.shorter[state]
        return found

    def entries(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of each prefix, by its size and string. The longest strings come first."""
        last = np.full((sizes[0] + 1, len(sizes)), -1, np.int32)
        state = np.zeros(len(sizes), np.int64)
        for end in range(1, len(last)):
            there = np.searchsorted(-sizes, -end, side="right")
            state = self.steps.of(state[:there] << 8 | data[starts[:there] + (end - 1)])
            string, at = np.arange(there), self.ending[state]
            while len(string):
                token = self.own[at]
                if token.min() < 0:
                    raise ValueError("a byte is not a token")
                length = self.lengths[token]
                valid = length == end
                ask = np.flatnonzero(~valid)
                before = last[end - length[ask], string[ask]].astype(np.int64)
                valid[ask] = self.pairs.of(before * self.vocabulary.size + token[ask])
                last[end, string[valid]] = token[valid]
                string, at = string[~valid], self.after[at[~valid]]
        return last

    def encode(self, strings: list[bytes]) -> list[bytes]:
        """Ids of each of ``strings`` as packed 32-bit numbers."""
        if not strings:
            return []
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        at = sizes[order]
        last = self.entries(np.frombuffer(b"".join(strings), np.uint8), starts[order], at)
        counts, backwards, string = np.zeros(len(strings), np.int64), [], np.arange(len(strings))
        while True:
            string, at = string[at > 0], at[at > 0]
            if not len(string):
                break
            token = last[at, string]
            backwards.append((order[string], token))
            counts[order[string]] += 1
            at = at - self.lengths[token]
        ends = np.cumsum(counts)
        packed = np.empty(ends[-1], "<i4")
        for i, (string, token) in enumerate(backwards, 1):
            packed[ends[string] - i] = token
        whole, cuts = packed.tobytes(), [0, *(4 * ends).tolist()]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class PieceCache(dict):
    """Pieces and their ids as packed 32-bit numbers. When it is full, its pieces become the older ones, and
    those that were not asked for since they became that are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        self.many: ManyStrings | None = None

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.pop(piece, None)
        if packed is None:
            packed = self.encode(piece)
        self.keep(piece, packed)
        return packed

    def keep(self, piece: str, packed: bytes) -> None:
        if len(piece) > CACHED_PIECE_BYTES:
            return
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = packed

    def all(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Distinct pieces and their ids; those not kept are encoded together."""
        found, new = {}, []
        for piece in pieces:
            packed = self.get(piece)
            if packed is None:
                packed = self.older.pop(piece, None)
                if packed is None:
                    new.append(piece)
                    continue
                self.keep(piece, packed)
            found[piece] = packed
        short, strings = [], []
        for piece in new:
            data = piece.encode("utf-8", "surrogatepass")
            if len(data) > CACHED_PIECE_BYTES:
                found[piece] = self[piece]
            else:
                short.append(piece)
                strings.append(data)
        if self.many is None:
            self.many = ManyStrings(self.vocabulary)
        for piece, packed in zip(short, self.many.encode(strings), strict=True):
            found[piece] = packed
            self.keep(piece, packed)
        return found

    def encode(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) > CACHED_PIECE_BYTES:  # prefixes of a long piece would cost its length squared
            return np.array(EditableEncoding(self.vocabulary, data).ids(), dtype="<i4").tobytes()
        return np.array(self.vocabulary.encode(data), dtype="<i4").tobytes()


_kept: dict[int, PieceCache] = {}


def _cache(content: bytes) -> PieceCache:
    """One cache per worker process and vocabulary."""
    key = hash(content)
    if key not in _kept:
        _kept.clear()
        _kept[key] = PieceCache(Vocabulary(read_ranks(content)))
    return _kept[key]


def forget() -> None:
    """Drop the cache of this worker process, and what Arrow holds unused. Workers outlive their stage, so operators that
    do without an encoder call this first."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def encode_documents(
    documents: DataFrame,
    ranks: bytes,
    pattern: str = PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, ids array<int>, decoded binary)`` for every row of ``documents``.

    ``ranks`` is the content of a rank file (read once on the driver and sent to the tasks: a
    vocabulary has a fixed size). Each match of ``pattern`` is encoded separately; text outside
    matches, if a pattern leaves any, has no tokens. ``decoded`` is what the ids stand for.

    * A null or empty text has no ids and decodes to nothing. Texts of any length are encoded
      whole, piece by piece. Repeated rows and null ids stay as they are. Other columns are
      ignored. An empty table gives an empty result.
    """
    id_type = documents.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("decoded", T.BinaryType()),
        ]
    )
    content = documents.sparkSession.sparkContext.broadcast(ranks)
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(content.value)
        find = regex.compile(pattern).findall
        tokens = cache.vocabulary.tokens
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            packed, offsets, decoded = [], [0], []
            texts = [find(text.as_py() or "") for text in batch.column(1)]
            known = cache.all(set(chain.from_iterable(texts)))
            for pieces in texts:
                own = b"".join([known[p] for p in pieces])
                packed.append(own)
                offsets.append(offsets[-1] + len(own) // 4)
                decoded.append(b"".join([tokens[i] for i in np.frombuffer(own, "<i4").tolist()]))
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(decoded, pa.binary())], names=schema.names
            )

    return documents.select(id_col, text_col).mapInArrow(run, schema)
