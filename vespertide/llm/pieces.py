"""SentencePiece encoding and decoding with offsets into the original bytes.

Encoding has three steps. Normalisation walks the text by longest prefix through the compiled
character map (a double-array trie with its replacement strings) and records, for every
normalised byte, the original byte it came from. Then adjacent symbols are merged by score.
At last every piece is projected through the alignment to a span of original bytes, of which a digest
and the number of bytes inside are part of every result.

Texts are merged in chunks that no vocabulary piece can cross: a cut between two characters is
made only where loading has proven that no piece holds these two side by side. A bounded
per-worker memo keeps chunks that came before; new ones of many texts are merged together, each
round of merges as one step over arrays.

Cases: a null text counts as empty and gives the end id alone; a text of any length is encoded
whole; repeated rows are encoded each for itself; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import read_table, whole_text
from vespertide.llm.tokens import Memo

# Fixed values of the model file format: piece kinds and the visible space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
MEMO_ENTRIES = 120_000
LONG_CHUNK = 64
#: Characters of a chunk that is merged together with others, and of texts whose chunks are.
SHORT_CHUNK = 32
GROUP_CHARACTERS = 1_000_000
#: Chunks that are merged at once; each takes about 2 KB meanwhile.
LEARN_CHUNKS = 8_192
#: Characters that no piece may hold but that texts hold often; marks of the vocabulary itself are added.
CUT_CANDIDATES = "\n\t\r"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one serialised message: varints as int, fixed32 as float, the rest as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class CharacterMap:
    """The compiled map of a normaliser: longest-prefix lookups in a double-array trie over bytes."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{n // 4}I", blob[4 : 4 + n]) if n else ()
        self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:] and what it is replaced by."""
        units = self.units
        if not units:
            return None
        found, node = None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found


class PieceModel:
    """A model file: pieces with scores, the normaliser and its settings."""

    def __init__(self, blob: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        norm = trainer = b""
        for number, value in fields(blob):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode("utf-8"), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = value
            elif number == 3:
                norm = value
        said = dict(fields(norm))
        trained = dict(fields(trainer))
        self.map = CharacterMap(said.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(said.get(k, 1)) for k in (3, 4, 5))
        if trained.get(3, 1) != 2:
            raise ValueError("only models that merge by score are supported")
        self.unknown_text = trained[44].decode("utf-8") if 44 in trained else " ⁇ "
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        if any(kind in (USER, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.end = next(i for i, x in enumerate(self.pieces) if x[0] == "</s>")
        order = sorted(self.ids.values(), key=lambda i: -self.pieces[i][1])
        scores = sorted({self.pieces[i][1] for i in order}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: Place of each piece by score: the best merges first.
        self.place = {self.pieces[i][0]: place[self.pieces[i][1]] for i in order}
        self.chunks = re.compile(self._cut_pattern())
        self.memo = Memo(self._encode_chunk, MEMO_ENTRIES, 4 * LONG_CHUNK)
        self.widths = np.array([len(p.encode("utf-8")) for p, _, _ in self.pieces], np.int32)
        self.numbers = list(map(str, range(len(self.pieces))))
        said = {UNKNOWN: lambda p: self.unknown_text.encode("utf-8"), CONTROL: lambda p: b"", BYTE: lambda p: bytes((int(p[3:5], 16),))}
        self.spoken = [said.get(kind, lambda p: p.replace(SPACE, " ").encode("utf-8"))(p) for p, _, kind in self.pieces]
        self._tables()

    # Normalisation ---------------------------------------------------------------------------------

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and for the end) the original offset it stands for."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._spaces_only(data)
        out, align = bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        at, end = 0, len(data)

        def step(i: int) -> tuple[int, bytes]:
            if hit := self.map.longest(data, i):
                return hit
            lead = data[i]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return n, data[i : i + n]

        if self.squeeze:
            while at < end and (got := step(at))[1] == b" ":
                at += got[0]
            if at == end:
                return b"", np.array([end])
        if self.dummy_prefix:
            out += space
            align += [at] * len(space)
        after_space = self.squeeze
        while at < end:
            n, to = step(at)
            if after_space:
                to = to.lstrip(b" ")
            for b in to:
                piece = space if b == 0x20 else bytes((b,))
                out += piece
                align += [at] * len(piece)
            if to:
                after_space = self.squeeze and to.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), np.array([*align, at], np.int64)

    def _spaces_only(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same walk where the map has no entries: every character stands for itself, and a visible space for a space."""
        space = SPACE.encode() if self.escape else b" "
        raw = np.frombuffer(data, np.uint8)
        # All bytes of a character stand for its first one.
        first = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(data)), 0))
        align = np.repeat(first, np.where(raw == 0x20, len(space), 1))
        prefix = space if self.dummy_prefix else b""
        return prefix + data.replace(b" ", space), np.concatenate([np.zeros(len(prefix), np.int64), align, [len(data)]])

    # Merging ---------------------------------------------------------------------------------------

    def _cut_pattern(self) -> str:
        """Chunks of normalised text. A cut character stands apart from letters if no piece joins it with any other character."""
        beside: dict[str, set[str]] = {}
        for p in self.place:
            for a, b in zip(p, p[1:]):
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
        marks = {c for c in beside if not c.isalpha() and not c.isdecimal() and c != SPACE and unicodedata.category(c)[0] != "M"} | set(CUT_CANDIDATES)
        while bad := {m for m in marks if beside.get(m, set()) - marks - {SPACE}}:
            marks -= bad
        after = any(b == SPACE and a != SPACE for p in self.place for a, b in zip(p, p[1:]))
        if after:
            return r"(?s).+"
        cut = "".join(map(re.escape, sorted(marks)))
        return f"{SPACE}*[{cut}]+|{SPACE}*[^{cut}{SPACE}]+|{SPACE}+" if cut else f"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges adjacent symbols into the piece of best score, leftmost first, until none is left."""
        if len(symbols) > LONG_CHUNK:
            return self._merged_long(symbols)
        find, none = self.place.get, len(self.place)
        order = [find(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            symbols[i] = new = symbols[i] + symbols[i + 1]
            del symbols[i + 1], order[i]
            if i < len(order):
                order[i] = find(new + symbols[i + 1], none)
            if i:
                order[i - 1] = find(symbols[i - 1] + new, none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        n, find, none = len(symbols), self.place.get, len(self.place)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(p, i, len(symbols[i]) + len(symbols[i + 1])) for i in range(n - 1) if (p := find(symbols[i] + symbols[i + 1], none)) < none]
        heapq.heapify(heap)
        while heap:
            place, i, size = heapq.heappop(heap)
            j = right[i]
            if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size or find(symbols[i] + symbols[j], none) != place:
                continue
            symbols[i], symbols[j], right[i] = symbols[i] + symbols[j], "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p in (left[i], i):
                if p >= 0 and right[p] >= 0 and (q := find(symbols[p] + symbols[right[p]], none)) < none:
                    heapq.heappush(heap, (q, p, len(symbols[p]) + len(symbols[right[p]])))
        return [s for s in symbols if s]

    def _tables(self) -> None:
        """What merging over arrays looks up: ids of characters, places of ids, and which id two neighbours make."""
        self.none = len(self.place)
        # The last one stands for no piece.
        self.places = np.array([self.place.get(p, self.none) if kind == NORMAL else self.none for p, _, kind in self.pieces] + [self.none], np.int32)
        self.letters = np.full(0x110000, -1, np.int32)
        made: dict[int, int] = {}
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    made[a * len(self.pieces) + b] = i
        order = sorted(made)
        self.pairs, self.makes = np.array([*order, 1 << 62], np.int64), np.array([*map(made.__getitem__, order), -1], np.int32)

    def _makes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two neighbours make, or -1; an id of -1 is no neighbour."""
        pair = a * np.int64(len(self.pieces)) + b
        at = np.searchsorted(self.pairs, pair)
        return np.where((self.pairs[at] == pair) & (a >= 0) & (b >= 0), self.makes[at], -1)

    def learn(self, chunks: set[str]) -> None:
        """Puts chunks in the memo that are not there, some of about the same length at once."""
        new = sorted((c for c in chunks if len(c) <= SHORT_CHUNK and c not in self.memo and c not in self.memo.old), key=len)
        for first in range(0, len(new), LEARN_CHUNKS):
            self._learn(new[first : first + LEARN_CHUNKS])

    def _learn(self, new: list[str]) -> None:
        """Each round merges in every chunk the two symbols of best score, leftmost first."""
        sizes = np.array(list(map(len, new)))
        wide = int(sizes.max())
        there = np.arange(wide + 1) < sizes[:, None]
        symbols = np.full(there.shape, -1, np.int32)
        symbols[there] = self.letters[np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)]
        # Characters that are no piece are left to the walk over one chunk.
        known = np.flatnonzero(((symbols >= 0) == there).all(1))
        symbols, there = symbols[known], there[known]
        right = np.broadcast_to(np.arange(1, wide + 2), there.shape).copy()
        left = right - 2
        makes = np.full(there.shape, -1, np.int32)
        makes[:, :-1] = self._makes(symbols[:, :-1], symbols[:, 1:])
        order, live = self.places[makes], np.arange(len(known))
        while len(live):
            i = order[live].argmin(1)
            more = order[live, i] < self.none
            live, i = live[more], i[more]
            j, k, h = right[live, i], right[live, right[live, i]], left[live, i]
            new_symbol = symbols[live, i] = makes[live, i]
            symbols[live, j], there[live, j], order[live, j] = -1, False, self.none
            right[live, i] = k
            left[live, np.minimum(k, wide)] = i
            # Column `wide` holds no symbol, so it stands for both ends.
            for at, a, b in ((i, new_symbol, symbols[live, np.minimum(k, wide)]), (np.where(h < 0, wide, h), symbols[live, np.where(h < 0, wide, h)], new_symbol)):
                makes[live, at] = got = self._makes(a, b)
                order[live, at] = self.places[got]
        ids = symbols[there]
        width = self.widths[ids]
        data = np.stack([ids, width, width], axis=1).tobytes()
        ends = (12 * there.sum(1).cumsum()).tolist()
        for n, a, b in zip(known.tolist(), [0, *ends], ends):
            self.memo.put(new[n], data[a:b])

    def _encode_chunk(self, chunk: str) -> bytes:
        """The pieces of a chunk, each as three 32-bit numbers: its id, the bytes from its begin to that of the next, and the bytes of its span."""
        rows = array("i")
        for piece in self.merged(list(chunk)):
            n = len(piece.encode("utf-8"))
            if (known := self.ids.get(piece)) is not None:
                rows.extend((known, n, n))
            elif self.byte_ids:
                # The bytes of one unknown character share its whole span.
                for k, b in enumerate(piece.encode("utf-8"), 1):
                    rows.extend((self.byte_ids[b], n if k == n else 0, n))
            elif rows and rows[-3] == self.unknown:
                rows[-2] += n
                rows[-1] += n
            else:
                rows.extend((self.unknown, n, n))
        return rows.tobytes()

    def normalised(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Chunks and alignment of each text; what is new in the chunks of some texts is learned at once."""
        some, size = [], 0
        for n, text in enumerate(texts, 1):
            normal, align = self.normalise(text.encode("utf-8"))
            some.append((self.chunks.findall(normal.decode("utf-8")), align))
            size += len(text)
            if size >= GROUP_CHARACTERS or n == len(texts):
                self.learn(set().union(*[chunks for chunks, _ in some]))
                yield from some
                some, size = [], 0

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Ids of each text without the end id, decoded text, and begins and ends of the pieces in original bytes."""
        for chunks, align in self.normalised(texts):
            found = np.frombuffer(b"".join(map(self.memo.__getitem__, chunks)), np.int32).reshape(-1, 3)
            ids, at = found[:, 0].tolist(), found[:, 1].cumsum() - found[:, 1]
            try:
                decoded = b"".join(map(self.spoken.__getitem__, ids)).decode("utf-8")
                decoded = decoded[1:] if self.dummy_prefix and decoded.startswith(" ") else decoded
            except UnicodeDecodeError:
                decoded = self.decode(ids)
            yield ids, decoded, align[at], align[at + found[:, 2]]

    def encode_with_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) in original bytes. The bytes of one unknown character share its whole span."""
        ids, _, begins, ends = next(self.encode([text]))
        return list(zip(ids, begins.tolist(), ends.tolist()))

    def digest(self, text: str) -> tuple[int, str, str, int, bytes]:
        """What digests() gives of one text."""
        return next(self.digests([text]))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, int, bytes]]:
        """Of each text the number of ids, ids as text with the end id, decoded text, original bytes inside spans, and the spans as 32-bit numbers."""
        for ids, decoded, begins, ends in self.encode(texts):
            said = " ".join(map(self.numbers.__getitem__, [*ids, self.end]))
            reach = np.maximum.accumulate(np.r_[0, ends])[:-1]
            inside = int(np.maximum(0, ends - np.maximum(begins, reach)).sum())
            yield len(ids) + 1, said, decoded, inside, np.stack([begins, ends], axis=1).astype("<i4").tobytes()

    # Decoding --------------------------------------------------------------------------------------

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """Text of ids: control ids vanish, byte ids form UTF-8 with U+FFFD for what does not, one leading space of the prefix goes."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            piece, _, kind = self.pieces[i] if i >= 0 else ("", 0, CONTROL)
            if kind == BYTE:
                raw.append(int(piece[3:5], 16))
                continue
            if raw:
                out.append(decode_bytes(bytes(raw)))
                raw.clear()
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            elif kind != CONTROL:
                out.append(piece.replace(SPACE, " "))
        text = "".join(out)
        return text[1:] if strip and self.dummy_prefix and text.startswith(" ") else text


def decode_bytes(data: bytes) -> str:
    """UTF-8, each byte that is not part of a whole character as U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            n = next((n for n in (1, 2, 3, 4) if _is_character(data[at : at + n], n)), 0)
            out.append(data[at : at + n].decode("utf-8") if n else "�")
            at += n or 1
        return "".join(out)


def _is_character(data: bytes, n: int) -> bool:
    try:
        return len(data) == n and len(data.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def load_pieces(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode_digests(df: DataFrame, model_path: str, text_col: str = "text", into: str = "encoded") -> DataFrame:
    """df with a struct of the number of ids, the SHA-256 of the ids, of the decoded text and of the spans, and the bytes inside spans, for each whole text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long, spans_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_pieces(model_path)
        sha = hashlib.sha256
        for texts in batches:
            rows = []
            for n, ids, decoded, inside, spans in model.digests(texts.tolist()):
                rows.append((n, sha(ids.encode()).hexdigest(), sha(decoded.encode("utf-8")).hexdigest(), inside, sha(spans).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_covered", "spans_sha256"]).astype({"n_tokens": "int64", "n_covered": "int64"})

    return df.withColumn(into, digests(whole_text(F.col(text_col))))


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", into: str = "pieces") -> DataFrame:
    """df with an array of (id, begin, end): the pieces of each whole text and their spans of original bytes."""

    @F.pandas_udf("array<struct<id: int, begin: int, end: int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_pieces(model_path)
        for texts in batches:
            yield pd.Series([[{"id": i, "begin": b, "end": e} for i, b, e in zip(ids, begins.tolist(), ends.tolist())] for ids, _, begins, ends in model.encode(texts.tolist())])

    return df.withColumn(into, spans(whole_text(F.col(text_col))))


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of an array of ids; a null array gives an empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_pieces(model_path)
        for batch in batches:
            yield pd.Series(["" if ids is None else model.decode(list(ids)) for ids in batch], dtype=object)

    return df.withColumn(into, texts(F.col(ids_col)))


def digest_rows(docs: DataFrame, model_path: str) -> DataFrame:
    out = encode_digests(docs.select("doc_id", "text"), model_path)
    return out.select("doc_id", "encoded.*")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document under piece_bpe_32k.model."""
    import public_tokenizers

    return digest_rows(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
