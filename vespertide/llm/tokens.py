"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is put through the merges by itself. Those that come out as one
token are proven: a pre-token equal to one of them counts 1 without any merging. Only the other
pre-tokens are merged, and a bounded per-worker memo keeps what was merged already.

Cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count one
token each, as the library does by default; texts of any length are read whole; repeated rows
are counted each for itself; columns beside the text are carried along untouched.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import read_table, whole_text

# The split pattern of byte-level BPE vocabularies of this family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 200_000
LONG_PRE_TOKEN = 48


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in such vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(0x100 + extra)
            extra += 1
    return out


class Memo(dict):
    """Bounded memo in two generations: when the young one is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, make, entries: int, longest: int):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value


class WholeTokenCounter:
    """Counts tokens of a text; `proven` holds the strings that are one token alone."""

    def __init__(self, ranks: dict[int, int], made: list[int], start: list[int], specials: list[str]):
        self.ranks, self.made, self.start = ranks, made, start
        self.none = len(made)
        self.pattern = regex.compile(PRE_TOKEN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.proven: set[str] = set()
        self.memo = Memo(self._count, MEMO_ENTRIES, LONG_PRE_TOKEN)

    def merged(self, data: bytes) -> int:
        """Number of tokens after all merges, lowest rank first, leftmost first."""
        start = self.start
        ids = [start[b] for b in data]
        if len(ids) > LONG_PRE_TOKEN:
            return self._merged_long(ids)
        find, made, none = self.ranks.get, self.made, self.none
        order = [find(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], order[i]
            if i < len(order):
                order[i] = find(new << 20 | ids[i + 1], none)
            if i:
                order[i - 1] = find(ids[i - 1] << 20 | new, none)
        return len(ids)

    def _merged_long(self, ids: list[int]) -> int:
        """The same with a heap over linked neighbours: n log n, for runs of any length."""
        n, find, none = len(ids), self.ranks.get, self.none
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], n
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := find(ids[i] << 20 | ids[i + 1], none)) < none]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], alive = self.made[rank], -1, alive - 1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for p in (left[i], i):
                if p >= 0 and right[p] >= 0 and (rank := find(ids[p] << 20 | ids[right[p]], none)) < none:
                    heapq.heappush(heap, (rank, p, ids[p], ids[right[p]]))
        return alive

    def _count(self, piece: str) -> int:
        return 1 if piece in self.proven else self.merged(piece.encode("utf-8"))

    def count(self, text: str) -> int:
        if self.specials and self.specials.search(text):
            plain = self.specials.split(text)
            return len(plain) - 1 + sum(self._plain(p) for p in plain if p)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.pattern.findall(text)))


@lru_cache(maxsize=2)
def load_counter(path: str) -> WholeTokenCounter:
    """Reads a vocabulary file and proves, string by string, which of its entries encode alone as one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
    ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
    alphabet = byte_alphabet()
    counter = WholeTokenCounter(ranks, [vocab[a + b] for a, b in merges], [vocab[c] for c in alphabet], [x["content"] for x in spec["added_tokens"]])
    back = {c: b for b, c in enumerate(alphabet)}
    for entry in vocab:
        if all(c in back for c in entry):
            data = bytes(back[c] for c in entry)
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if counter.pattern.findall(text) == [text] and counter.merged(data) == 1:
                counter.proven.add(text)
    return counter


def count_tokens(df: DataFrame, vocab_path: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """df with a long column of the token count of each whole text."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load_counter(vocab_path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return df.withColumn(into, counted(whole_text(F.col(text_col))))


def op2_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Token count of every document under byte_bpe_50k.json."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.octet_length(whole_text(F.col("text"))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
