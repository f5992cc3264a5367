"""Encoding texts with a byte-level BPE vocabulary by a trie that shares prefixes.

The last token of the encoding of a prefix is a state of that prefix: it is the one token t ending there whose
predecessor, the last token of the prefix without t, stays apart from t under the merge rules.  Distinct
words are inserted into a trie and the states propagate from parent to child, so a prefix that many words
share is encoded once; a word's ids are read off by following states back to its start.  The work a word is
linear in its length (times the longest token), also for words of a million bytes.

The trie lives in a task and covers the words that task meets; it is cleared when it exceeds NODES nodes, which
changes no result, as are the words and the pairs of tokens it remembers.  There is no shuffle: a document is encoded where it is read.  The vocabulary is a file of
fixed size, sent to the executors as bytes.

Defined results: an empty text and a null text both have an empty list of ids; strings of special tokens are
ordinary text; other columns are untouched.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES, WORDS, PAIRS = 2_000_000, 300_000, 2_000_000
#: How this family of vocabularies splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(2)
def encoder(data: bytes) -> TrieEncoder:
    """The encoder of a vocabulary file; a worker process keeps it from one task to the next."""
    return TrieEncoder(read_ranks(data))


class TrieEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.apart: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.last: list[int] = [-1]

    def merge(self, data: bytes) -> list[int]:
        """The ids of a short string by the definition: merge the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stay_apart(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.apart[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _state(self, word: bytes, end: int, path: list[int]) -> int:
        """The last token of word[:end], from the states of its proper prefixes."""
        get, last = self.ranks.get, self.last
        for size in range(min(end, self.longest), 0, -1):
            t = get(word[end - size : end])
            if t is None:
                continue
            if size == end:
                if size <= 2 or self.merge(word[:end]) == [t]:
                    return t
            elif self.stay_apart(last[path[end - size]], t):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def insert(self, word: bytes) -> list[int]:
        """Walks the word's prefixes, giving states to those that are new; returns its ids."""
        node, path, edges = 0, [0], self.edges
        for end, byte in enumerate(word, 1):
            edge = node << 8 | byte
            node = edges.get(edge, -1)
            if node < 0:
                state = self._state(word, end, path)
                node = edges[edge] = len(self.last)
                self.last.append(state)
            path.append(node)
        out, end = [], len(word)
        while end:
            t = self.last[path[end]]
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        known = self.words
        new = {w for ws in split for w in ws if w not in known}
        for w in sorted(new):  # in order, so that the trie is walked depth first
            data = w.encode()
            single = self.ranks.get(data)
            known[w] = [single] if single is not None else self.insert(data)
            if len(self.last) > NODES:
                self.clear()
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            out.append(ids)
        return out


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public vocabulary file: TRESSAGE_TOKENIZERS, or the installed files."""
    folder = os.environ.get("TRESSAGE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text by the vocabulary file at ``vocabulary``, without special tokens."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        held = encoder(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = held.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_t")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
