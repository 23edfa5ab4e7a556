"""Token counts by a linear longest-match automaton (Song et al., "Fast WordPiece Tokenization", 2021).

The vocabulary's byte trie gets failure links and, per node, the number of pieces popped when the link is taken. Walking
a word byte by byte then gives the number of pieces that greedy longest-match would cut it into, in time linear in the
word and without building a piece. A word is a run of bytes other than ASCII white space, matched with a leading space,
as the vocabulary spells the starts of words. Every single byte must be a piece, so nothing is unknown.

Nulls: a null text has no words and no tokens. Rows are independent: repeated rows repeat, an empty table is empty.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from timberline.llm.common import map_texts

#: Words whose counts a worker remembers; the memo starts anew when full.
MEMO = 1 << 17
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """goto: (node << 8 | byte) -> node; link and popped: per node, where a failure leads and how many pieces it pops."""

    def __init__(self, pieces: Iterable[bytes]):
        goto: dict[int, int] = {}
        ends, children = [False], [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in goto:
                    goto[key] = len(ends)
                    children[node].append((byte, len(ends)))
                    ends.append(False)
                    children.append([])
                node = goto[key]
            ends[node] = bool(piece) or ends[node]
        if missing := [b for b in range(256) if b not in goto or not ends[goto[b]]]:
            raise ValueError(f"{len(missing)} single bytes are no pieces of the vocabulary")
        link, popped, queue = [-1] * len(ends), [0] * len(ends), deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                queue.append(child)
                if ends[child]:
                    link[child], popped[child] = 0, 1
                    continue
                at, n = link[node], popped[node]
                while at << 8 | byte not in goto:  # ends at the root, which has all bytes
                    n += popped[at]
                    at = link[at]
                link[child], popped[child] = goto[at << 8 | byte], n
        self.goto, self.link, self.popped = goto, link, popped

    def count(self, word: bytes) -> int:
        goto, link, popped = self.goto, self.link, self.popped
        node = n = 0
        for byte in word:
            while (to := goto.get(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
            node = to
        while node:
            n += popped[node]
            node = link[node]
        return n


class Memo(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


_memos: dict[int, Memo] = {}


def memo_for(pieces: list[bytes]) -> Memo:
    """One automaton a worker process and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _memos:
        _memos.clear()
        _memos[key] = Memo(Automaton(pieces))
    return _memos[key]


def count_batch(texts: list, memo: Memo) -> list[tuple[int, int, int]]:
    rows = []
    for t in texts:
        data = t.encode() if t is not None else b""
        words = data.split()
        rows.append((len(data), len(words), sum(map(memo.__getitem__, words))))
    return rows


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_words, n_tokens. No shuffle; the vocabulary (50,000 pieces) is broadcast."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        memo = memo_for(pieces.value)
        return lambda texts: count_batch(texts, memo)

    return map_texts(docs, text, {"doc_id": doc_id}, "n_bytes long, n_words long, n_tokens long", make)
