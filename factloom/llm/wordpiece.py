"""Operator 8: token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces need no pieces to be counted: on a trie of the vocabulary
every node carries a failure link and the number of tokens that following it pops. Matching
walks the trie; where no edge fits it adds the popped count and takes the failure link, so each
character is looked at a bounded number of times and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, read_table
from .piece_bpe import SPACE, default_model

#: Characters that a worker's memo of words may hold, 150 for each entry among them; a full memo
#: starts anew, and longer words than `MEMO_WORD` are never kept.
MEMO_CHARS, MEMO_WORD = 30_000_000, 100


class CountingTrie:
    """`initial` pieces begin a word, `inner` ones continue it; a word that no greedy split covers counts 1."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: at a word's begin, 1: after a piece
        self.token, self.fail, self.pops = [False, False], [-1, -1], [0, 0]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.edges[node].get(c)
                    if to is None:
                        to = self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        self.token.append(False)
                        self.fail.append(-1)
                        self.pops.append(0)
                    node = to
                if piece:
                    self.token[node] = True
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.edges[node].items():
                if self.token[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    back, popped = self.fail[node], self.pops[node]
                    while back >= 0 and c not in self.edges[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.pops[child] = self.edges[back][c], popped
                queue.append(child)
        self.memo: dict[str, int] = {}
        self.held = 0

    def count(self, word: str) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node, total = 0, 0
        for c in word:
            to = edges[node].get(c)
            while to is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = edges[node].get(c)
            node = to
        while node != 1:  # pop what is left
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def count_text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = [w.decode() for w in (text or "").encode().split()]
        memo, total = self.memo, 0
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= MEMO_WORD:
                    self.held += len(w) + 150
                    if self.held > MEMO_CHARS:
                        memo.clear()
                        self.held = len(w) + 150
                    memo[w] = n
            total += n
        return len(words), total


def vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """The model's pieces as a word-piece vocabulary: those with one space mark in front begin a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    normal = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    initial = [p[1:] for p in normal if p.startswith(SPACE) and not p.startswith(SPACE * 2) and len(p) > 1]
    return initial, [p for p in normal if not p.startswith(SPACE)]


_loaded: dict[str, CountingTrie] = {}


def load(model_path: str) -> CountingTrie:
    if model_path not in _loaded:
        _loaded[model_path] = CountingTrie(*vocabulary(model_path))
    return _loaded[model_path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens) of every row: white-space words, and their greedy word pieces.

    A null or empty text has none of either; a word that can't be covered counts as one unknown
    token. Rows stay apart even if they repeat an id. Texts are read whole.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(path)
        for batch in batches:
            for part in pieces(batch, 1):
                counts = [trie.count_text(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], [id_col, "n_words", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
