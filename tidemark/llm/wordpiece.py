"""Greedy longest-match word-piece counts in linear time, without building pieces.

One trie holds the pieces that may begin a word and, under a second root, the
pieces that may go on.  Each node has a failure link: the node reached when the
longest pieces read so far are popped and matching goes on under the second
root; next to it stands how many pieces that pops.  A word is read once, left
to right; the count is the sum of the numbers on the links taken.

Defined results: a word that cannot be split into pieces counts as one unknown
token; null and empty texts have no words and no tokens; texts and words of any
length are read whole, in time linear in it; repeated rows give repeated results;
columns other than id and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import file_bytes, kept, map_batches, texts_of
from tidemark.llm.sentencepiece import NORMAL, SPACE, PieceModel

#: A word: a run of letters, digits and underscores, or one other character that is no white space.
WORD = re.compile(r"\w+|[^\w\s]")


class CountAutomaton:
    """Counts greedy pieces of words over pieces that begin words and pieces that go on."""

    def __init__(self, begins: set[str], goes_on: set[str]):
        self.step: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 goes on
        self.link = [-1, -1]
        self.popped = [0, 0]
        is_piece = [False, False]
        for root, pieces in ((0, begins), (1, goes_on)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for c in piece:
                    nxt = self.step[node].get(c)
                    if nxt is None:
                        nxt = self.step[node][c] = len(self.step)
                        self.step.append({})
                        self.link.append(-1)
                        self.popped.append(0)
                        is_piece.append(False)
                    node = nxt
                is_piece[node] = True
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.step[u].items():
                queue.append(v)
                if is_piece[v]:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                count, z = self.popped[u], self.link[u]
                while z >= 0 and c not in self.step[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.step[z][c], count

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if it cannot be split."""
        step, link, popped = self.step, self.link, self.popped
        node = total = 0
        for c in word:
            while (nxt := step[node].get(c)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = nxt
        while node > 1:
            total += popped[node]
            node = link[node]
        return total if node == 1 else 0

    @classmethod
    def from_pieces(cls, model: PieceModel) -> CountAutomaton:
        """Pieces with a leading space begin words, the others go on."""
        normal = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL]
        return cls({p[1:] for p in normal if p.startswith(SPACE) and SPACE not in p[1:]}, {p for p in normal if SPACE not in p})


class _Counts(dict):
    """Counts of words met so far, within a bound."""

    def __init__(self, automaton: CountAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= 48:
            if len(self) >= 400_000:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_tokens (an unknown word is one token), n_unknown."""
    sent = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = kept(("word pieces", model_path), lambda: _Counts(CountAutomaton.from_pieces(PieceModel(sent.value))))
        words, tokens, unknown = [], [], []
        for text in batch.column(1).to_pylist():
            own = [counts[w] for w in WORD.findall(text)]
            none = own.count(0)
            words.append(len(own))
            tokens.append(sum(own) + none)
            unknown.append(none)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_batches(texts_of(docs, id_col, text_col), per_batch, "doc_id long, n_words long, n_tokens long, n_unknown long")
