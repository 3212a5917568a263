"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a prefix doesn't depend on what follows it, so its forward score is computed once for each
node of a trie of pre-tokens: words that share a prefix share its scores, whenever they come. A node that ends a word is
terminal and has the word's count and score; a text's count is the sum over its words. Words of more than 64 characters
have a terminal only, and their scores are computed along them. The trie lives in a Python worker
from task to task, and starts anew when it has a number of nodes, which costs time but changes nothing.

The vocabulary is a public one with ranked pieces; a piece's score is its logarithmic share under Zipf's law for its
rank, so nothing is trained. A pre-token is a run of non-space characters with the vocabulary's word mark before it.
A character outside the vocabulary costs one byte token for each of its UTF-8 bytes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import worker_memory
from .textscan import slices

VOCABULARY = "piece_bpe_32k.model"
#: Words of more characters have no nodes of their own.
LONG = 64
MARK = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], float, int]:
    """Piece scores, the score of one byte of an unknown character, the longest piece's length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    usable = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = float(np.sum(1.0 / np.arange(1, len(usable) + 2)))
    scores = {sp.id_to_piece(i): -float(np.log((rank + 1) * total)) for rank, i in enumerate(usable)}
    return scores, -float(np.log((len(usable) + 1) * total)), max(map(len, scores), default=1)


class TrieCounter:
    """A trie of pre-tokens with a forward score and token count in each node.

    Nodes are numbered; `child` holds the edges as (node, character) -> node, packed into one integer. `terminal` leads
    from a word to its node, so words met before aren't walked again.
    """

    def __init__(self, path: str, nodes: int = 600_000):
        self.scores, self.byte_score, self.longest = vocabulary(path)
        self.nodes = nodes
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}
        self.computed = 0

    def add(self, words: list[str]) -> None:
        """Insert words: walk along the nodes that are there, and compute the scores of those that aren't."""
        get, longest, byte_score, child, score, count = self.scores.get, self.longest, self.byte_score, self.child, self.score, self.count
        for word in words:
            if len(word) > LONG:  # hardly shares its prefixes: one terminal, no nodes on the way
                self.terminal[word] = len(score)
                best, tokens = self._walk(MARK + word)
                score.append(best)
                count.append(tokens)
                continue
            marked = MARK + word
            path = [0]  # the node of each prefix
            node = 0
            for end, c in enumerate(marked, 1):
                edge = (node << 21) | ord(c)
                found = child.get(edge)
                if found is None:
                    n_bytes = len(c.encode("utf-8", "surrogatepass"))
                    best, tokens = score[node] + n_bytes * byte_score, count[node] + n_bytes
                    for begin in range(max(0, end - longest), end):
                        if (s := get(marked[begin:end])) is not None:
                            s += score[path[begin]]
                            if s > best or (s == best and count[path[begin]] + 1 < tokens):
                                best, tokens = s, count[path[begin]] + 1
                    found = child[edge] = len(score)
                    score.append(best)
                    count.append(tokens)
                    self.computed += 1
                node = found
                path.append(node)
            self.terminal[word] = node

    def _walk(self, marked: str) -> tuple[float, int]:
        """Score and tokens of a long word, with the last few prefixes' in mind."""
        get, longest, byte_score = self.scores.get, self.longest, self.byte_score
        last = deque([(0.0, 0)], maxlen=longest)
        for end, c in enumerate(marked, 1):
            n_bytes = len(c.encode("utf-8", "surrogatepass"))
            best, tokens = last[-1][0] + n_bytes * byte_score, last[-1][1] + n_bytes
            begin = end - len(last)
            for k, (before, n) in enumerate(last, begin):
                if (s := get(marked[k:end])) is not None:
                    s += before
                    if s > best or (s == best and n + 1 < tokens):
                        best, tokens = s, n + 1
            last.append((best, tokens))
        return last[-1]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: pre-tokens, tokens, score."""
        if len(self.score) > self.nodes:
            self._clear()
        every, sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.split()
            sizes[i] = len(own)
            every += own
        get = self.terminal.get
        where = np.fromiter((get(w, -1) for w in every), np.int64, len(every))
        if (new := np.flatnonzero(where < 0)).size:
            self.add(list(dict.fromkeys([every[i] for i in new])))
            where[new] = np.fromiter((get(every[i]) for i in new), np.int64, len(new))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        used, place = np.unique(where, return_inverse=True)
        tokens = np.concatenate([[0], np.cumsum(np.fromiter(map(self.count.__getitem__, used.tolist()), np.int64, len(used))[place])])
        of = np.repeat(np.arange(len(texts)), sizes)
        score = np.bincount(of, np.fromiter(map(self.score.__getitem__, used.tolist()), float, len(used))[place], len(texts))
        return sizes, tokens[bounds[1:]] - tokens[bounds[:-1]], score


def worker_counter(path: str) -> TrieCounter:
    """A Python worker's trie: it lives on from task to task."""
    return worker_memory(("trie", path), lambda: TrieCounter(path))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each row: doc_id, n_pretokens, n_tokens, score (the best segmentation's log-probability).

    Null and empty texts have none of any; texts and words of any length are counted whole. Rows with equal or null ids are counted one by one; other columns are
    ignored; an empty table gives an empty result.
    """
    path = path or str(public_tokenizers.path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                n, tokens, score = counter.texts(batch.column(1).slice(lo, hi - lo).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(tokens), pa.array(score)], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
