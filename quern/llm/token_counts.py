"""Token counts by dynamic programming that is shared along a trie.

A unigram model splits each pre-token into the pieces of the largest summed log-probability. The forward score
of a prefix depends on the prefix alone, so pre-tokens that begin alike share it: distinct pre-tokens go into a
trie, each node's score is computed once from its ancestors, and the node where a pre-token ends stores its
count. Documents then only sum the stored counts of their pre-tokens. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm import arrows

MAX_NODES = 800_000


@lru_cache(maxsize=4)
def zipf_scores(rank_file: str) -> dict[bytes, float]:
    """Log-probabilities of the pieces of a rank file: the r-th piece has a share of 1 / (r + 1)."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - norm for token, r in ranks.items()}


class Trie:
    """The trie of pre-tokens seen so far. Beyond `most` nodes it starts anew, which changes no count."""

    def __init__(self, scores: dict[bytes, float], most: int = MAX_NODES):
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0  # of a single byte that is no piece
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("q", [0])
        self.ends: dict[str, int] = {}

    def add(self, token: str) -> int:
        """The token's number of pieces. The larger score wins, then the smaller number of pieces."""
        if len(self.best) > self.most:
            self.clear()
        data, child, best, count, scores = token.encode("utf-8", "replace"), self.child, self.best, self.count, self.scores
        path = [0]
        node = 0
        for depth, byte in enumerate(data, 1):
            key = node << 8 | byte
            if (node := child.get(key, 0)) == 0:
                top, n = -math.inf, 0
                for start in range(max(0, depth - self.longest), depth):
                    score = scores.get(data[start:depth])
                    if score is None:
                        if start < depth - 1:
                            continue
                        score = self.unknown
                    before = path[start]
                    total = best[before] + score
                    if total > top or (total == top and count[before] + 1 < n):
                        top, n = total, count[before] + 1
                node = child[key] = len(best)
                best.append(top)
                count.append(n)
            path.append(node)
        self.ends[token] = count[node]
        return count[node]


_tries: dict[tuple, Trie] = {}


def _trie(rank_file: str, most: int) -> Trie:
    key = (rank_file, most)
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(zipf_scores(rank_file), most)
    return _tries[key]


def count(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", most: int = MAX_NODES) -> DataFrame:
    """Adds n_pretokens and n_tokens (long): the pre-tokens of each text by `pattern`, and their pieces under the
    unigram model of `rank_file`.

    A null or empty text has none of either. Long texts are walked match by match. Repeated rows each get the
    same counts; an empty table gives an empty one. Columns of those names in the input are replaced. The trie
    lives in the Python worker and is kept from task to task; `most` bounds its nodes.
    """
    kept = [c for c in docs.columns if c not in ("n_pretokens", "n_tokens")]
    source = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, split = _trie(rank_file, most), regex.compile(pattern).finditer
        for batch in arrows.slices(batches, text):
            seen, sums = [], []
            for value in arrows.texts(batch.column(text)):
                pieces, total, known = 0, 0, trie.ends
                for match in split(value):
                    token = match.group()
                    pieces += 1
                    n = known.get(token)
                    if n is None:
                        n = trie.add(token)
                        known = trie.ends
                    total += n
                seen.append(pieces)
                sums.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.int64()), pa.array(sums, pa.int64())], names=[*kept, "n_pretokens", "n_tokens"])

    return arrows.modest(source).mapInArrow(work, schema)
