"""Operator 3: token counts by dynamic programming shared along a trie.

The tokenizer is a unigram model: a pre-token (a word with the word mark before it) is cut into
vocabulary pieces so that the sum of piece scores is greatest; ties take fewer, then longer last
pieces. Distinct pre-tokens are inserted in a trie. The forward score of a prefix - the best score
of its cuts and that cut's number of pieces - depends on the prefix alone, so it is computed when its
node is made, once for all pre-tokens that share it; a terminal node's number is the answer.

The vocabulary is a public one; its file gives merge order, not probabilities, so a piece's score is
Zipf's law for its rank, -log(rank + 2). A character outside the vocabulary costs one byte piece
for each of its UTF-8 bytes, each scored below every piece.

Rows: null and empty texts have no words and no tokens. Rows are independent, so ties, repeated rows
and nulls elsewhere make no difference; input columns with the added names are replaced. Tries are
bounded by TRIE_NODES for each worker and start afresh when full; a word of any length is scored whole, one of more than
LONG characters by the same recurrence over the last scores only, as hardly any word shares its nodes.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import pieces, small_batches, texts

TRIE_NODES = 1_000_000
CACHE_ENTRIES = 400_000
LONG = 256
MARK = "▁"


def load_pieces(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {name: -math.log(rank + 2) for rank, name in enumerate(names)}


class TokenTrie:
    """Pre-tokens and the forward scores of their prefixes."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = -math.log(len(scores) + 2) - 1.0
        self.words: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def alone(self, word: str) -> int:
        """insert()'s answer in constant memory: a piece reaches back at most `longest` scores."""
        scores, longest = self.scores, self.longest
        best, count = [0.0] * (longest + 1), [0] * (longest + 1)  # of the prefix of n letters at n mod (longest + 1)
        size = longest + 1
        for end, letter in enumerate(word, 1):
            value, number = None, 0
            for start in range(max(0, end - longest), end):
                piece = scores.get(word[start:end])
                if piece is None:
                    if start < end - 1:
                        continue
                    letters = len(letter.encode())
                    total, cuts = best[start % size] + letters * self.byte, count[start % size] + letters
                else:
                    total, cuts = best[start % size] + piece, count[start % size] + 1
                if value is None or total > value + 1e-9 or (total > value - 1e-9 and cuts < number):
                    value, number = total, cuts
            best[end % size], count[end % size] = value, number
        return count[len(word) % size]

    def insert(self, word: str) -> int:
        """Number of pieces of the best cut of a pre-token."""
        if len(word) > LONG:
            return self.alone(word)
        child, best, count, scores, longest = self.child, self.best, self.count, self.scores, self.longest
        path, node = [0], 0
        for end, letter in enumerate(word, 1):
            key = (node, letter)
            node = child.get(key)
            if node is None:
                value, number = None, 0
                for start in range(max(0, end - longest), end):
                    piece = scores.get(word[start:end])
                    if piece is None:
                        if start < end - 1:
                            continue
                        letters = len(letter.encode())
                        total, cuts = best[path[start]] + letters * self.byte, count[path[start]] + letters
                    else:
                        total, cuts = best[path[start]] + piece, count[path[start]] + 1
                    if value is None or total > value + 1e-9 or (total > value - 1e-9 and cuts < number):
                        value, number = total, cuts
                node = len(best)
                child[key] = node
                best.append(value)
                count.append(number)
            path.append(node)
        found = count[node]
        if len(best) > TRIE_NODES:
            self._clear()
        return found

    def total(self, words: list[bytes]) -> int:
        """Tokens of a text's words."""
        got = list(map(self.words.get, words))
        if None in got:
            cache = self.words
            for i, known in enumerate(got):
                if known is None:
                    word = words[i]
                    known = cache.get(word)
                    if known is None:
                        known = self.insert(MARK + word.decode("utf-8", "replace"))
                        if len(word) <= 64:
                            if len(cache) >= CACHE_ENTRIES:
                                cache.clear()
                            cache[word] = known
                    got[i] = known
        return sum(got)


_WORKER: dict[int, TokenTrie] = {}


def count_tokens(df: DataFrame, scores: dict[str, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words and n_tokens to each row of df; the text itself is carried only if `keep` names it."""
    small_batches(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in ("n_words", "n_tokens") and (keep is None or f.name in keep)]
    shared = df.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 1000)
        trie = _WORKER.get(0)
        if trie is None or trie.scores != shared.value:
            trie = _WORKER[0] = TokenTrie(shared.value)
        for rows, data, offsets in pieces(batches, text):
            raw = data.tobytes()
            n_words, n_tokens = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = raw[a:b].split()
                n_words.append(len(words))
                n_tokens.append(trie.total(words))
            yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in fields] + [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*[f.name for f in fields], "n_words", "n_tokens"])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(texts(spark, sf_dir, "doc_id", "text"), load_pieces(P.path("piece_bpe_32k.model")), keep=["doc_id"])
