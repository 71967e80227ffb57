"""Token counts (op5): byte-pair merging with a heap over a linked list, counting merges only.

A text has as many tokens as it has initial symbols less the merges that happen; no identifier is
ever made.  The initial symbols are the characters of the normalised text; a character outside the
vocabulary counts as its UTF-8 bytes.  No piece of the vocabulary holds a space mark after another
character, nor a line feed, so merges never cross these places and a text is counted word by word,
each distinct word once per worker (the memory of words is bounded).  A worker holds a batch of texts; a very long
text is counted like any other, and a word as long as a text takes some 200 bytes for each of its.

Null and empty texts have 0 tokens.  Every input row gives one row, also of repeated rows and ids; columns besides id and text are
not read, whatever their names.  An empty table gives no rows.  Adjacent pairs of equal rank merge from left to right, as in the library.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import documents, id_back, id_text

MARK = "▁"
#: Distinct words a worker remembers before it starts afresh.
MEMORY = 400_000


class PieceCounter(dict):
    """counter[word]: number of tokens of the space mark followed by `word`."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(sp.vocab_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        self.splits = not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.rank)
        self.bytes = any(sp.is_byte(i) for i in range(sp.vocab_size()))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        first, *rest = word.split("\n")
        n = self.merge(MARK + first) + sum(map(self.merge, rest)) + len(rest) * self.alone("\n")
        self[word] = n
        return n

    def alone(self, char: str) -> int:
        return 1 if char in self.rank or not self.bytes else len(char.encode("utf-8", "surrogatepass"))

    def merge(self, text: str) -> int:
        """Symbols less merges: pop the adjacent pair of lowest rank, leftmost first, until none is left."""
        n, rank = len(text), self.rank
        if n < 2:
            return self.alone(text) if n else 0
        symbol: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbol[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbol[j]) != size:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = left + symbol[j], None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(pair := symbol[i] + symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, len(pair)))
            if (h := before[i]) >= 0 and (r := rank.get(pair := symbol[h] + symbol[i])) is not None:
                heapq.heappush(heap, (r, h, len(pair)))
        return sum(self.alone(c) for c in text) - merges

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = self.sp.normalize(text)
        if not self.splits:
            return self.merge(text)
        if MARK + MARK not in text and text.startswith(MARK):
            return sum(map(self.__getitem__, text[1:].split(MARK)))
        total, start, n = 0, 0, len(text)
        while start < n:  # a run of space marks belongs to the word that follows it
            word = start
            while word < n and text[word] == MARK:
                word += 1
            end = text.find(MARK, word)
            end = n if end < 0 else end
            if word == start + 1:
                total += self[text[word:end]]
            else:
                first, *rest = text[start:end].split("\n")
                total += self.merge(first) + sum(map(self.merge, rest)) + len(rest) * self.alone("\n")
            start = end
        return total


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One counter per worker process and model."""
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; see the module's text for the edge cases."""

    def run(batches):
        count = counter(model_file).count
        for b in batches:
            n = [count(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_text(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return id_back(rows.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long, over_limit boolean"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_token_counts": op5_token_counts}
