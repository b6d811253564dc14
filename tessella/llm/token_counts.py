"""Token counts by a linear longest-match automaton: greedy word pieces are counted, not built."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import ship, small_batches, table, text_or_empty

CACHE_WORDS = 300_000  # words whose count a task keeps; beyond, it starts anew


class Automaton:
    """Trie of a vocabulary of first pieces and further pieces, with failure links and popped-token counts.

    State 0 is the trie of first pieces, state 1 that of further pieces. Where no edge fits, the tokens that are then
    certain are popped: fails[v] is the state after that and pops[v] their number; -1 where no pieces fit. Each
    letter is read once and each pop is paid for by a letter, so a word takes time in proportion to its length.
    """

    def __init__(self, first: Iterable[str], further: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        whole = set()
        order = [0, 1]
        for root, pieces in ((0, first), (1, further)):
            for piece in pieces:
                v = root
                for c in piece:
                    if c not in self.edges[v]:
                        self.edges[v][c] = len(self.edges)
                        self.edges.append({})
                    v = self.edges[v][c]
                if v != 1:  # a further piece has at least one letter
                    whole.add(v)
        self.fails, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        if 0 in whole:  # the vocabulary has the bare sign of a word's start
            self.fails[0], self.pops[0] = 1, 1
        at = 0
        while at < len(order):
            u = order[at]
            at += 1
            for c, v in self.edges[u].items():
                order.append(v)
                if v in whole:
                    self.fails[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fails[u], self.pops[u]
                while z >= 0 and c not in self.edges[z]:
                    popped += self.pops[z]
                    z = self.fails[z]
                if z >= 0:
                    self.fails[v], self.pops[v] = self.edges[z][c], popped

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of a word; 0 if no pieces spell it."""
        edges, fails, pops = self.edges, self.fails, self.pops
        n = u = 0
        for c in word:
            v = edges[u].get(c)
            while v is None:
                n += pops[u]
                u = fails[u]
                if u < 0:
                    return 0
                v = edges[u].get(c)
            u = v
        while u != 1:
            n += pops[u]
            u = fails[u]
            if u < 0:
                return 0
        return n


def piece_vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """First and further pieces of a sentencepiece model: those with and without the sign of a word's start."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    first, further = [], []
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)):
            piece = m.id_to_piece(i)
            (first if piece[0] == "▁" else further).append(piece.removeprefix("▁"))
    return first, further


def token_counts(docs: DataFrame, *, model_path: str) -> DataFrame:
    """Greedy word-piece token counts: doc_id, n_words, n_tokens, n_unknown, one row per row of docs.

    docs: doc_id, text; other columns are ignored. Words are runs of non-white-space. A word that the pieces cannot
    spell is one unknown token, as in greedy word-piece coding. Nothing is shuffled; a document's words are counted
    once each however often they repeat. Null and empty texts have 0 of each; an empty table gives an empty result.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(*piece_vocabulary(model_path))
        kept: dict[bytes, int] = {}
        for b in batches:
            sums = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = text.split()
                new = set(words).difference(kept)
                if len(kept) + len(new) > CACHE_WORDS:
                    kept.clear()
                    new = set(words)
                for w in new:
                    kept[w] = auto.count(w.decode())
                counts = [kept[w] for w in words]
                unknown = counts.count(0)
                sums.append((len(words), sum(counts) + unknown, unknown))
            cols = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)] if sums else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), model_path=public_tokenizers.path("piece_bpe_32k.model"))


ship(__name__)
