"""Packing and token counts: exact round trips and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tessella.llm.packing import pack, packed_digests
from tessella.llm.token_counts import Automaton, piece_vocabulary, token_counts

PATH = P.path("word_bpe_49k.json")


def test_pack_round_trip(docs, rows, crowded):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, *_ in rows), key=str)
    pieces = pack(docs, tokenizer_path=PATH, length=64).collect()
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in stream:  # gapless: windows of 64 tokens, only the last not full
        assert (p.sequence_id, p.offset) == divmod(at, 64) and p.length == len(p.ids) // 4 and p.offset + p.length <= 64
        at += p.length
    whole, now = [], b""
    for p in stream:
        assert p.start == len(now) // 4
        now += bytes(p.ids)
        if len(now) // 4 == p.doc_tokens:
            whole.append((p.doc_id, now))
            now = b""
    assert sorted(whole, key=str) == want
    crc = {(p.sequence_id, p.offset): zlib.crc32(bytes(p.ids)) for p in pack(crowded, tokenizer_path=PATH, length=4096).collect()}
    assert {(r.sequence_id, r.offset): r.ids_crc32 for r in packed_digests(crowded).collect()} == crc


def greedy(first, further, word):
    n, i, pieces = 0, 0, first
    while i < len(word) or pieces is first:
        j = next((j for j in range(len(word), i - 1, -1) if word[i:j] in pieces and (j > i or pieces is first)), None)
        if j is None:
            return 0
        n, i, pieces = n + 1, j, further
    return n


def test_automaton():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randint(1, n)))
    for _ in range(300):
        first = {word(4) for _ in range(r.randint(1, 5))} | ({""} if r.random() < 0.3 else set())
        further = {word(4) for _ in range(r.randint(1, 5))}
        auto = Automaton(first, further)
        for _ in range(20):
            w = word(9)
            assert auto.count(w) == greedy(first, further, w)


def test_token_counts(docs, rows, crowded):
    path = P.path("piece_bpe_32k.model")
    first, further = (set(x) for x in piece_vocabulary(path))
    want = []
    for i, t, *_ in rows:
        counts = [greedy(first, further, w.decode()) for w in (t or "").encode().split()]
        want.append((str(i), len(counts), sum(c or 1 for c in counts), counts.count(0)))
    for d in (docs, crowded):
        assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in token_counts(d, model_path=path).collect()) == sorted(want)


def test_empty(empty):
    assert pack(empty, tokenizer_path=PATH).count() == 0
    assert token_counts(empty, model_path=P.path("piece_bpe_32k.model")).count() == 0
