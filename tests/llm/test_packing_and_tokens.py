import zlib

import numpy as np
import pytest

from clausework.llm import packing as P
from clausework.llm import token_counts as T
from tests.llm.edge import edge

P_ = pytest.importorskip("public_tokenizers")


def check_packed(rows, texts):
    """Every id lies in one piece, sequences are gapless, and only few are padded."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P_.path("byte_bpe_50k.json"))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    by_total: dict = {}
    for r in rows:
        by_total.setdefault(r.doc_id, []).append(r)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return ids, by_total, sequences


def test_pieces_hold_each_id_once_and_padding_is_small(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.pack_documents(docs).collect()
    order = list(texts)
    ids, by_doc, sequences = check_packed(rows, [texts[i] for i in order])
    for doc, own in zip(order, ids, strict=True):
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    fill = [sum(n for _, n in own) for own in sequences.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill)


def test_odd_documents_and_special_strings(spark):
    rows = P.pack_documents(edge(spark), with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 1 and sum(r.length for r in rows if r.doc_id == 5) == 1
    assert sum(r.start == 0 for r in rows if r.doc_id == 7) == 2
    assert all(len(r.ids) == r.length for r in rows)
    assert P.pack_documents(edge(spark).limit(0)).count() == 0
    tok = P.encoder()
    assert P.encode(tok, "a<|endoftext|>b").tolist()[1] == 50256


def test_ids_equal_those_of_tokenizers():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(P_.path("byte_bpe_50k.json")), P.encoder()
    rng = np.random.default_rng(5)
    alphabet = list("abc ABC 012 '’.,!?\n\t\r\x0b é ñ ß 数 😀   <|>endoftext") + ["'s", "<|endoftext|>", "  ", "\n\n"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert P.encode(ours, text).tolist() == theirs.encode(text, add_special_tokens=False).ids + [0], repr(text)


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer, level = P.Packer(16), np.zeros(17, int)
    for size in rng.integers(1, 16, 500).tolist():
        best = {}
        for h in [0, *np.flatnonzero(level).tolist()]:
            if h + size <= 16:
                after = level.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                best[h] = int((after**2).sum())
        _, at = packer.put(size)
        assert best[at] == min(best.values())
        level[at] -= at > 0
        level[at + size] += at + size < 16
        assert (packer.level == level).all()


def naive(model, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + model.scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in model.scores]
        score, few = max(options)
        best.append((score, -few))
    return best[-1][1]


def test_trie_counts_equal_a_forward_pass_per_word():
    model = T.Unigram.from_ranks()
    words = sorted({w.encode() for w in " the there thereafter thermal the  x日本 é 's unbelievable believable aaaaaaaaaa 1234567 thea the".split(" ")} - {b""} | {b" the", b" them", b"\n\n", b"\xff\xfe"})
    assert model.counts(words) == [naive(model, w) for w in words]


def test_token_counts_of_documents(spark, sf):
    import public_tokenizers
    import regex

    model, split = T.Unigram.from_ranks(), regex.compile(public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(12)
    texts = {r.doc_id: r.text for r in docs.collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    known: dict[str, int] = {}
    for r in T.token_counts(df, memo=50).collect():
        words = split.findall(texts[r.doc_id])
        known |= {w: naive(model, w.encode()) for w in set(words) - known.keys()}
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(known[w] for w in words))
    got = [(r.doc_id, r.n_pretokens) for r in T.token_counts(edge(spark)).collect()]
    assert len(got) == 11 and (4, 0) in got and (5, 0) in got
