import zlib

import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing, token_counts
from shelfwise.llm.encoding import ChunkEncoder, word_bpe_path


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(word_bpe_path())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " a b　c\x1c\x85d\n\te ", "I'LL don't it's ''s 12a ½ ² Ⅷ", "ΣΑΣ İstanbul ẞ ŉ ǅ Ａｂ é é", "<|endoftext|> x<|startoftext|>", "你好 😀😀 #####!!! " + "y" * 300]


def test_encoder_is_the_tokenizer(spark, tokenizer):
    from_sf = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = TEXTS + from_sf
    for text, ids in zip(texts, ChunkEncoder(word_bpe_path()).encode(texts)):
        assert memoryview(ids).cast("I").tolist() == ids_of(tokenizer, text), text


def test_letters_that_only_become_lower_case(tokenizer):
    for code in [*range(0x21, 0x7F), *range(0xA1, 0x250)]:
        for text in (chr(code), f"a{chr(code)}Z", f"{chr(code)}{chr(code)}"):
            assert tokenizer.normalizer.normalize_str(text) == text.lower(), hex(code)


def test_token_counts_against_brute_force(docs_of, odd_rows, tokenizer):
    counted = token_counts.lengths(docs_of(odd_rows))
    n = sorted(len(ids_of(tokenizer, t)) for _, t in odd_rows)
    assert sorted(r.n_tokens for r in counted.collect()) == n
    hist = token_counts.histogram(counted)
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert r.n_docs == n.count(x)
        assert r.docs_at_least == sum(y >= x for y in n)
        assert r.tokens_at_least == sum(y for y in n if y >= x)
        assert r.truncated_total == sum(min(x, y) for y in n)
        assert r.docs_up_to_share == sum(y <= x for y in n) / len(n)
    limits = [0, 1, 7, 512, 10**6]
    for r in token_counts.at_limits(hist, limits).collect():
        limit = r.context_limit
        assert (r.docs_cut, r.tokens, r.tokens_kept) == (sum(y > limit for y in n), sum(n), sum(min(limit, y) for y in n))
    for r in token_counts.quantiles(hist, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == next(y for y in n if sum(z <= y for z in n) / len(n) >= r.share)


def test_histogram_over_many_blocks(spark):
    n = [x * 37 % 90_000 for x in range(4000)] + [5] * 30
    rows = {r.n_tokens: r for r in token_counts.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")).collect()}
    for x in (0, 5, 37, max(n)):
        assert rows[x].docs_at_least == sum(y >= x for y in n) and rows[x].tokens_at_least == sum(y for y in n if y >= x)


def test_empty_tables(docs_of):
    assert token_counts.histogram(token_counts.lengths(docs_of([]))).count() == 0
    assert packing.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 4095, 4096, 4097, 12_345])
def test_pieces(n):
    p = packing.pieces(n)
    assert [s for s, _ in p] == [sum(x for _, x in p[:i]) for i in range(len(p))]
    assert sum(x for _, x in p) == n and all(x <= 4096 and x & (x - 1) == 0 for _, x in p)
    assert len(p) == n // 4096 + bin(n % 4096).count("1")


def test_packing_round_trip(docs_of, odd_rows, tokenizer):
    rows = packing.pack(docs_of(odd_rows)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in rows:
        assert r.length == 2**r.bucket == len(r.ids) <= 4096 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for doc_id, text in odd_rows:
        want = ids_of(tokenizer, text) + [packing.END_ID]
        pieces = sorted(got[doc_id, len(want)])
        copies = sum(x == (doc_id, text) for x in odd_rows)
        assert [i for _, ids in pieces[::copies] for i in ids] == want


def test_length_must_be_a_power_of_two(docs_of):
    with pytest.raises(ValueError):
        packing.pack(docs_of([]), max_length=100)
