import hashlib
import random

import public_tokenizers
import pytest
import zstandard

from loamtext.llm import pieces, token_counts

ALPHABET = ["A", "É", "\x85", "\xa0", "\x1c", "ß", "a", "b ", " ", "\n", "'s", "'", "é", "é", "<|endoftext|>", "12", "…", "İ", "　", "你好", "😀", "word ", "don't ", "\t", "ﬁ", "▁", "▁▁", "<s>", "   "]


def texts(n, most):
    r = random.Random(9)
    return ["".join(r.choices(ALPHABET, k=r.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


def test_spliced_counts_equal_the_library(library):
    r = random.Random(1)
    for t in texts(400, 160):
        want = len(library.full.encode(t, add_special_tokens=False).ids)
        assert token_counts.count_huge(library, t, chunk=r.choice([8, 20, 40]), overlap=r.choice([2, 5, 9])) == want if t else want == 0
        assert token_counts.count_batch(library, [t]) == [want]


def test_a_text_without_white_space_is_encoded_in_one_piece(library):
    t = "aé" * 300
    assert token_counts.count_huge(library, t, chunk=50, overlap=4) == len(library.full.encode(t, add_special_tokens=False).ids)


def test_special_strings_in_other_cases_are_plain_text(library):
    for special in library.specials:
        for t in (f"a {special.upper()} b", f"x {special.title()}", f"a {special} b", f"{special.upper()}{special}"):
            want = len(library.full.encode(t, add_special_tokens=False).ids)
            assert token_counts.count_batch(library, [t]) == [want]
            assert token_counts.count_huge(library, t * 5, chunk=30, overlap=5) == len(library.full.encode(t * 5, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(odd, odd_rows, none, library):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, token_counts.count_tokens(odd, path).collect()), key=repr)
    want = []
    for r in odd_rows:
        t = r[1] or ""
        n = len(library.full.encode(t, add_special_tokens=False).ids)
        want.append((r[0], len(t.encode()), n, n > 2048))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(none, path).count() == 0


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = pieces.load(path)
    some = ["", " ", "  a  b ", *texts(2000, 40)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode_documents(docs, path, digests=False).collect()}
    assert len(got) == len(some)
    for k, t in enumerate(some):
        assert list(got[k].ids) == sp.encode(t) and got[k].n_tokens == len(got[k].ids) and got[k].decoded == sp.decode(sp.encode(t))
    small = docs.where("doc_id < 300")
    for blocks in ({"block_chunks": 50, "block_chars": 90}, {"block_chars": 1}):  # the size of blocks changes no result
        assert {r.doc_id: r for r in pieces.encode_documents(small, path, digests=False, **blocks).collect()} == {k: got[k] for k in range(300)}
        assert pieces.in_blocks(small.toDF("id", "t"), "texts", **blocks).select("block").distinct().count() > 8


def test_each_distinct_chunk_is_one_entry_of_a_block(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b a a"), (3, None)], "id long, t string").coalesce(1)
    rows = pieces.in_blocks(docs, "chunks", 2).collect()
    chunks = [c for r in rows for c in zstandard.decompress(bytes(r.words)).decode().split(" ")]
    assert sorted(chunks) == ["a", "b"]
    order = pieces.in_blocks(docs, "texts").orderBy("id").collect()
    assert [pieces.unpack(bytes(r.numbers)).tolist() for r in order] == [[0, 1, 0], [1, 0, 0], []]


def test_pieces_of_odd_rows(odd, odd_rows, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = pieces.load(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_rows:
        ids = sp.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, pieces.encode_documents(odd, path).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.encode_documents(none, path).count() == 0
    plain = pieces.encode_documents(odd, path, digests=False).where("doc_id = 6").first()
    assert list(plain.ids) == sp.encode(odd_rows[6][1]) and plain.decoded == odd_rows[6][1]


def test_a_million_characters_without_white_space(library):
    import time

    t = "".join(random.Random(2).choices("abcdefghijklmnop1234", k=1_000_000))
    began = time.perf_counter()
    whole = len(library.full.encode(t, add_special_tokens=False).ids)
    alone = time.perf_counter() - began
    began = time.perf_counter()
    assert token_counts.count_batch(library, [t]) == [whole]
    assert time.perf_counter() - began < 6 * alone + 2
