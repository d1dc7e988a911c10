import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bytebpe, queries

PATHS = [P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    return bytebpe.coder(request.param, P.PATTERN), library(request.param)


ODD = ["", " ", "  a  b ", "a \n b", "\n\n x\t y ", "don't they'RE", "a\x1cb \x85 c 　d", "\U0001f600\U0001f468‍\U0001f469 é́ ½²", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ab" * 3000, "<|endoftext|>", "0123456789" * 50, "the quick  brown\r\n\tfox "]


def test_odd_texts(both):
    bpe, lib = both
    for text in ODD:
        ids = bpe.encode(text).tolist()
        assert ids == lib.encode_ordinary(text) and bpe.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab '\n.étdn", max_size=120))
def test_any_text(text):
    bpe, lib = bytebpe.coder(PATHS[0], P.PATTERN), library(PATHS[0])
    assert bpe.encode(text).tolist() == lib.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aZé1日 \t\n\0.,'(_-\u2019\xa0", max_size=25), max_size=6))
def test_texts_are_cut_where_pieces_begin(some):
    bpe, lib = bytebpe.coder(PATHS[0], P.PATTERN), library(PATHS[0])
    ids, at = bpe.encode_all(some)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.encode_ordinary(t) for t in some]
    assert bpe.decode_all(ids, at).to_pylist() == [t.encode() for t in some]


def test_neighbours_as_the_merges_have_them(both):
    bpe, _ = both
    rng = random.Random(7)
    entries = list(bpe.ranks)
    pairs = [(rng.choice(entries), rng.choice(entries)) for _ in range(1500)]
    for whole in rng.sample(entries, 1500):
        k = rng.randrange(len(whole))
        pairs += [(whole[:k], whole[k:])] * (whole[:k] in bpe.ranks and whole[k:] in bpe.ranks)
    # Short ones, whose edges meet in many entries.
    short = [x for x in entries if len(x) < 4][:4000]
    pairs += [(rng.choice(short), rng.choice(short)) for _ in range(3000)]
    for a, b in pairs:
        assert bpe.may_follow(bpe.ranks[a], bpe.ranks[b]) == (bpe.merged(a + b)[0] == [bpe.ranks[a], bpe.ranks[b]])


def test_tokens_that_their_bytes_do_not_merge_to():
    """Ranks that no merging has made: parts later than the whole, and an entry that is never reached."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"xyz": 259, b"cd": 260, b"bcd": 261}
    bpe, lib = bytebpe.ByteBPE(ranks, P.PATTERN), tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", "xyz", "aabcbcdab", "bcbcd", "ab cd", "abababcd", "cdcdbcd"):
        assert bpe.encode(text).tolist() == lib.encode_ordinary(text)


def test_memo_tables_stay_bounded():
    bpe = bytebpe.ByteBPE(bytebpe.read_ranks(PATHS[0]), P.PATTERN, memo=50)
    for i in range(300):
        bpe.encode(f"zq{i} xk{i}")
    assert max(map(len, (bpe.chunks, bpe.known, bpe.fits))) <= 50


def test_a_piece_is_held_once():
    """By the table of chunks where it is all of a chunk, else by that of pieces."""
    bpe = bytebpe.ByteBPE(bytebpe.read_ranks(PATHS[0]), P.PATTERN)
    bpe.encode("zqalpha zqbeta, zqgamma")
    assert len(bpe.chunks) == 4 and not bpe.known
    bpe.encode("don't")
    assert bpe.known.keys() == {"don", "'t"}


def test_query_against_the_library(spark, small, texts):
    lib = library(PATHS[0])
    rows = {r["doc_id"]: r for r in queries.op7_byte_bpe(spark, small).collect()}
    for i, text in texts.items():
        ids = lib.encode_ordinary(text)
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(awkward, nothing):
    tokens = bytebpe.encode(awkward, PATHS[0], P.PATTERN)
    assert tokens.count() == awkward.count() and tokens.where("doc_id = 2").first()["ids"] == []
    back = {(r["doc_id"], bytes(r["decoded"])) for r in bytebpe.decode(tokens, PATHS[0], P.PATTERN).collect()}
    assert back == {(r["doc_id"], (r["text"] or "").encode()) for r in awkward.select("doc_id", "text").collect()}
    assert bytebpe.encode(nothing, PATHS[0], P.PATTERN).count() == 0
