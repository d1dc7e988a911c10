import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import queries, repair

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.sampled_from([6, 70_000]))
def test_blocks_round_trip(docs, base):
    ids = [np.array([*d, 1], np.uint32) for d in docs]
    row = repair.pack(list(range(len(ids))), ids, base, least=2)
    block = repair.Block(row)
    for i, want in enumerate(ids):
        assert block.document(i).tolist() == want.tolist()
        for a in range(0, len(want), 7):
            assert block.ids_of(i, a, min(a + 5, len(want))).tolist() == want[a : a + 5].tolist()
    for (a, b), n in zip(block.rules.tolist(), block.lengths.tolist(), strict=True):
        assert n == sum(block.lengths[s - base] if s >= base else 1 for s in (a, b))


def test_repetition_shrinks():
    row = repair.pack([0], [np.array([3, 4, 5, 6] * 1000 + [1], np.uint32)], 10)
    assert len(row["symbols"]) + len(row["rules"]) < 200


def test_words_as_the_tokenizer_has_them(texts):
    words, whole = repair.WordIds(PATH), Tokenizer.from_file(PATH)
    odd = ["İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ J̌a it's they'RE <|endoftext|>a é́ 12a3 ½ ²x Ⅷ ﬁ ªº naïve\x1cfoo a\x85b 　c ١٢ 한국어 日本語 ''S a_b.", "J̌ X. <|endoftext|>", "", "  ", "ÀÉ. ÄÖ, A. B", "!!! a.b,c -- d"]
    for text in [*odd, *list(texts.values())[:200], "x" * 500]:
        assert words.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def assert_as_the_library(texts):
    words = repair.words_of(PATH)
    ids, at = words.encode_all(texts)
    for text, a, b, want in zip(texts, at[:-1], at[1:], words.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == want.ids, repr(text)


#: Characters that composing or lowering changes, that may compose with another, and marks of many kinds.
CHANGED = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x10400, 0x10450), *range(0x1D160, 0x1D170)]) if unicodedata.normalize("NFC", c) != c or c.lower() != c or unicodedata.category(c) in ("Mc", "Lm", "Nl", "No")]
JOINING = "\u0300\u0307\u0323\u0338\u0345\u05bc\u09be\u1161\u11a8\u3099\u200d\ufe0f\x85\xa0\u2028\x1c\x00_'\u2019\u00b7\u2026-,.!"


def test_words_of_characters_that_change():
    assert len(CHANGED) > 2000
    assert_as_the_library([f"x {c}, y{c}.{c}z {c}'s" for c in CHANGED])
    assert_as_the_library([f"{c}{j}. a{j}{c}" for c in CHANGED[::7] for j in JOINING])
    assert_as_the_library([f"x{a}{b}y ,{a},{b}" for a in JOINING for b in JOINING])
    assert_as_the_library(["x İ, y", "İ.Ö. 300", "क़. x", "फ़!", "בּ בּ,", "ΌΣ. ΟΣ, ΣΑΣ", "\u1112\u1161\u11ab. \ud55c\u11ab,"])


MIXED = st.text(st.one_of(st.sampled_from("abzAZ019 \n\t" + JOINING), st.sampled_from(CHANGED), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=8))
def test_words_of_any_text(texts):
    assert_as_the_library(texts)


def test_the_table_of_words_may_be_emptied_at_any_time(texts):
    words, whole = repair.WordIds(PATH, most=50), Tokenizer.from_file(PATH)
    some = [*list(texts.values())[:40], "y" * 500, "", " \n"]
    for i in range(0, len(some), 5):
        ids, at = words.encode_all(some[i : i + 5])
        for text, a, b in zip(some[i : i + 5], at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_rules_go_on_beyond_16_bits():
    ids = np.tile(np.arange(300, dtype=np.uint32), 60)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    rules, symbols, last = repair.compress(ids, ends, (1 << 16) - 20, least=2)
    assert len(rules) > 20 and symbols.dtype == np.uint32 and last[-1]
    row = repair.pack([0], [np.append(ids, 1)], (1 << 16) - 20, least=2)
    assert row["wide"] and repair.Block(row).document(0).tolist() == [*ids.tolist(), 1]


def test_query_against_brute_force(spark, small, texts):
    whole, start = Tokenizer.from_file(PATH), 0
    rows = {r["doc_id"]: r for r in queries.op2_token_ids(spark, small).collect()}
    for i in sorted(texts):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_awkward_rows_and_random_access(spark, awkward, nothing, tmp_path):
    path = f"file://{tmp_path}/a"
    repair.write_ids(awkward, path, PATH, block_ids=1000)
    rows = repair.read_ids(spark, path).orderBy("start").collect()
    assert len(rows) == awkward.count() and [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert rows[4]["n_tokens"] == 1 and [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
    long = np.frombuffer(next(r["ids"] for r in rows if r["doc_id"] == 5), "<u4").tolist()
    assert repair.read_document(spark, path, 5, 29_000, 29_010) == long[29_000:29_010]
    assert repair.read_document(spark, path, 2) == [1]
    with pytest.raises(KeyError):
        repair.read_document(spark, path, 99)
    repair.write_ids(nothing, f"{path}2", PATH)
    assert repair.read_ids(spark, f"{path}2").count() == 0
