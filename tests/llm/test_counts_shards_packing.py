import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from kredenz.llm.packing import pack, packed
from kredenz.llm.queries import vocabulary
from kredenz.llm.shards import Permutation, assign_shards, row_at
from kredenz.llm.token_counts import count_texts, token_counts
from tests.llm.fixtures import awkward_documents, documents

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def test_token_counts_equal_whole_text_encoding(spark):
    whole = Tokenizer.from_file(BYTES)
    got = Counter(tuple(r) for r in token_counts(documents(spark), BYTES, 512).collect())
    want = Counter()
    for doc_id, text, *_ in awkward_documents():
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, len((text or "").encode()), n, n > 512] += 1
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé .,;!?'s\n\t  \u0085\x1c09中<|endoftext|>«—") | st.characters(codec="utf-8"), max_size=60))
def test_any_text_counts_as_the_library(text):
    import pyarrow as pa

    whole = whole_bytes()
    assert count_texts(whole, pa.array([text, ""])).tolist() == [len(whole.encode(text, add_special_tokens=False).ids), 0]


_kept = {}


def whole_bytes():
    if not _kept:
        _kept["b"], _kept["w"] = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    return _kept["b"]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation_is_a_bijection(n):
    import numpy as np

    order = Permutation(n, 7)
    places = order.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert order.row(places).tolist() == list(range(n))


def test_shards_are_even_and_gapless(spark):
    rows = awkward_documents()
    got = assign_shards(documents(spark), 4, seed=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
        assert row_at(len(rows), 4, 3, r.shard, r.slot) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
    assert [key(r) for r in sorted(got, key=lambda r: r.row_number)] == sorted(map(key, got))
    again = assign_shards(documents(spark).repartition(2), 4, seed=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts(none, BYTES).count() == assign_shards(none).count() == packed(none, WORDS).count() == 0


def test_pieces_hold_every_id_once(spark):
    whole = Tokenizer.from_file(WORDS)
    rows = awkward_documents()
    got = packed(documents(spark), WORDS, 256, 1).collect()
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, []).append([*whole.encode(text or "", add_special_tokens=False).ids, 1])
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        raw = b"".join(x.to_bytes(4, "little") for x in r.ids)
        assert len(r.ids) == r.length and zlib.crc32(raw) == r.ids_crc32
    for doc_id, pieces in by_doc.items():
        own = ids[doc_id]
        assert sum(p.length for p in pieces) == sum(map(len, own))
        assert {p.doc_tokens for p in pieces} == set(map(len, own))
        for p in pieces:
            assert any(list(p.ids) == x[p.start : p.start + p.length] for x in own)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert set(by_doc) == set(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_packing_wastes_less_than_one_sequence(sizes):
    pieces = pack(sizes, 16)
    taken, seen = Counter(), defaultdict(int)
    for k, start, length, sequence in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == seen[k] and length > 0
        seen[k] += length
        taken[sequence] += length
    assert [seen[k] for k in range(len(sizes))] == sizes
    assert all(n <= 16 for n in taken.values()) and len(taken) * 16 - sum(sizes) < 16


def test_costs_are_balanced():
    sizes = [7] * 50 + [3] * 50
    pieces = pack(sizes, 20)
    per = defaultdict(list)
    for _, _, length, s in pieces:
        per[s].append(length)
    assert max(sum(x) for x in per.values()) <= 20 and len(per) == 25


def test_ids_are_put_together_in_little_memory():
    """Wide numbers are held for some words at a time: under 24 bytes for each id, where 33 were taken."""
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from kredenz.llm import packing

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    closes = np.zeros(tokenizer.get_vocab_size(), bool)
    closes[[i for word, i in tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
    dice = random.Random(5)
    some = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(4, 14))) for _ in range(500)]
    texts = pa.array([" ".join(dice.choices(some, k=2_000)) for _ in range(400)])
    tracemalloc.start()
    ids, begins = packing.tokenize(tokenizer, closes, texts, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(len(ids), peak / len(ids))
    assert peak < 24 * len(ids)
    k = 123
    assert ids[begins[k] : begins[k + 1]].tolist() == [*tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, 1]
