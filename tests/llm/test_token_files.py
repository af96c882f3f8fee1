"""Token files against the tokenizers library, and the range coder against round trips, damage and zlib."""

import random
import zlib

import numpy as np
import pytest

from touchline.llm import token_files
from touchline.llm.queries import END_ID, vocabulary
from touchline.llm.range_coder import ID_LIMIT, decode_block, encode_block


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 513, 4000, 70_001])
@pytest.mark.parametrize("spread", [1, 40, 50_000, ID_LIMIT])
def test_blocks_round_trip(n, spread):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, spread, n), np.sort(rng.integers(0, spread, n)), np.minimum(rng.zipf(1.3, n), spread) - 1, np.tile(rng.integers(0, spread, 7), n // 7 + 1)[:n]):
        found = decode_block(encode_block(ids), n)
        assert found.dtype == np.uint32 and (found == ids).all()


def test_ids_out_of_range_are_refused():
    for bad in (-1, ID_LIMIT):
        with pytest.raises(ValueError):
            encode_block(np.array([3, bad]))


def test_fewer_bytes_than_zlib():
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 4000, rng.integers(1, 4)) for _ in range(3000)]
    ids = np.concatenate([words[i % 3000] for i in rng.zipf(1.2, 200_000)])
    assert len(encode_block(ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_all_orders_are_used():
    """A period of three letters with a common first one: order 1 cannot tell what follows it, order 2 can."""
    ids = np.tile([0, 1, 0, 2, 0, 3], 20_000)
    assert len(encode_block(ids)) * 8 < 0.3 * len(ids)


def mixed_texts():
    rng = random.Random(4)
    letters = "abzAZéÉßÀø .,'!?;:*$%&#0123\n\t\u00a0\u0301ẞİΣσſ中<|>_-/@\x1c\x85"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(2000)]
    return odd + ["don't it's", "<|endoftext|> x<|startoftext|>y", None, "", " ", "Straße, NAÏVE!! straße", "word " * 9000, "x" * 5000]


def write(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(3)
    return token_files.write_tokens(docs, vocabulary(), END_ID, **options)


def test_equals_the_library_on_whole_texts(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = mixed_texts()
    rows = [(i * 7, t, 1, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in token_files.read_tokens(write(spark, rows)).collect()}
    at = 0
    for i, _, *_ in rows:
        ids = np.array([*plain.encode(texts[i // 7] or "", add_special_tokens=False).ids, END_ID], "<u4")
        assert (got[i].start, got[i].n_tokens, zlib.crc32(bytes(got[i].ids))) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_other_vocabularies_take_whole_texts(tmp_path):
    """A file with another pre-tokeniser is not cut at white space."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    known = json.loads(Tokenizer.from_file(vocabulary()).to_str())
    known["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(known))
    other = token_files.TextTokenizer(str(tmp_path / "other.json"))
    assert other.words is None
    ids, n = other.encode(pa.array(["two words", None]), END_ID)
    assert ids.tolist() == [*other.tokenizer.encode("two words", add_special_tokens=False).ids, END_ID, END_ID] and n.tolist() == [len(ids) - 1, 1]


def test_words_that_share_a_hash(monkeypatch):
    import pyarrow as pa

    real = token_files.hash_words
    monkeypatch.setattr(token_files, "hash_words", lambda raw, a, b, seed: real(raw, a, b, seed) % np.uint64(50) if seed < 3 else real(raw, a, b, seed))
    shared = token_files.TextTokenizer(vocabulary())
    texts = pa.array(mixed_texts())
    got = shared.encode(texts, END_ID)
    monkeypatch.undo()
    want = token_files.TextTokenizer(vocabulary()).encode(texts, END_ID)
    assert shared.words.seed == 3 and all((x == y).all() for x, y in zip(got, want, strict=True))


def test_forgetting_changes_nothing(monkeypatch):
    import pyarrow as pa

    texts = pa.array(mixed_texts())
    want = token_files.TextTokenizer(vocabulary()).encode(texts, END_ID)[0]
    monkeypatch.setattr(token_files, "REMEMBERED", 100)
    forgetful = token_files.TextTokenizer(vocabulary())
    got = np.concatenate([forgetful.encode(texts.slice(i, 300), END_ID)[0] for i in range(0, len(texts), 300)])
    assert got.tolist() == want.tolist()


def test_repeated_and_null_ids(spark):
    rows = [(None, "a", 1, "x"), (5, "b", 1, "x"), (5, "b b", 1, "x"), (-3, None, 1, "x"), (None, "a a", 1, "x")]
    got = token_files.read_tokens(write(spark, rows)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]


def test_empty_table(spark):
    assert token_files.read_tokens(write(spark, [])).count() == 0


def test_damage_is_found(spark, tmp_path):
    manifest = write(spark, [(i, f"some words {i} more", 1, "x") for i in range(200)], folder=str(tmp_path))
    assert token_files.read_tokens(manifest).count() == 200
    path = max(tmp_path.glob("*.ids"), key=lambda p: p.stat().st_size)
    whole = path.read_bytes()
    for place in (8, 30, len(whole) // 2, len(whole) - 30):
        path.write_bytes(whole[:place] + bytes([whole[place] ^ 0x55]) + whole[place + 1 :])
        with pytest.raises(Exception, match="damaged"):
            token_files.read_tokens(manifest).count()
