import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexisweave.llm.queries import END_ID, tokenizer_path
from lexisweave.llm import token_files as T

TEXTS = [
    None, "", " \n\t", "The cat's hat, it's  THE'RE 'the 'Twas !!'s don't 1234 a1b2", "É é Ünïcödé ñ İstanbul ẞ ΑΣ ς ﬁ", "é ́a à̧  x y　z", "<|startoftext|>a<|endoftext|> <|end x",
    "日本語のテキスト 한국어 ١٢٣ ½ ² x²", "a\x00b \x7f \x1c\x1d\x85q", "👍🏽 family 👨‍👩‍👧", "ſtrange K Ａｂｃ", "x" * 5000, "word " * 3000, "foo_bar(baz) == qux[0];", "'''ss 'S 'LL 've'D''t",
]


def expect(texts):
    library = Tokenizer.from_file(tokenizer_path())
    return [[*library.encode(t or "", add_special_tokens=False).ids, END_ID] for t in texts]


def test_cached_encoder_equals_the_library():
    rnd = random.Random(4)
    letters = "aAbBéÉñ'’-.,!?<|>0 19\n\t́ ſK日ßİ_"
    latin = "abcXYZ \u00c0\u00d6\u00d8\u00de\u00df\u00e0\u00f6\u00f8\u00ff\u00d7\u00f7\u00b5\u00aa\u00ba\u00b2\u00bd\u00a0\x85\x1c\x7f'sS.!0\n"
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choice(latin) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["".join(rnd.choice(latin[:19] + "'s 9,!") for _ in range(40)) for _ in range(1000)]
    encoder = T.WordEncoder(tokenizer_path(), "<u2")
    got = [np.frombuffer(x, "<u2").tolist() + [END_ID] for x in encoder.encode([t.encode() for t in texts])]
    assert got == expect(texts)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = T.WordEncoder(path, "<u2"), Tokenizer.from_file(path)
    assert not encoder.by_word and T.splits_into_words(tokenizer_path())
    texts = [t or "" for t in TEXTS]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_can_be_emptied(monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", 3)
    encoder = T.WordEncoder(tokenizer_path(), "<u4")
    for _ in range(2):
        for t in ("a b c d e f", "a b", "g h a", "a"):
            assert np.frombuffer(encoder.encode([t.encode()])[0], "<u4").tolist() + [END_ID] == expect([t])[0]


@pytest.mark.parametrize("partitions", [1, 5])
def test_files(spark, partitions):
    rows = [(k * 7 % 31, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (3, "and again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, start int, h int")
    files = T.write_token_files(docs, tokenizer_path(), END_ID, partitions=partitions)
    assert files == T.TokenFiles.open(files.folder)
    got = sorted(map(tuple, T.read_token_files(spark, files, with_ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert sorted((str(r[0]), r[4]) for r in got) == sorted((str(i), e) for (i, _), e in zip(rows, expect([t for _, t in rows])))
    start = 0
    for _, s, n, crc, ids in got:
        assert (s, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_empty(spark):
    files = T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), END_ID)
    assert T.read_token_files(spark, files).count() == 0
