import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Known

from gleanery.llm.bpe import Tokenizer, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "Hello world", "it's  the\n\n end \t x", "a" * 3000, "ab" * 2000 + " " + "é" * 500, "<|endoftext|> a<|endoftext|><|endoft", "été ça va ?\x1c\x1f\x85", "日本語🙂 ١٢٣ ½", "1234 5678!?...", "don't I'LL we've", " 　​ x "]


@pytest.fixture(scope="module")
def both():
    return Tokenizer(PATH), Known.from_file(PATH)


def test_against_the_library(both):
    ours, known = both
    rng = random.Random(4)
    chars = [chr(c) for c in (*range(32, 127), *range(160, 700), 0x3042, 0x4E00, 0x1F600, 0x300, 0x200D, 9, 10, 13, 0x1C, 0x85, 0x2028)]
    texts = TEXTS + ["".join(rng.choices(chars, k=rng.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == known.encode(t, add_special_tokens=False).ids, t
        assert ours.decode(ids) == known.decode(ids, skip_special_tokens=False) == "".join(ours.encoded(t)[1])


def test_heap_equals_scan(both):
    ours, _ = both
    for w in (b"the" * 40, b"x" * 120, "éàü".encode() * 20, b"abcabcaab" * 13):
        assert ours._merge_long(w) == ours.merge(w)


def test_small_cache(both):
    t = Tokenizer(PATH, most=3)
    assert [t.encode(x) for x in TEXTS] == [both[0].encode(x) for x in TEXTS]


def test_table(spark, both):
    rows = list(enumerate([*TEXTS, None, *TEXTS]))
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, ids int, n_tokens string")
    for r in encode_decode(df, PATH, digests=True).collect():
        e = both[1].encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
    full = {r.doc_id: (r.ids, r.decoded) for r in encode_decode(df, PATH).collect()}
    assert full[2] == (both[1].encode("Hello world").ids, "Hello world") and full[len(TEXTS)] == ([], "")
    assert encode_decode(df.limit(0), PATH).count() == 0
