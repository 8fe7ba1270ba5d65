import hashlib
import os
import random

import numpy as np
import pytest

from timberline.llm import bpe
from timberline.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
LETTERS = list("ab 'stre \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​́é漢😀١²½Ⅷ<|>.,! 0123") + ["<|endoftext|>", "'ll", "  "]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, 40))) for _ in range(1500)] + [
        "", " ", "x" * 5000, "ab" * 999, " " * 300, "a" * 64, "b" * 63, "".join(rng.choices("abcdefgh", k=20_000)), "<|endoftext|>" * 3
    ]


def test_ids_and_text_as_the_library_has_them():
    own, lib, ts = bpe.vocabulary(PATH), reference(), texts()
    for text, ids in zip(ts, own.encode(ts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    assert own.decode(np.array([220, 127, 100], "<u4").tobytes()) == lib.decode([220, 127, 100], skip_special_tokens=False)


def test_both_trees_agree():
    own, rng = bpe.vocabulary(PATH), random.Random(2)
    items = ["".join(rng.choices("etaoin shrdlu", k=rng.randint(1, 63))).encode() for _ in range(300)]
    assert own.merge_many(items) == [own.merge_long(i) for i in items]


def test_nulls_repeats_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "hello", 9), (1, "hello", 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(df, PATH).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    assert all((r.ids_sha256 == nothing) == (r.n_tokens == 0) for r in got)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert back == {1: "hello", 2: "", None: ""}
