import json

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from entailis.llm import bpe
from entailis.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def pair():
    return bpe.ByteBPE(TOKENIZER), Tokenizer.from_file(TOKENIZER)


ODD = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "ñ", "<|endoftext|>", "<|end", "1", "²", "Ⅷ", "'s", "'LL", "_", "-", "😀", "́", "字", "\x00", "İ", ".", "\r\n", "​", "﻿"]


def test_as_the_library_does(pair, documents):
    own, other = pair
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, "thethe" * 500, " " * 900 + "x", "é" * 200, ""]
    texts += [r.text for r in documents.limit(60).collect()]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        ids, expected = np.frombuffer(ids, np.int32).tolist(), other.encode(t, add_special_tokens=False).ids
        assert ids == expected
        assert own.decode(ids) == other.decode(expected, skip_special_tokens=False)


def test_segment_tree_against_rescanning():
    rng = random.Random(5)
    leaves = [rng.randint(0, 9) for _ in range(37)]
    tree = bpe.SegmentTree(leaves[:])
    for _ in range(300):
        assert tree.least() == (min(leaves), leaves.index(min(leaves)))
        i, v = rng.randrange(len(leaves)), rng.randint(0, 9)
        leaves[i] = v
        tree.put(i, v)


def test_one_tree_and_many_trees_agree(pair):
    own, _ = pair
    words = [bytes(random.Random(k).choices(b"theinonra ", k=1 + k % 60)) for k in range(200)]
    for w in words:
        width = 1 << max(1, (len(w) - 1).bit_length())
        assert own._merge_many([w], width)[0] == own._merge_long(w)


def test_cache_is_bounded(pair, monkeypatch):
    own, _ = pair
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    first = own.encode_batch(["one two three four five six seven"])
    assert own.encode_batch(["one two three four five six seven"]) == first and len(own.cache) < 60


def test_frame(spark, docs):
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(docs((1, None), (2, ""), (3, "of the"), (3, "of the"), (None, "x")).withColumnsRenamed({"lang": "ids", "source": "decoded"}), TOKENIZER).collect()}
    assert got[1] == ([], "") == got[2] and got[3][1] == "of the" and got[None][1] == "x"
    assert bpe.encode_decode(docs().limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"decoder": {"type": "Metaspace"}}, {"added_tokens": [{"id": 0, "content": "!", "lstrip": True}]}])
def test_other_vocabularies_are_rejected(tmp_path, change):
    spec = json.loads(open(TOKENIZER, encoding="utf-8").read()) | change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not a plain byte-level BPE"):
        bpe.ByteBPE(str(tmp_path / "t.json"))
