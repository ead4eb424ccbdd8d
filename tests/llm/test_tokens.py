"""Ids of texts against the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilspark.llm._tokens import Encoder
from veilspark.llm.queries import _path

PARTS = ["word", "Word's", "don't", "I'll", "'s", "naïve", "É", "é", "汉字", "abc123", "12", ".", "...", "-", "(x)", "a.b", "$5", "<|endoftext|>", "<|startoftext|>", "<|", " ", "　", "😀", "ſ", "İ", "ﬁ", "\x00", "\x85"]
GAPS = [" ", " ", " ", " ", "\n", "\n\n", "\n\n\n", "  ", " \n", "\n ", "\t", ""]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("ordinary", [False, True])
def test_ids(rows, name, spaces, ordinary):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) + rng.choice(GAPS) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += [t.strip() for t in texts] + ["", " ", "\n", "a\n", "\na", "a\n\nb", "a \n b"] + [t or "" for _, t, *_ in rows if not t or len(t) < 50_000]
    own = Encoder(_path(name), spaces, ordinary)
    library = Tokenizer.from_file(_path(name))
    library.encode_special_tokens = ordinary
    for text, ids in zip(texts, own.ids(texts)):
        assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
