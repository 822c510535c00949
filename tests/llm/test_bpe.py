from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import bpe
from tests.llm.common import TEXTS, documents, empty

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODING = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_round_trip_and_ids_of_whole_texts(spark):
    rows = bpe.decode(bpe.encode(documents(spark), PATH, public_tokenizers.PATTERN), PATH).collect()
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in rows)
    want = Counter((i, tuple(ENCODING.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert got == want


def test_empty_table(spark):
    assert bpe.encode(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \t\n ab1.'sé日\0")), max_size=40))
def test_blocks_split_as_the_pattern_does(text):
    import regex

    block = bpe._Block(regex.compile(public_tokenizers.PATTERN))
    block.add(0, text)
    words = list(block.words)
    assert [words[i] for i in np.frombuffer(block.texts[0], "<u4")] == regex.findall(public_tokenizers.PATTERN, text)
