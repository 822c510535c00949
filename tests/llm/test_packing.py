from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelens.llm import packing
from pagelens.llm.encoding import ChunkEncoder
from tests.llm.common import TEXTS, documents, empty

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WHOLE = Tokenizer.from_file(JSON)
CHUNKS = ChunkEncoder(JSON, RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n ab1.'sé日\0", "<|endoftext|>"]), max_size=40).map("".join))
def test_chunks_give_the_ids_of_whole_texts(text):
    assert np.frombuffer(CHUNKS.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30)))
def test_plans_fill_windows_and_use_what_is_there(histogram):
    used = Counter()
    for pattern, k in packing.plan(histogram, 64):
        assert sum(pattern) == 64 and k > 0
        for n in pattern:
            used[n] += k
    assert all(used[n] <= histogram.get(n, 0) for n in used)


def test_pieces_rebuild_documents_and_sequences(spark):
    docs = documents(spark, TEXTS + [(100 + i, "word " * (37 * i % 3000)) for i in range(60)])
    rows = packing.pack(docs, JSON, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter(tuple([*WHOLE.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in TEXTS + [(0, "word " * (37 * i % 3000)) for i in range(60)])
    total = sum(len(k) * v for k, v in want.items())
    assert sum(r.length for r in rows) == total
    by_sequence = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append(r)
    open_ = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        open_ += at < packing.WINDOW
    assert open_ <= 1
    single = defaultdict(list)
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 100:
            single[r.doc_id].append(r)
    for i in range(60):
        ids = [v for r in sorted(single[100 + i], key=lambda r: r.start) for v in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*WHOLE.encode("word " * (37 * i % 3000), add_special_tokens=False).ids, 1]


def test_empty_table(spark):
    assert packing.pack(empty(spark), JSON).count() == 0


def test_texts_go_to_tiktoken_whole(monkeypatch):
    text = "one two\nthree don't é日 " * 50 + "end"
    monkeypatch.setattr(type(CHUNKS.chunks), "__missing__", None)  # no chunk is looked up
    assert np.frombuffer(CHUNKS.encode(text.replace("\n", "\nx")), "<u4").tolist() == WHOLE.encode(text.replace("\n", "\nx"), add_special_tokens=False).ids
