"""Properties on generated texts."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colbrook.llm import chat_tree, html_crf, queries, simhash, sp_unigram, token_count

LETTERS = st.text(alphabet=st.sampled_from("ab<|>\\\n im_endstart é漢 '12\t"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(LETTERS, LETTERS), max_size=5))
def test_formatted_turns_read_back(turns):
    whole = "".join(chat_tree.render(r, t)[0] for r, t in turns)
    back = [(chat_tree.unescape(chat_tree._ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], r)), chat_tree.unescape(t)) for r, t in chat_tree._TURN.findall(whole)]
    assert back == turns
    assert whole.count(chat_tree.START) == whole.count(chat_tree.END) == len(turns)


_BPE = token_count.Counter(token_count.Vocabulary(open(queries.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read()))
_PIECES = sp_unigram.Encoder(sp_unigram.PieceModel(open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_token_counts_equal_the_library(text):
    from tokenizers import Tokenizer

    library = test_token_counts_equal_the_library.__dict__.setdefault("library", Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")))
    assert _BPE.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_pieces_decode_to_the_text(text):
    ids = np.frombuffer(_PIECES.encode(text), "<i4").tolist()
    assert _PIECES.model.decode(ids) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/pdivb \"'=a!-&;scriptx\n"), max_size=80))
def test_any_page_parses(page):
    blocks = html_crf.leaf_blocks(page)
    assert all(b[0] and b[0] == b[0].strip(" ") for b in blocks) and len(html_crf.features(blocks)) == len(blocks)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 40))
def test_tree_search_equals_a_scan(values, radius):
    v = np.unique(np.array(values, np.uint64)).reshape(-1, 1)
    shard = np.zeros(len(v), np.int64)
    found = {(int(a), int(b)) for q, x in simhash.BKForest(v, shard).search(v, shard, radius) for a, b in zip(q, x)}
    assert found == {(i, j) for i in range(len(v)) for j in range(len(v)) if int(v[i, 0] ^ v[j, 0]).bit_count() <= radius}
