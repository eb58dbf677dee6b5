import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewake.llm import textcore
from tidewake.llm.tokencount import balanced_batches, count_texts, library, safe_parts, size_of, token_counts
from tidewake.llm.tokenids import IdEncoder

ODD = ["  a  b ", "<|endoftext|> foo<|endoftext|>", "a <|endoftext|>   b　 c\x1c d it's 'll  x", " ", "", "ß\n\n a\t b", "é ́a", "x \ny foo\n bar", "foo\n", " foo\n", "word, Word. WORD!! it's.", "a b" * 50, "ab12cd3" * 9, "x'\n's 't1"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_whole_texts_ids(name):
    whole = Tokenizer.from_file(P.path(name))
    encode, split = library(P.path(name))
    encoder = IdEncoder(P.path(name))
    assert split and encoder.by_word == name.startswith("word")

    @settings(max_examples=80, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("ab é\n\t ,.'ßİΣ1<|endoftext|>*　\x1c\x85")), max_size=40), max_size=5))
    def same(texts):
        texts = texts + ODD
        want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
        assert count_texts(encode, split, texts).tolist() == [len(x) for x in want]
        parts = [list(safe_parts(t, 8)) for t in texts]
        assert ["".join(p) for p in parts] == texts
        assert [sum(encode(p), []) for p in parts] == want
        ids, at = encoder.texts([np.frombuffer(t.encode(), np.uint8) for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want

    same()


def test_batches_are_balanced_by_bytes():
    batches = list(balanced_batches(((i, "ß" * 50) for i in range(1000)), limit=5200))
    assert sum(map(len, batches)) == 1000 and all(len(b) == 50 for b in batches)
    mixed = list(balanced_batches(enumerate(["x" * n for n in (10, 9000, 10, 10)]), limit=100))
    assert [[i for i, _ in b] for b in mixed] == [[0], [1], [2, 3]]


@pytest.mark.parametrize("gap", [" ", "\n", "\t", "\n\n"])
def test_long_texts_are_cut_at_all_white_space(gap):
    text = gap.join(["word", "längeres", "x"] * 100_000)
    parts = list(safe_parts(text))
    assert "".join(parts) == text and max(map(size_of, parts)) <= 1 << 16 and len(parts) < 2 * size_of(text) / (1 << 16) + 2
    assert list(safe_parts("x" * 200_000)) == ["x" * 200_000]
    assert max(map(size_of, safe_parts("日本 " * 60_000))) <= 1 << 16


def test_groups_of_texts_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["ab", None, "c" * 100, "d", "", "e" * 9]})
    groups = [(part.num_rows, [len(t) for t in texts]) for part, texts in textcore.text_groups(batch, 0, 10)]
    assert groups == [(2, [2, 0]), (1, [100]), (3, [1, 0, 9])]


def test_token_counts_of_odd_tables(spark):
    long = "word " * 100_000
    df = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (None, None, None), (3, "", "n"), (4, long, "k")], "doc_id long, text string, n_tokens string")
    rows = sorted((tuple(r) for r in token_counts(df, P.path("byte_bpe_50k.json"), limit=2).collect()), key=str)
    assert rows == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 500_000, 100_001, True)], key=str)
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_sentence_pieces_are_counted_whole(spark):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [t for t in ODD if t]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: len(whole.encode(t)) for i, t in enumerate(texts)}


def test_few_bytes_of_texts_are_encoded_at_once():
    """The pipeline's executors ran out of memory in token_files: 4 MB of texts take a worker 130 MB while they are encoded."""
    import numpy as np
    import pyarrow as pa

    from tidewake.llm import tokenfiles

    class Lengths:
        held: list = []

        def texts(self, texts):
            self.held.append(sum(map(len, texts)))
            return np.array([len(t) for t in texts], np.uint32), np.arange(len(texts) + 1)

    sizes = [300_000] * 40 + [3_000_000] + [10] * 5
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["x" * n])], ["k", "t"]) for k, n in enumerate(sizes)]
    rows = [(k, np.frombuffer(ids, "<u4").tolist()) for b in tokenfiles.id_batches(iter(batches), Lengths(), 1, "<u4") for k, ids in zip(*(c.to_pylist() for c in b.columns))]
    assert rows == [(k, [n, 1]) for k, n in enumerate(sizes)]
    assert sorted(Lengths.held)[-2] <= 1 << 20 and max(Lengths.held) == 3_000_000
