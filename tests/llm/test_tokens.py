import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = ["", "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|><|endoftext|>x", "  \n\n a", "it's'll 'S x² ½ ", "日本語 テスト　 a b", "a" * 3000, "՘b1 \U0001e6c0c 👩‍🔬", "x\u0085y z", "don't stop  ", "<|endof text|>"]
SCHEMA = "doc_id long, text string, n_tokens string, lang string"


def expected(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", CASES)
def test_count_equals_library(text):
    assert tokens.merger(PATH).count(text) == expected(text)


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(CASES)] + [(50, None, None, None), (51, "again", "x", "y"), (51, "again", "x", "y"), (None, "no id", None, None)]
    found = tokens.count_tokens(spark.createDataFrame(rows, SCHEMA), PATH, limit=4)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := expected(t), n > 4) for i, t, _, _ in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect()) == want


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_whole_small_table_equals_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    ids = Tokenizer.from_file(PATH).encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert found == {r.doc_id: len(e.ids) for r, e in zip(rows, ids)}


def test_every_vocabulary_entry_is_one_token():
    tool = tokens.merger(PATH)
    back = {s: b for b, s in enumerate(tokens.byte_symbols())}
    assert all(tool.merged(bytes(back[c] for c in word)) == 1 for word in list(Tokenizer.from_file(PATH).get_vocab())[::97] if word != "<|endoftext|>")


def test_latin_split_equals_published_pattern():
    split = tokens.Splitter([], PATH)
    for c in map(chr, range(0x250)):
        text = f"a{c}1{c}!{c} {c}  {c}'s{c}'{c}'ll {c}{c} '{c}"
        assert split.latin.findall(text) == split.plain.findall(text)
