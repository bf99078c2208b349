import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm.tokens import count_tokens, load_counter, op2_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_those_of_the_library(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 512)


def test_odd_texts(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    docs = odd_documents(spark, ["a <|endoftext|> b<|endoftext|><|endoftext", "don't we'll  \n\t  x", "123 4567 ...!!", "z" * 3000 + " " * 3000])
    got = count_tokens(docs.drop("n_tokens"), PATH).select("text", "n_tokens").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"][:40]
    assert op2_token_counts(spark, write_tables(tmp_path / "a", documents=docs.limit(0))).count() == 0


def test_proven_strings_are_one_token_alone():
    library, counter = Tokenizer.from_file(PATH), load_counter(PATH)
    some = sorted(counter.proven)[::997]
    assert len(counter.proven) > 40_000
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in some)
