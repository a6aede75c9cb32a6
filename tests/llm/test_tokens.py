"""Token counts, token files and SentencePiece chunks, against the libraries."""

import hashlib
import struct
import zlib

import duckdb
import pytest

from marlstone.llm import sentencepieces, token_counts, token_files
from marlstone.llm.queries import tokenizer_file
from marlstone.llm.shared import new_path

from .helpers import awkward, nothing, rows_of, texts_of

ODD = ["  ", " a", "a ", "a  b", "\n", "\n\n a", " \n b", "▁a b▁ ▁", "x\x01y  z", "\x00", "日本 語 🙂", "a\tb\r\n c", "Ａ①", "it's <|endoftext|> I'LL", "éé ́x", " a", "a b", "\x85x", "q\x00\x02\x00z \x01"]
ODD += ["a.b. c, d.", "İstanbul ŉx abc", "ABC <|ENDOFTEXT|> d", "x., y.. z! q", "ﬁne Σας ǅ é", "가 각", "🙂🙂x🙂", "xx x", "a$$$ it's!! a's$ b'!! c$'s d  e'$ ''s' 3.$ é́$ ß%% ÷, ª! x'll. "]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()]
    rows = list(enumerate(ODD + texts, 100))
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward(spark).select("doc_id", "text"))
    return both.repartition(5), texts_of(both)


def test_sentencepiece(spark, corpus):
    import sentencepiece

    docs, rows = corpus
    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for d, t in rows:
        ids = model.encode(t or "") + [model.eos_id()]
        expected.append((d, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    found = sentencepieces.digests(sentencepieces.encode_decode(docs, path))
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert sentencepieces.encode_decode(nothing(spark), path).collect() == []


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    docs, rows = corpus
    pieces = token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    least = min(s for _, s in pieces)
    tokenizer = Tokenizer(models.Unigram([("<unk>", least), *pieces, *((f"<0x{i:02X}>", least) for i in range(256))], 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = [(d, t) for d, t in rows if len(t or "") < 100_000]  # the library's own time grows faster than a text
    expected = sorted(((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=repr)
    found = token_counts.token_counts(docs.filter("text IS NULL OR length(text) < 100000"), tokenizer_file("piece_bpe_32k.model"))
    assert rows_of(found, "doc_id", "n_tokens") == expected
    assert token_counts.token_counts(awkward(spark), tokenizer_file("piece_bpe_32k.model")).count() == awkward(spark).count()
    assert token_counts.token_counts(nothing(spark), tokenizer_file("piece_bpe_32k.model")).collect() == []


def test_ties_go_to_the_longest_piece():
    model = token_counts.Unigram([("▁", -1.0), ("▁a", -2.0), ("a", -1.0), ("ab", -3.0), ("b", -2.0), ("▁ab", -4.0)])
    assert model.count("▁ab") == 1
    assert model.count("▁é") == 1 + 2


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    docs, rows = corpus
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    docs = docs.filter("doc_id IS NOT NULL")
    path, out = tokenizer_file("word_bpe_49k.json"), new_path(spark, "token-test")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_tokens(docs, out, path, end_id=1, parts=4)
    found = token_files.with_crc32(token_files.read_tokens(spark, out)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [d for d, _ in rows]
    expected = {}
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        expected.setdefault(d, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    start = 0
    for r in found:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in expected[r.doc_id]
        start += r.n_tokens


def test_token_files_can_be_read_in_part(spark, corpus):
    import pyarrow.parquet as pq

    out = new_path(spark, "token-part")
    token_files.write_tokens(corpus[0], out, tokenizer_file("word_bpe_49k.json"), end_id=1, parts=2)
    from pathlib import Path

    meta = pq.ParquetFile(next(Path(out.removeprefix("file://")).glob("*.parquet"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert any("DICTIONARY" in e for e in columns[next(c for c in columns if c.startswith("ids"))].encodings)
    plan = token_files.read_tokens(spark, out).filter("doc_id = 105").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "EqualTo(doc_id,105)" in plan


def test_token_files_of_nothing(spark):
    out = new_path(spark, "token-none")
    token_files.write_tokens(nothing(spark), out, tokenizer_file("word_bpe_49k.json"), end_id=1)
    assert token_files.with_crc32(token_files.read_tokens(spark, out)).collect() == []
