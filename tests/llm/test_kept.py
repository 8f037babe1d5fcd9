"""Nothing is lost by rule: texts that share an id, many languages, offsets in the text itself, empty pipelines."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quirewise.llm import bpe, langid, near, packing, toxicity

A = "the first text tells of rivers and of mountains and of the long way between them in the cold of an early year"
B = "a second one is about bread and how it is baked by people who get up long before anyone else has even thought of it"
SCHEMA = "doc_id bigint, text string, lang string, _near_id string, id string, m string, node string, row string, n string"


def _kept(spark, rows):
    df = spark.createDataFrame([(i, t, x, "a", "b", "c", "d", "e", "f") for i, t, x in rows], SCHEMA)
    got = near.one_of_each(df)
    assert got.columns == df.columns
    return sorted((r.doc_id, r.text, r.lang) for r in got.collect())


def test_unlike_texts_of_one_id_stay(spark):
    assert _kept(spark, [(1, A, "x"), (1, B, "y")]) == sorted([(1, A, "x"), (1, B, "y")])
    rows = [(1, A, "x"), (1, B, "y"), (5, A + " indeed", "z"), (0, B, "w"), (7, A, "v")]
    assert _kept(spark, rows) == sorted([(1, A, "x"), (0, B, "w")])


def test_of_repeated_rows_one_stays_in_a_fixed_order(spark):
    rows = [(3, A, "x"), (3, A, "y"), (3, A, "x"), (4, A, "a"), (9, "", "e"), (8, None, "n"), (8, "", "m")]
    first = _kept(spark, rows)
    assert first == _kept(spark, rows[::-1]) and [r[0] for r in first] == [3, 8]


def test_many_copies_under_many_ids(spark):
    rows = [(i % 5, (A, B)[i % 2], None) for i in range(40)]
    assert _kept(spark, rows) == sorted([(0, A, None), (0, B, None)])


def test_passages_lie_where_the_text_has_them():
    text = "İİ İstanbul ǰ very bad İ word"
    words = [text[a:b] for a, b in toxicity.spans(text)]
    assert words[-4:] == ["very", "bad", "İ", "word"] and len(words) == len(toxicity.letters(text.lower()))
    assert [("plain words" + "")[a:b] for a, b in toxicity.spans("plain words")] == ["plain", "words"]


def test_two_hundred_languages():
    source = np.random.default_rng(5)
    n, each = 200, 6
    centre = source.dirichlet(np.full(langid.FEATURES, 0.02), n)
    rows = np.sqrt(source.multinomial(400, centre.repeat(each, 0)))
    rows = rows / np.linalg.norm(rows, axis=1)[:, None]
    lang = np.arange(n).repeat(each)
    train = np.arange(len(lang)) % each != 0
    model = langid.fit_rows([f"l{i:03}" for i in range(n)], rows[train].astype(np.float16), lang[train], rounds=60)
    right = [model.decode(x)[0] == f"l{k:03}" for x, k in zip(rows[~train], lang[~train])]
    assert np.mean(right) > 0.95
    code = langid.codes(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 20


def test_sequences_read_back_to_the_texts(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(0, "another text under the same id"), (None, "no id"), (None, None), (7, "again"), (7, "again"), (-1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = packing.tokens(spark, ranks, public_tokenizers.PATTERN, len(ranks))
    coded = df.select("doc_id", "text", ids("text").alias("ids")).cache()
    places = packing.packed(coded, {64: 70.0, 512: 520.0}, shard_rows=50, length=F.octet_length("ids") / 4).cache()
    whole = {r.bin: r for r in packing.sequences(places, coded).collect()}
    back = {}
    for r in places.collect():
        sequence = np.frombuffer(whole[r.bin].ids, "<u4")
        assert len(sequence) == r.bin_tokens <= r.bin_length == whole[r.bin].bin_length
        back.setdefault((r.doc_id, r.text_hash), []).append((r.start, sequence[r.bin_offset : r.bin_offset + r.n_tokens].tolist()))
    texts = []
    for (doc_id, _), pieces in back.items():
        copies = sum(start == 0 for start, _ in pieces)
        line = [t for start, part in sorted(pieces)[::copies] for t in part]
        assert line[-1] == len(ranks) and len(ranks) not in line[:-1]
        texts += [(doc_id, own.decode(np.array(line[:-1], "<u4").tobytes()).decode())] * copies
    assert sorted(texts, key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert packing.sequences(places.limit(0), coded).count() == 0


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join([letters[(i % 13) * 2 : (i % 13) * 2 + 2] * 2] * 30), f"l{i % 13}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == sorted({f"l{i}" for i in range(13)})


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert near.one_of_each(documents.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_texts_are_encoded_and_decoded_by_one_worker(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TEXT", 50)
    texts = [None, "", "plain words", "<|endoftext|> ünï  \n\n 42", "x" * 3000, B, "퟿\U0001f600"] * 3
    docs = spark.createDataFrame([(f"d{i}", t, "clash") for i, t in enumerate(texts)], "doc_id string, text string, ids string")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = bpe.coded(docs, ranks, public_tokenizers.PATTERN)
    plan = got.select(F.sha2("ids", 256), F.sha2("decoded", 256))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    encode, _ = bpe.codec(spark, ranks, public_tokenizers.PATTERN)
    ids = {r.doc_id: r.ids for r in docs.select("doc_id", encode("text").alias("ids")).collect()}
    rows = got.collect()
    assert {r.doc_id: r.ids for r in rows} == ids and len(rows) == len(texts)
    assert all(r.decoded.decode() == (texts[int(r.doc_id[1:])] or "") for r in rows)


def test_byte_bpe_query_has_one_python_step(spark):
    from quirewise.llm import queries

    plan = queries.op3_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
