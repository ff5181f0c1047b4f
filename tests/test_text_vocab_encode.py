"""Golden values of FIXTURES.md for text, word index and encoding."""

from pyspark.sql import functions as F

from sievetext.functions.text import normalize, tokenize
from sievetext.operators.encode import decode_ids, encode_capped, encode_fixed, pad_left
from sievetext.operators.vocab import frequency_index, token_counts, vocabulary, word_index


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def test_normalize_and_tokenize(spark):
    df = _docs(spark, ["  Hello, World!  ", "it's  a test\tnow", "?!", ""])
    got = df.select(normalize("text").alias("n"), tokenize("text").alias("t")).collect()
    assert [r.n for r in got] == ["hello world", "its  a test\tnow", "", ""]
    assert [r.t for r in got] == [["hello", "world"], ["its", "a", "test", "now"], [], []]


def test_treebank_rules(spark):
    df = _docs(spark, ["I cannot go, gonna stay", "wanna"])
    got = [r.t for r in df.select(tokenize("text", "treebank").alias("t")).collect()]
    assert got == [["i", "can", "not", "go", "gon", "na", "stay"], ["wan", "na"]]


def _index(spark):
    train = _docs(spark, ["Hello, World!", "a world"]).select("id", tokenize("text").alias("tokens"))
    return word_index(vocabulary(train))


def test_word_index_fixture(spark):
    idx = {r.token: r.id for r in _index(spark).collect()}
    assert idx == {"<PAD>": 0, "<START>": 1, "<END>": 2, "<UNK>": 3, "a": 4, "hello": 5, "world": 6}


def test_encode_fixed_fixture(spark):
    texts = ["Hello, World!", "hello new world", "a a a a", "a a a a a a", "", "?!"]
    df = _docs(spark, texts).select("id", tokenize("text").alias("tokens"))
    enc = {r.id: r.ids for r in encode_fixed(df, _index(spark), 6).collect()}
    assert [enc[i] for i in range(6)] == [
        [1, 5, 6, 2, 0, 0], [1, 5, 3, 6, 2, 0], [1, 4, 4, 4, 4, 2],
        [1, 4, 4, 4, 4, 2], [1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 0, 0]]


def test_encode_properties_and_decode(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("id"), tokenize("text").alias("tokens"))
    idx = word_index(vocabulary(df))
    enc = encode_fixed(df, idx, 16)
    rows = enc.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert len(r.ids) == 16 and r.ids[0] == 1 and r.ids.count(2) == 1
    dec = {r.id: r.tokens for r in decode_ids(enc, idx).collect()}
    src = {r.id: r.tokens for r in df.collect()}
    for i, toks in dec.items():
        body = toks[1:toks.index("<END>")]
        assert body == src[i][:14]


def test_pad_left_fixture(spark):
    df = spark.createDataFrame([([7, 8],), ([1, 2, 3, 4, 5],), ([],)], "x array<long>")
    got = [r.p for r in df.select(pad_left("x", 4).alias("p")).collect()]
    assert got == [[0, 0, 7, 8], [2, 3, 4, 5], [0, 0, 0, 0]]


def test_encode_capped_keras_rules(spark):
    train = _docs(spark, ["b b b a a c"]).select("id", tokenize("text").alias("tokens"))
    findex = frequency_index(token_counts(train), specials=())
    ids = {r.token: r.id for r in findex.collect()}
    assert ids == {"b": 4, "a": 5, "c": 6}
    docs = _docs(spark, ["a b c", "c c c c c"]).select("id", tokenize("text").alias("tokens"))
    got = {r.id: r.ids for r in encode_capped(docs, findex, num_words=6, max_len=5).collect()}
    assert got[0] == [0, 1, 5, 4, 2]   # c (id 6) is over the cap -> 2
    assert got[1] == [2, 2, 2, 2, 2]   # 5 tokens, start dropped by pre-truncation


def test_next_token_pairs_whole_text(spark):
    from sievetext.operators.lm import next_token_pairs

    df = _docs(spark, ["a b c", "", "x"]).select("id", tokenize("text").alias("tokens"))
    got = sorted((r.id, r.pos, r.token, r.next_token) for r in next_token_pairs(df).collect())
    assert got == [(0, 0, "a", "b"), (0, 1, "b", "c"), (0, 2, "c", None), (2, 0, "x", None)]


def test_word_ids_whole_text(spark):
    from sievetext.operators.encode import word_ids

    df = _docs(spark, ["hello a zzz world " * 3]).select("id", tokenize("text").alias("tokens"))
    got = word_ids(df, _index(spark)).first().ids
    assert got == [5, 4, 3, 6] * 3


def test_user_tokenizers(spark):
    from sievetext.functions.text import python_tokenizer

    df = _docs(spark, ["Hello, World! again", "x-y z"])
    by_char = python_tokenizer(lambda t: list(t.replace(" ", "")))
    got = [r.t for r in df.select(tokenize("text", by_char).alias("t")).collect()]
    assert got == [list("helloworldagain"), list("xyz")]
    col_fn = lambda norm: F.split(norm, "o")  # noqa: E731 - a Column -> Column tokenizer
    got2 = [r.t for r in df.select(tokenize("text", col_fn).alias("t")).collect()]
    assert got2[0] == ["hell", " w", "rld again"]
