import pytest

from quillspark.llm import bpe

TEXTS = ["The form HR-1 isn't  signed.\n\n", "Ａ😀é", "a" * 3000, "ab" * 900 + " x", "<|endoftext|>", "  \t ", "aaa aaaa", "Що каже правило?", "\u0000x", None, ""]


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe()


def test_equals_the_public_encoder(model):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    offsets, ids = model.encode(TEXTS)
    for i, text in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == public.encode(text or "", add_special_tokens=False).ids
    assert model.count(TEXTS).tolist() == [int(b - a) for a, b in zip(offsets[:-1], offsets[1:])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_files_of_ranks(name):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(f"{bpe.TOKENIZER_DIR}/{name}", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    offsets, ids = bpe.Bpe(name=name).encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [public.encode_ordinary(t or "") for t in TEXTS]


def test_other_vocabularies_are_errors():
    with pytest.raises(ValueError):
        bpe.Bpe(name="word_bpe_49k.json")


def test_heap_and_rounds_agree(model):
    for word in (b"onboarding", b" checklist", "приклад".encode(), b"aaaaaaa", b"abababab"):
        assert model._merge_long(word).tolist() == model.merge_words([word])[0].tolist()


def test_frame(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id bigint, text string, ids string")
    rows = bpe.encode_texts(df, "doc_id", "text").collect()
    by = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == len(TEXTS) + 1 and by[9] == [] and by[10] == [] and by[0][:2] == [464, 1296]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    counted = {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df, ["doc_id"], "text").collect()}
    assert all(counted[i] == len(by[i]) for i in by)
