import random
import unicodedata

import numpy as np
import pytest

from noticeflow.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tools():
    path = queries.tokenizer_path()
    spec = bpe.read_spec(path)
    return bpe.Encoder(spec), bpe.Decoder(spec), tokenizers.Tokenizer.from_file(path)


def same(tools, s):
    enc, dec, lib = tools
    want = lib.encode(s, add_special_tokens=False).ids
    got = np.frombuffer(enc.encode(s), np.int32)
    assert list(got) == want, s
    assert dec.decode(got).decode() == lib.decode(want, skip_special_tokens=False), s


def test_bpe_equals_the_library(tools):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'ABC é0123 .,!<|\u0301Σñ#$%\u00a0\x1c\x85\u2028\tß世界🙂"
    for _ in range(3000):
        same(tools, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
    vocab = [t.replace("</w>", "") for t in tools[2].get_vocab()]
    for _ in range(3000):
        same(tools, "".join(rng.choice(vocab) for _ in range(rng.randint(1, 5))))
    for s in ("", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "x" * 20_000, "thethethe" * 3000, "<|endoftext", "don't 'S 's'S", "İstanbul ΣΑΣ"):
        same(tools, s)


def test_bpe_with_little_memory(tools, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 3)
    fresh = (bpe.Encoder(bpe.read_spec(queries.tokenizer_path())), *tools[1:])
    rng = random.Random(2)
    for _ in range(200):
        same(fresh, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(20)))


def test_bpe_on_tables(spark, tools):
    texts = ["Hello  World", "", None, "Hello  World", "é" * 50_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, decoded string")
    tok = bpe.load(spark, queries.tokenizer_path())
    out = bpe.decode(bpe.encode(docs, tok), tok).collect()
    assert [r["ids"] for r in out] == [tools[2].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [r["decoded"] for r in out] == [tools[2].decode(r["ids"], skip_special_tokens=False) for r in out]
    assert [r["doc_id"] for r in out] == [0, 1, 2, None, 4]
    assert bpe.encode(docs.limit(0), tok).count() == 0


def test_every_code_point_is_as_the_library_has_it(tools):
    """Alone between a letter and a digit, and between a letter and marks of lower and higher class; Hangul and Han but for samples."""
    same_tables = [*range(0x3400, 0x4DC0, 97), *range(0x4E00, 0xA000, 97), *range(0xAC00, 0xD7A4, 97), *range(0x20000, 0x323B0, 997)]
    rest = [c for c in range(0x110000) if not (0x3400 <= c < 0x4DC0 or 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xE000 or 0x20000 <= c < 0xE0000 or c >= 0xE1000)]
    texts = [f"a{c}b1 \u1eb9{c}\u0327 e{c}\u0301{c}b" for c in map(chr, rest + same_tables)]
    texts += [unicodedata.normalize("NFD", chr(c)) for c in rest if unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
    enc, _, lib = tools
    wrong = [t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(enc.encode(t), np.int32).tolist() != e.ids]
    assert not wrong, [hex(ord(t[1])) for t in wrong[:20]]


def test_words_met_before_are_not_encoded_again(tools):
    fresh, calls = bpe.Encoder(bpe.read_spec(queries.tokenizer_path())), []
    one, rng = fresh.word, random.Random(3)
    fresh.word = lambda letters: calls.append(letters) or one(letters)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(130_000)})
    for form in (str, str.capitalize, "{},".format, "({}".format):  # 60,000 words or chunks a table, of each form, would not do
        fresh.encode(" ".join(map(form, words)))
    assert len(calls) == len(words) + 2


def test_characters_beyond_the_basic_plane(tools):
    rng = random.Random(4)
    odd = "ab's'1 　\x1c.🙂𝐀𝟗𐐀𐐨\U0001e5d0\U00010d50\U00010d40\U00016ea0\U00011930𢡊ꀀ①Σé́"
    for _ in range(3000):
        same(tools, "".join(rng.choice(odd) for _ in range(rng.randint(1, 15))))
    with pytest.raises(ValueError):
        bpe.pinned(r"\p{Lu}+|\S")


def test_one_pass_equals_two(spark, tools):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Hello  World", "", None, "Hello  World", "é" * 50_000, "<|endoftext|> x"])], "doc_id int, text string")
    tok = bpe.load(spark, queries.tokenizer_path())
    two = bpe.decode(bpe.encode(docs, tok).drop("text"), tok)
    one = bpe.recode(docs, tok)
    assert one.schema == two.schema and one.collect() == two.collect()
    named = bpe.recode(docs, tok, out="text")
    assert named.columns == ["doc_id", "text", "ids"] and named.select("doc_id", "ids", "text").collect() == [tuple(r) for r in two.collect()]
    assert bpe.recode(docs.limit(0), tok).count() == 0


def test_the_query_has_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op4_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
