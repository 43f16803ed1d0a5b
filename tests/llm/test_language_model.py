import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare

from noticeflow.llm import language_model as lm
from noticeflow.llm import queries

BEGIN, END = " begin", " end"  # no words, as they hold white space


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.words = order, Counter(t for x in texts for t in tokens(x))
        self.n = sum(self.words.values())
        counts = {k: Counter() for k in range(1, order + 1)}
        for x in texts:
            seq = [BEGIN, *tokens(x)]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0 and (k == order or (i - k + 1 == 0 and k > 1)):
                        counts[k][tuple(seq[i - k + 1 : i + 1])] += 1
        for k in range(order - 1, 0, -1):
            for g in counts[k + 1]:
                counts[k][g[1:]] += 1
        self.counts, self.discounts, self.contexts = counts, {}, {}
        for k, c in counts.items():
            n = Counter(c.values())
            d = (0.5, 1.0, 1.5)
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                own = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
                d = own if all(0 < x <= j for x, j in zip(own, (1, 2, 3), strict=True)) else d
            self.discounts[k] = (0.0, *d)
            by = defaultdict(list)
            for g, v in c.items():
                by[g[:-1]].append(v)
            self.contexts[k] = {u: (sum(v), sum(self.discounts[k][min(x, 3)] for x in v)) for u, v in by.items()}

    def p(self, word, before):
        p = 1 / (len(self.words) + 1)
        for k in range(1, min(self.order, len(before) + 1) + 1):
            u = tuple(before[len(before) - k + 1 :])
            follow = self.contexts[k].get(u)
            if follow:
                d, c = self.discounts[k], self.counts[k].get((*u, word), 0)
                p = (max(c - d[min(c, 3)], 0) + follow[1] * p) / follow[0]
        return p

    def scores(self, text):
        seq = [BEGIN, *tokens(text)]
        base = sum(math.log10((self.words[t] + 0.1) / (self.n + 0.1 * (len(self.words) + 1))) for t in seq[1:])
        return len(seq) - 1, sum(self.words[t] > 0 for t in seq[1:]), base, sum(math.log10(self.p(seq[i], seq[:i])) for i in range(1, len(seq)))


def close(got, want):
    assert got[:2] == want[:2]
    assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(got[2:], want[2:], strict=True)), (got, want)


ODD = [
    None, "", " \t\n", "a", "A a\x0ba\x0ca", "x" * 5000, "é É é ß", "the cat sat on the mat " * 40, "the cat sat", "the dog sat on the cat",
    "a b c d e f g", "a b c a b d a b e", "a b c d", "nul\x00 nul", "the " * 3000, "</s> <begin> <end>",
]


def scored(spark, train, texts, order):
    frame = lambda rows: spark.createDataFrame([(k, t, "z") for k, t in enumerate(rows)], "doc_id long, text string, n string").repartition(3)
    model = lm.fit(frame(train), order=order)
    rows = lm.score(frame(texts), model).collect()
    return model, {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_those_of_dictionaries(spark, order):
    texts = [*ODD, "never seen words the cat", "a b zzz c d", "the\x00 cat"]
    model, got = scored(spark, ODD * 2, texts, order)
    plain = Plain(ODD * 2, order)
    assert (model.n_tokens, model.n_words) == (plain.n, len(plain.words)) and len(got) == len(texts)
    for k, t in enumerate(texts):
        close(got[k], plain.scores(t))


def test_probabilities_sum_to_one():
    plain = Plain(ODD, 3)
    for before in ([BEGIN], [BEGIN, "the"], [BEGIN, "the", "cat"], [BEGIN, "a", "b"], [BEGIN, "zzz"], [BEGIN, "a", "zzz"]):
        assert abs(sum(plain.p(w, before) for w in (*plain.words, "unknown")) - 1) < 1e-12


def test_small_pieces_windows_shards_and_sends(spark, monkeypatch):
    """In this process, as workers don't see patched sizes."""
    for name, size in (("PIECE", 64), ("WINDOW", 50), ("HELD", 40)):
        monkeypatch.setattr(lm, name, size)
    plain = Plain(ODD, 3)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(ODD)})
    assert [tokens(t) for t in ODD] and sum(len(b) for b in lm.texts([batch], "text")) == len(ODD)
    h, sizes = lm.word_hashes(pa.array(ODD)[1:])
    assert sizes.tolist() == [len(tokens(t)) - 1 for t in ODD[1:]]
    names = {}
    for t, x in zip((t for text in ODD[1:] for t in tokens(text)[:-1]), h.tolist(), strict=True):
        assert names.setdefault(x, t) == t
    assert len(names) == len(plain.words) - 1
    counter, out = lm.Counter(2, 3), []
    rng = np.random.default_rng(0)
    m = rng.integers(0, 9, (500, 3)).astype(np.uint32)
    for part in np.split(m, 10):
        out += list(counter.add(*lm.added(part, np.ones((len(part), 1), np.int64))))
    out += list(counter.rest())
    total = Counter()
    for b in out:
        for shard, data in zip(b.column("shard").to_pylist(), b.column("data").to_pylist(), strict=True):
            rows, c = lm.unpacked(data)
            assert set((lm.gram_hash(rows) >> np.uint64(61)).tolist()) == {shard}
            total.update({tuple(r): n for r, n in zip(rows.tolist(), c[:, 0].tolist(), strict=True)} if len({*map(tuple, rows.tolist())}) == len(rows) else {})
    assert total == Counter(map(tuple, m.tolist()))


def test_windows_of_one_text(spark, tmp_path, monkeypatch):
    texts = [t for t in ODD if t]
    model, got = scored(spark, texts, texts, 3)
    monkeypatch.setattr(lm, "WINDOW", 37)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    rows = [r for b in lm._score(iter([batch]), "text", model, lm.COLUMNS, ("text",)) for r in b.to_pylist()]
    for k, r in enumerate(rows):
        close(tuple(r.values()), got[k])


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 2048)
    texts = [" ".join(f"w{i * i % 97}" for i in range(k, k + 60)) for k in range(200)]
    model, got = scored(spark, texts, texts, 2)
    plain = Plain(texts, 2)
    assert model.bits >= 4
    for k in (0, 17, 199):
        close(got[k], plain.scores(texts[k]))


def test_nothing_to_learn_from(spark):
    _, got = scored(spark, [], ["a b", None], 2)
    assert got == {0: (3, 0, 0.0, 0.0), 1: (1, 0, 0.0, 0.0)}
    assert scored(spark, ["a"], [], 2)[1] == {}


def test_a_folder_that_workers_cannot_open_is_an_error(spark):
    with pytest.raises(ValueError, match="open as files"):
        lm.model_folder(spark, "hdfs://host/x")
    assert lm.model_folder(spark, "file:///tmp/a").startswith("/tmp/a/lm-")


@pytest.mark.skipif(not compare.present, reason="no test tables")
def test_query_against_dictionaries(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{compare.SMALL}/documents.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    plain = Plain([t for i, t in texts.items() if i not in held], queries.ORDER)
    rows = queries.op13_language_model(spark, compare.SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == plain.n
        close((r["n_tokens"], r["n_known"], r["base_score"], r["score"]), plain.scores(texts[r["doc_id"]]))
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
