import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberlog.llm import packing, quality, toxicity
from emberlog.llm.queries_tokens import tokenizer_path
from emberlog.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@needs_tables
@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, docs, rows, empty, kind):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit, score, cut = (quality.fit_quality, quality.score_quality, 0.5) if kind == "quality" else (toxicity.fit_toxicity, toxicity.score_toxicity, 0.7)
    model = fit(table, labels)
    got = {r.doc_id: r for r in score(table, model).collect()}
    assert all(r.held_out == held(k) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for k, r in got.items())
    truth = [(r[kind], got[r.doc_id].predicted) for r in labels.collect() if held(r.doc_id)]
    assert np.mean([a == b for a, b in truth]) > 0.9
    assert score(docs, model).count() == len(rows) and score(empty, model).count() == 0
    blank = fit(table, labels.limit(0))
    assert len({r.score for r in score(docs, blank).select("score").collect()}) >= 1


def test_kernel_tolerates_insertions():
    bags, y = [], []
    for i in range(120):
        filler = [f"word{(i * 7 + j) % 50}" for j in range(12)]
        bags.append(filler + (["stupid", "worthless"] if i % 4 == 0 else ["students", "worthy"]))
        y.append(float(i % 4 == 0))
    m = toxicity.WordMachine().fit(bags, np.array(y))
    score = lambda w: m.score([w])[0]
    assert min(score("stupid"), score("stuupid"), score("worthlesss")) > 0 > max(score("students"), score("worthy"), score("word7"))
    assert toxicity.words_of("You s t u p i d man") [-1] == "stupid"


def test_drop_toxic(spark, docs, rows):
    model = toxicity.ToxicityModel().fit([[["bad", "word"]], [["fine", "word"]]] * 30, np.array([1.0, 0.0] * 30))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    want = sorted((str(r.doc_id) for r in toxicity.score_toxicity(docs, model).collect() if r.score < 0.7))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_packing_round_trip(docs, rows, empty):
    path = tokenizer_path()
    pieces = packing.pack(docs, path).collect()
    untouched = Tokenizer.from_file(path)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(np.array([*untouched.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
    for doc, parts in by_doc.items():
        assert sum(n for _, n, _, _ in parts) == sum(map(len, want[doc]))
        if len(want[doc]) == 1:
            (ids,), at = want[doc], 0
            for start, n, crc, total in sorted(parts):
                assert (start, total) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + n].tobytes())
                at += n
    assert set(by_doc) == set(want)
    special = docs.limit(1).selectExpr("1L doc_id", "'<|endoftext|> a <|endoftext|>' text")
    ids = np.array([*untouched.encode("<|endoftext|> a <|endoftext|>", add_special_tokens=False).ids, 1], "<u4")
    (only,) = packing.pack(special, path).collect()
    assert (only.length, only.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert packing.pack(empty, path).count() == 0


def test_divide():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300):
        sizes = rng.integers(1, 2048, n).tolist()
        windows = packing.divide(sizes, 2048)
        parts = sorted(p for w in windows for p in w)
        for i, size in enumerate(sizes):
            at = 0
            for _, start, length in [p for p in parts if p[0] == i]:
                assert start == at and length > 0
                at += length
            assert at == size
        loads = [sum(x[2] for x in w) for w in windows]
        assert max(loads) <= 2048 and -(-sum(sizes) // 2048) <= len(windows) <= 1.05 * sum(sizes) / 2048 + 1
        assert n < 40 or max(loads) - min(loads) < 300
    assert [len(w) for w in packing.divide([1500, 1500, 1000], 2000, 4000)] == [1, 1, 1]  # two windows would hold 2,500 tokens in one
    assert packing.divide([], 2048) == []
    assert len(packing.differencing([4, 5, 6, 7, 8], 2)) == 2


def test_tokens_equal_the_tokenizer():
    e, untouched = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd = ["it's  don't\n\n  x\t y ", "<|endoftext|> a", "日本語 text  ok", "a'S '", "", "´x `~ éè’s ‘a’ 12ab34", "x\r\n\r\n  y", "µ a ª º ß x²³ ¼", "tail  ", "\u00a0 nbsp", "a_b __ c"]
    for t in odd:
        assert e(t) == untouched.encode(t, add_special_tokens=False).ids, t


def test_memory_before_and_in_packing(spark, monkeypatch):
    """Heaps are collected, twice, by tasks of their own; the tokenizer's own library is read only for texts that need it."""
    from emberlog.llm import common, tokens

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans())
    monkeypatch.setattr(common, "_one_process", lambda spark: False)
    before = collections()
    common.shrink_executors(spark)
    assert collections() >= before + 2
    monkeypatch.setattr(tokens, "_WORKER", {})
    e = Encoder(tokenizer_path())
    assert e("plain text") and e._tokenizer is None
    assert e("<|endoftext|>") and e._tokenizer is not None
