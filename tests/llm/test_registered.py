"""The registered entry points, over whole small tables, against brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import PASSAGE, TEXTS, covered, cut, edits, prose
from veldspar.llm import bpe, decontaminate, registry, suffix_tree

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_pages": ["page_id", "url", "text", "n_chars"],
    "op4_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_decontaminate": ["doc_id", "item_id"],
    "op9_suffix_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}
DOCS = [(i, t) for i, t in TEXTS] + [(30 + i, t) for i, t in enumerate([prose(300)] * 2 + [prose(90) + " " + PASSAGE])]
ITEMS = [(1, PASSAGE), (2, None), (3, prose(30))]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(17)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "http://a/", "<article><p>Some text</article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="module")
def results(spark, root):
    return {name: query(spark, root) for name, query in registry.QUERIES.items()}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_columns(results):
    assert {n: df.columns[: len(COLUMNS[n])] for n, df in results.items()} == COLUMNS


def test_op1(results):
    want = sorted([(d, zlib.crc32(("null" if d is None else str(d)).encode()) % 5 == 0) for d, _ in DOCS], key=repr)
    assert rows(results["op1_toxicity"], "doc_id", "held_out") == want
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in results["op1_toxicity"].collect())


def test_op1_held_out(spark):
    """Labels of the training rows say which of the other rows are toxic."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = [(r.score, r.toxic) for r in registry.QUERIES["op1_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()]
    toxic, clean = [s for s, y in got if y], [s for s, y in got if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.97
    assert sum((s >= 0.5) == bool(y) for s, y in got) / len(got) > 0.96


def test_op2(results):
    out = results["op2_sharding"].collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in DOCS)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_op4_and_op7(results):
    units = [(t or "").encode() for _, t in DOCS]
    want = [(d, *x, y[1]) for (d, _), x, y in zip(DOCS, cut(units, 400, bytes), cut(units, 256, bytes))]
    assert rows(results["op4_suffixes"], "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated") == sorted(want, key=repr)
    want = [(d, n, r, s) for (d, _), (n, r, _, s) in zip(DOCS, cut([u.split() for u in units], 35, b" ".join))]
    assert rows(results["op7_substrings"], *COLUMNS["op7_substrings"]) == sorted(want, key=repr)


def test_op5(results):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(bpe.tokenizer_path()), []
    for d, text in DOCS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(results["op5_bpe"], *COLUMNS["op5_bpe"]) == sorted(want, key=repr)


def test_op6(results):
    s = []
    for _, t in DOCS:
        w = (t or "").encode().lower().split()
        s.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w))
    group = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((d for (d, _), x in zip(DOCS, group) if x == g and d is not None), default=None) for g in group}
    want = [(d, len(x), least[g], d == least[g]) for (d, _), x, g in zip(DOCS, s, group)]
    assert rows(results["op6_minhash"], *COLUMNS["op6_minhash"]) == sorted(want, key=repr)


def test_op8(results):
    want = set()
    for d, t in DOCS:
        for i, x in ITEMS:
            x, n = decontaminate.normal(x or ""), decontaminate.normal(t or "")
            if x and n and edits(x, n) <= int(len(x) * decontaminate.RATE):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in results["op8_decontaminate"].collect()} == want and want


def test_op9(results):
    train = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 7 != 2
    tokens = [(t or "").encode().lower().split() + [suffix_tree.END_WORD] for _, t in DOCS]
    c = Counter(w for (d, _), ws in zip(DOCS, tokens) if train(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(d, not train(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n * 1 + v + 1)) for w in ws), 6)) for (d, _), ws in zip(DOCS, tokens)]
    df = results["op9_suffix_tree"]
    assert rows(df.withColumn("base_score", F.round("base_score", 6)), *COLUMNS["op9_suffix_tree"][:-1]) == sorted(want, key=repr)


def test_op10(results):
    for r in results["op10_quality_rules"].collect():
        t = next((t or "") for d, t in DOCS if d == r.doc_id and len((t or "").encode().split()) == r.n_words)
        w = t.encode().split()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert r.n_repeat_words == sum(covered(len(w), [i for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1], 3))
        assert r.word_chars == sum(len(x.decode()) for x in w) and not (r.base_failed and r.kept)
