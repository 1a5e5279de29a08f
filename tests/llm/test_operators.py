"""Each operator on odd rows, against brute force."""

import hashlib
import math
import random
import uuid
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veldspar.llm import bpe, decontaminate, graph, minhash, pages, quality, repeats, sharding, substrings, suffix_tree, suffixes, toxicity
from veldspar.llm.common import keyed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, k long, spans string, n_words string, score string, label string, kept string"
R = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "été", "naïve", "zeta.", "eta,", "Theta", "日本語", "x"]


def prose(n):
    return " ".join(R.choice(WORDS) + (R.choice("abcdefgh") if R.random() < 0.7 else "") for _ in range(n))


PASSAGE, BASE = prose(60), prose(200)
NEAR = BASE.split()
NEAR[50] = "changed"
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, prose(30) + "\n" + PASSAGE + "\n" + prose(20)), (6, PASSAGE + " " + prose(9)),
    (7, BASE), (8, " ".join(NEAR)), (9, BASE.upper().lower()), (10, "a " * 900), (11, "ab" * 1500), (12, prose(4000) + "\n" + PASSAGE), (13, BASE), (13, BASE), (14, prose(120)),
    (None, prose(80)), (None, None), (15, "\x85 \x1c\xa0 odd spaces it's 1d1ot!! <|endoftext|> Σας"), (16, "| a | b | c | d |\nHello there, this is fine.\nAll rights reserved."), (16, prose(55)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, "x", 1, "y", "z", "q", "l", "m") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(rows):
    return sorted(rows, key=repr)


def covered(n, starts, w):
    m = [False] * n
    for s in starts:
        for i in range(s, s + w):
            m[i] = True
    return m


def cut(units, w, join):
    heads = Counter(tuple(u[i : i + w]) for u in units for i in range(len(u) - w + 1))
    for u in units:
        m = covered(len(u), [i for i in range(len(u) - w + 1) if heads[tuple(u[i : i + w])] > 1], w)
        yield len(u), sum(m), sum(x and not (i and m[i - 1]) for i, x in enumerate(m)), hashlib.sha256(join(x for x, y in zip(u, m) if not y)).hexdigest()


@pytest.mark.parametrize("width", [1, 2, 5, 35])
def test_substrings(docs, width):
    k, lost = substrings.removed(docs, width)
    every = substrings._digest(k)
    out = every.join(lost, repeats.same_row(every, lost), "left").select(every["doc_id"], "n_words", F.coalesce("n_removed", F.lit(0)), F.coalesce("kept_sha256", "sha"))
    units = [(t or "").encode().split() for _, t in TEXTS]
    assert got(out) == expected([(d, n, r, s) for (d, _), (n, r, _, s) in zip(TEXTS, cut(units, width, b" ".join))])


@pytest.mark.parametrize("width", [3, 40, 400])
def test_suffixes(docs, width):
    units = [(t or "").encode() for _, t in TEXTS]
    for report in {width, max(1, width * 5 // 8)}:
        k, lost = suffixes.removed(docs, width, report)
        every = suffixes._digest(k)
        out = every.join(lost, repeats.same_row(every, lost), "left").select(every["doc_id"], "n_bytes", F.coalesce("n_removed", F.lit(0)), F.coalesce(F.size("removed"), F.lit(0)), F.coalesce("kept_sha256", "sha"), F.coalesce("n_repeated", F.lit(0)))
        assert got(out) == expected([(d, *x, y[1]) for (d, _), x, y in zip(TEXTS, cut(units, width, bytes), cut(units, report, bytes))])


def test_graph_compacts_what_does_not_branch(spark):
    """Shared passages that enter, leave and cross one another, and self-overlap: paths say one thing everywhere and cover all."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [a + b + c, ["x"] + a + ["y"] + c, b[:30] + c[20:], ["q"] * 50 + a[10:50], ["q"] * 47, c + a[:20] + b[30:] + ["z"], a + b + c + ["w"]]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    width = 6
    held, units = repeats.find(keyed(df), substrings.kind(width))
    spans = graph.compacted(units, width, repeats.KEYS).collect()
    mers = [[tuple(r[i : i + width]) for i in range(len(r) - width + 1)] for r in rows]
    many = Counter(m for ms in mers for m in ms)
    said, at = {}, {i: set() for i in range(len(rows))}
    for r in spans:
        for x in r.spans:
            said.setdefault(x.path, []).append(tuple(rows[r.doc_id][x.s : x.e]))
            at[r.doc_id].update(range(x.s, x.e))
    assert all(len(set(v)) == 1 and len(v) > 1 for v in said.values())
    assert at == {i: {k for j, m in enumerate(ms) if many[m] > 1 for k in range(j, j + width)} for i, ms in enumerate(mers)}
    assert len(said) < units.select(F.explode("units.u")).distinct().count()
    alone = spark.createDataFrame([(1, " ".join(["l1", "l2"] + a + ["l3"])), (2, " ".join(a[5:50] + ["r1"] * 9))], "doc_id long, text string")
    held, units = repeats.find(keyed(alone), substrings.kind(width))
    assert {(r.doc_id, x.s, x.e) for r in graph.compacted(units, width, repeats.KEYS).collect() for x in r.spans if x.e - x.s > width} == {(1, 7, 52), (2, 0, 45)}


def test_colliding_names_are_noticed(spark, monkeypatch):
    """Two words that hash alike: the source words tell, and another salt settles it."""
    plain = substrings.word_units
    monkeypatch.setattr(substrings, "word_units", lambda t: plain(t.replace(b"left", b"right")))
    df = spark.createDataFrame([(1, "go left " * 3), (2, "go right " * 3)], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        substrings.removed(df, 6)
    first, real = substrings.kind, lambda t: plain(t)
    monkeypatch.setattr(substrings, "kind", lambda w, salt=0: first(w) if not salt else repeats.Kind(w, 2, (5, 1), real))
    assert substrings.removed(df, 6)[1].count() == 0


def test_removed_text_keeps_the_rest(docs):
    out = {r.doc_id: r.text for r in substrings.deduplicated(docs, 35).where("doc_id in (5, 14)").collect()}
    assert PASSAGE not in out[5] and out[5].startswith(TEXTS[5][1].split("\n")[0]) and out[14] == TEXTS[15][1]


def test_empty_tables(spark, empty):
    assert substrings.deduplicated(empty).count() == minhash.deduplicated(empty).count() == bpe.encoded(empty).count() == 0
    assert suffixes.removed(empty)[1].count() == quality.measured(empty).count() == quality.cleaned(empty).count() == 0
    assert sharding.records(empty).count() == suffix_tree.scored(empty, F.lit(True)).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matched(empty, items).count() == decontaminate.clean(empty, items).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(empty, toxicity.trained(empty, labels, F.lit(True))).count() == 0
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def sets(words):
    for _, t in TEXTS:
        w = (t or "").encode().lower().split()
        yield frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


@pytest.mark.parametrize("words", [1, 2, 5])
def test_minhash(docs, words):
    s = list(sets(words))
    group = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((TEXTS[i][0] for i in range(len(s)) if group[i] == g and TEXTS[i][0] is not None), default=None) for g in group}
    out = minhash.grouped(docs, words).select("doc_id", "n", "component_id")
    assert got(out) == expected([(TEXTS[i][0], len(s[i]), least[group[i]]) for i in range(len(s))])
    kept = minhash.deduplicated(docs, words)
    assert kept.columns == docs.columns
    assert kept.count() == len({g for g, x in zip(group, s) if x}) + sum(not x for x in s)


def test_minhash_chain_needs_open_pairs(spark):
    """Groups that no pivot joins at once: every text is linked to its neighbours only."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[k * 6 :] + [f"v{i}" for i in range(k * 6)]) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.grouped(df, 1).collect()} == {0}


def test_bands_find_what_links():
    misses = 0
    for k in range(200):
        a = {R.getrandbits(64) for _ in range(300)}
        b = set(list(a)[:267]) | {R.getrandbits(64) for _ in range(33)}  # similarity 0.8
        x, y = (minhash.bands(minhash.signature(minhash.np.array(sorted(s), minhash.np.uint64))) for s in (a, b))
        misses += not (x == y).any()
    assert not misses


def test_quality(docs):
    out = {(r.doc_id, r.n_words): r for r in quality.measured(docs.drop("n_words", "kept")).collect()}
    for d, t in TEXTS:
        w = (t or "").encode().split()
        r = out[d, len(w)]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        m = covered(len(w), [i for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1], 3)
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(len(x.decode()) for x in w), sum(m), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(x) for x in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * sum(m) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.measured(docs).where("doc_id = 16 and n_symbols > 0").first().clean_text == "Hello there, this is fine."
    assert quality.cleaned(docs).columns == docs.columns


def test_quality_is_native(spark):
    plan = quality.measured(spark.range(3).selectExpr("id as doc_id", "string(id) as text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_sharding(spark, docs):
    rows, maps = sharding.sharded(docs, 3, 16)
    out = rows.collect()
    assert expected([(r.doc_id, r.size, r.text_crc32) for r in out]) == expected([(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in TEXTS])
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    one, two = maps.load(1), maps.load(2)
    assert set(one.values()) == {0, 1, 2} and all(two[r.virtual_slot] == r.shard for r in out)
    with pytest.raises(Exception):
        maps.commit(1, one)


def test_sharding_law(spark, tmp_path):
    """The registered query: shard sizes are near equal, one repeated row in ten of eleven rows or not."""
    for k, rows in enumerate(([(7, "same text over and over")] * 20_000 + [(i, prose(9)) for i in range(2000)], [(i, prose(R.randint(1, 60))) for i in range(20_000)])):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = sharding.query(spark, f"{tmp_path}/{k}").collect()
        assert expected([(r.doc_id, r.size, r.text_crc32) for r in out]) == expected([(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows])
        load = [sum(r.size for r in out if r.shard == s) for s in range(8)]
        assert max(load) <= 1.01 * sum(load) / 8 and min(load) >= 0.99 * sum(load) / 8 and {r.law for r in out} == {"bytes"}
        for s in range(8):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_rebalancing_moves_little():
    weights = {k: R.randint(1, 100) for k in range(4096)}
    one = sharding.balance(weights, 8)
    load = lambda m, n: [sum(weights[k] for k in m if m[k] == s) for s in range(n)]
    assert max(load(one, 8)) - min(load(one, 8)) <= 100
    nine = sharding.rebalance(one, weights, 9)
    assert max(load(nine, 9)) <= sum(weights.values()) / 9 * 1.02
    assert sum(one[k] != nine[k] for k in one) <= 4096 / 9 * 1.6
    seven = sharding.rebalance(one, weights, 7)
    assert set(seven.values()) == set(range(7)) and all(one[k] == seven[k] for k in one if one[k] < 7)
    assert sharding.rebalance(one, weights, 8) == one


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    out = got(bpe.encoded(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    want = []
    for d, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == expected(want)


def test_bpe_trees():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(bpe.tokenizer_path()), bpe.Bpe(bpe.tokenizer_path(), leaf=5, cache=50)
    for n in range(1, 400):
        s = "".join(R.choice("aeiouthnrs日é!") for _ in range(n))
        assert b.encode(s) == t.encode(s, add_special_tokens=False).ids


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs):
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "too short"), (5, prose(30)), (5, prose(25))]
    out = decontaminate.matched(docs, spark.createDataFrame(items, "item_id long, text string"), block=200)
    want = {(d, i) for d, t in TEXTS for i, x in items if x and len(x) >= 24 and decontaminate.normal(x) in decontaminate.normal(t or "")}
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want and all(r.edits == 0 for r in out.collect())
    clean = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - len({d for d, _ in want})


def test_decontamination_edits():
    item = decontaminate.normal(prose(30))
    index = decontaminate.Index([(0, item)])
    for _ in range(60):
        s = list(item)
        for _ in range(R.randint(0, int(len(s) * 0.13))):
            j = R.randrange(len(s))
            s[j : j + R.randint(0, 1)] = R.choice(["", "q", "zz"])
        text = decontaminate.normal(prose(20) + " " + "".join(s) + " " + prose(20))
        e = edits(item, text)
        found = min((x for _, _, x, _ in index.matches([text])), default=None)
        assert found == (e if e <= index.budget[0] else None)


def test_decontamination_bears_the_same_rate_for_short_items():
    for n in range(decontaminate.LEAST, 130):
        block = decontaminate.Block([(0, decontaminate.normal(prose(40))[:n].strip().ljust(n, "x"))])
        assert block.parts[0][1].budget[0] == int(n * decontaminate.RATE) and block.parts[0][1].bound[0] >= 5
    item = decontaminate.normal("what does the old miller give his third son")
    text = "so " + item.replace("miller", "miler").replace("third", "thyrd").replace("son", "sun") + " asked he"
    assert [(i, e) for _, i, e, _ in decontaminate.Block([(0, item)]).matches([decontaminate.normal(text)])][0] == (0, 3)


def test_decontamination_short_items():
    index = decontaminate.Index([(1, "forty two"), (2, "ox"), (3, "y."), (4, decontaminate.normal(PASSAGE))])
    out = set(index.matches(["it is forty two, says the fox", "an ox", decontaminate.normal("x " + PASSAGE)]))
    assert {(d, i, e) for d, i, e, _ in out} == {(0, 0, 0), (1, 1, 0), (2, 3, 0)} and (0, 0, 0, 15) in out


def test_decontamination_index_is_the_block_s_own():
    """Two blocks whose broadcast values come to stand at one address."""
    value, found = [None, None, 0.1], []
    sent = type("Sent", (), {"value": value})()
    for key in ("a", "b"):
        value[:2] = key, [(key, decontaminate.normal(PASSAGE))]
        found.append(decontaminate._index(sent).ids)
    assert found == [["a"], ["b"]]


def test_suffix_tree(docs):
    out = suffix_tree.scored(docs, ~suffix_tree.held_out(docs["doc_id"]))
    train = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 7 != 2
    tokens = [(t or "").encode().lower().split() + [b"\r"] for _, t in TEXTS]
    c = Counter(w for (d, _), ws in zip(TEXTS, tokens) if train(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(d, not train(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), ws in zip(TEXTS, tokens)]
    assert got(out.select("doc_id", ~F.col("train"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))) == expected(want)
    assert all(r.score <= 1e-9 for r in out.collect())


def test_suffix_tree_learns_contexts(spark):
    rows = [(i, " ".join(R.choice("abcdefgh") for _ in range(30)) + " the quick brown fox jumps over") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = suffix_tree.scored(df, F.col("doc_id") < 150).where("doc_id >= 150").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] + 50 * 3


def test_suffix_tree_sums_to_one():
    import numpy as np

    root = np.log(np.array([50, 30, 15, 5.0]) / 100)
    states = []
    use = suffix_tree._grow([{1: 80, 2: 15}], [100], [-1], root, states)
    listed, rest = states[use[0]]
    assert abs(sum(np.exp(root[w] + listed.get(w, rest)) for w in range(4)) - 1) < 1e-9
    use2 = suffix_tree._grow([{0: 60}], [64], use, root, states)
    listed, rest = states[use2[0]]
    assert use2 != use and abs(sum(np.exp(root[w] + listed.get(w, rest)) for w in range(4)) - 1) < 1e-9


def test_suffix_tree_follows_the_rule(spark, docs, monkeypatch):
    """The tables against the rule on dictionaries, with and without sequences outside the broadcast part."""
    import numpy as np

    rows = [(i, " ".join(R.choice("abc") + R.choice("aab") for _ in range(R.randint(0, 60))) + " p q r s" * (i % 3)) for i in range(150)] + [(3, "p q r"), (3, "p q r"), (900, None)]
    train = [(t or "").encode().split() + [b"\r"] for i, t in rows if i < 120]
    uni, pair, triple = (Counter(tuple(t[j : j + n]) for t in train for j in range(len(t) - n + 1)) for n in (1, 2, 3))
    rank = {w: i for i, (w,) in enumerate(uni)}
    root = np.log((np.array([uni[w,] for w in rank]) + 1) / (sum(uni.values()) + len(uni) + 1))
    states, use = [], {}
    for grams, n in ((pair, uni), (triple, pair)):
        by: dict = {}
        for g, c in grams.items():
            if c >= suffix_tree.LEAST:
                by.setdefault(g[:-1], {})[rank[g[-1]]] = c
        use |= dict(zip(by, suffix_tree._grow(list(by.values()), [n[x] for x in by], [use.get(x[1:], -1) for x in by], root, states)))
    want = []
    for i, t in rows:
        ws, s = (t or "").encode().split() + [b"\r"], 0
        for j, w in enumerate(ws):
            at = use.get(tuple(ws[j - 2 : j])) if j > 1 else None
            at = use.get((ws[j - 1],), -1) if at is None and j else -1 if at is None else at
            listed, rest = states[at] if at >= 0 else ({}, 0.0)
            s += root[rank[w]] + listed.get(rank[w], rest)
        want.append((i, round(s / math.log(10), 6) + 0.0))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for head, hot in ((65_536, 1 << 19), (4, 16), (65_536, 0)):
        monkeypatch.setattr(suffix_tree, "HEAD", head), monkeypatch.setattr(suffix_tree, "HOT", hot)
        out = suffix_tree.scored(df, F.col("doc_id") < 120).select("doc_id", F.round("score", 6))
        assert [i for i, _ in sorted(map(tuple, out.collect()))] == [i for i, _ in sorted(want)]
        assert all(abs(x - y) < 1e-4 for (_, x), (_, y) in zip(sorted(map(tuple, out.collect())), sorted(want)))


def test_suffix_tree_grows_with_the_corpus(spark):
    """A context that is rare in a large corpus still counts."""
    rows = [(i, "one rare and odd phrase") for i in range(4)] + [(9, "x y z w " * 150_000)]
    r = suffix_tree.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") > 0).where("doc_id = 0").first()
    assert r.score > r.base_score + 3


def test_toxicity(spark, docs):
    rows = [(i, prose(40) + (" you idiot! " if i % 4 == 0 else " well. ") + prose(20)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (None, 1), (900, 1)], "doc_id long, toxic int")
    model = toxicity.trained(df, labels, ~toxicity.held_out(F.col("doc_id")))
    out = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert all((out[i] >= 0.5) == (i % 4 == 0) and 0 <= out[i] <= 1 for i in out) and len(out) == 400
    assert toxicity.scored(docs, model).count() == len(TEXTS)


def test_isotonic_is_monotone():
    import numpy as np

    p = np.random.default_rng(1).random(500)
    y = (np.random.default_rng(2).random(500) < p).astype(float)
    xs, ys = toxicity.isotonic(p, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 <= ys.min() and ys.max() <= 1


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>A<li>B</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>bold</b>  line<br>more<p>Two &lt;3 &eacute;
<aside>Side</aside><div class="share-buttons">Share</div></article><section id="comments"><p>First!</p></section><form>Send</form><script>x="</p>"</script><footer>F</footer>"""


def test_pages():
    assert pages.extract(PAGE) == "Head & tail\nOne bold line more\nTwo <3 é"
    assert pages.extract("") == "" and pages.extract("<p") == "" and pages.extract("a < b") == "a < b"
    assert pages.extract("<body><div>x</div><div class=ad>y</div><table><tr><td>1<td>2</table>") == "x\n1\n2"


def test_site_style_tree(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='top'>Same words</div><div class='text'><p>{prose(20)}</p></div></body>") for i in range(8)]
    rows += [(90, None, None), (91, "http://one.example", "<body><div class='top'>Same words</div></body>"), (91, "http://one.example", "<body><div class='top'>Same words</div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (8_000_000, -1):  # by broadcast and by join
        pages.BROADCAST_BYTES, old = most, pages.BROADCAST_BYTES
        out = {r.page_id: r.text for r in pages.extracted(df).collect()}
        pages.BROADCAST_BYTES = old
        assert "Same words" not in out[0] and out[0] and out[90] == "" and out[91] == "Same words"
    assert pages.extracted(df).count() == 11


def texts_of(spark, htmls):
    df = spark.createDataFrame([(i, "http://h.example/x", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extracted(df).collect()}


def test_names_are_a_prior():
    main = "long main text " * 30
    assert pages.extract(f"<body><div>{main}</div><article class='teaser'>Read this</article>").startswith("long main")
    assert pages.extract(f"<body><div class='content has-sidebar'><article><p>{main}</article><div class=sidebar>x</div></div>") == main.strip()
    assert pages.extract("<article><p>One</p><p class='more'>Two</p></article>") == "One\nTwo"
    assert pages.extract("<nav>only a menu</nav>") == ""


def test_site_style_tree_judges_articles(spark):
    out = texts_of(spark, [f"<body><article><p>{prose(30)}</p><div class='x1'>Buy this now</div></article><div class='y'>{prose(9)}</div></body>" for _ in range(8)])
    assert all("Buy this" not in t and t.count("\n") == 1 for t in out.values())


def test_the_tree_decides_where_names_say_nothing(spark):
    """Without the site style tree the results are others, on pages with an article too."""
    htmls = [f"<body><main><div class='x7'>All stories of the house</div><article><p>{prose(30)}</p><div class='k'>Read the paper at home</div></article></main><div class='z'>Made by us</div></body>" for _ in range(8)]
    out = texts_of(spark, htmls)
    assert all(out[i] != pages.extract(h) and "\n" not in out[i] and out[i] in pages.extract(h) for i, h in enumerate(htmls))


def test_pages_keep_what_the_contract_does_not_name():
    assert pages.extract("<body><article><p>One</p><p hidden>Two</p><div class='more bottom'>Three</div><p>x = <math>y+1</math></p></article></body>") == "One\nTwo\nThree\nx = y+1"


def test_parsing_is_linear():
    import time

    for html in ("<div>" * 60_000 + "x", "<select>" * 40_000 + "x", "<nav><form>" * 20_000 + "x", "<ul><li>" * 30_000 + "x" + "</p></span></b></table>" * 9_000, "<p><b>" * 40_000 + "x"):
        began = time.process_time()
        pages.extract(html)
        assert time.process_time() - began < 5


def test_copies_are_no_furniture(spark):
    copy = f"<body><div class='t'><p>{prose(30)}</p></div><div class='u'>{prose(9)}</div></body>"
    assert all(texts_of(spark, [copy + f"<!-- {i} -->" for i in range(8)]).values())
    out = texts_of(spark, [copy] * 60 + [f"<body><div class='t'><p>{prose(30)}</p></div><div class='u'>{prose(9)}</div></body>" for _ in range(6)])
    assert all(t.count("\n") == 1 for t in out.values())


def test_keyed_tells_rows_apart(docs):
    assert keyed(docs).select("rk").distinct().count() == len(set(TEXTS) | {(0, "")}) - 1


def test_callers_columns_keep_their_values(spark):
    """Names that the operators use inside, with other types, through every stage."""
    long = [prose(200) for _ in range(6)]
    texts_ = [*long, long[0], long[1] + " " + long[2], None, ""]
    names = ["rk", "kept_text", "clean_text", "kept", "n_words", "lost_share", "cid", "label", "spans", "path", "d", "r", "at", "one", "__row", "__at", "__l", "Score"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` {'string' if i % 2 else 'array<int>'}" for i, n in enumerate(names)) + ", n_chars int"
    own = lambda i: tuple(f"{n}{i}" if j % 2 else [i, j] for j, n in enumerate(names))
    df = spark.createDataFrame([(i, t, *own(i), 7) for i, t in enumerate(texts_)], schema)
    items = spark.createDataFrame([(1, " ".join(long[3].split()[20:60]))], "item_id long, text string")
    outs = {"quality": quality.cleaned(df), "near": minhash.deduplicated(df), "substrings": substrings.deduplicated(df), "leaks": decontaminate.clean(df, items)}
    for name, out in outs.items():
        assert out.dtypes == df.dtypes, name
        rows = out.collect()
        assert rows and all(tuple(r[2:-1]) == own(r.doc_id) for r in rows), name
    assert {r.doc_id for r in outs["near"].collect()} == {0, 1, 2, 3, 4, 5, 7, 8, 9}
    assert {r.doc_id for r in outs["leaks"].collect()} == set(range(10)) - {3}


def test_pages_and_labels_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>Hello there</p>", 5, [1], "x", "y")], "page_id long, url string, html string, host long, paths array<int>, text string, n_chars string")
    assert got(pages.extracted(df)) == [(1, "http://a.example/", "Hello there", 11)]
    rows = [(i, prose(30) + (" you idiot!" if i % 3 == 0 else ""), "a", 2, [3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string, fold int, h array<int>")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "t", 1) for i in range(120)], "doc_id long, toxic int, text string, fold int")
    out = toxicity.scored(df, toxicity.trained(df, labels, F.lit(True)))
    assert out.count() == 120 and out.where("score >= 0.5").count() == 40


def test_hot_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Two thousand different texts from one: rows made follow the number of texts, and no link is lost."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.choice((2, 4, 8, 12))):
            w[rng.randrange(len(w))] = rng.choice(["the", "of", "and", f"v{rng.randrange(3000)}"])
        rows.append((i, " ".join(w)))
    made, plain = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))
    out = {r.doc_id: r.component_id for r in minhash.grouped(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert sum(made) < 30 * len(rows)
    s = [frozenset(zip(t.split(), t.split()[1:])) for _, t in rows]
    group = list(range(len(s)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if root(i) != root(j) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert out == {i: root(i) for i in range(len(s))}


def test_bpe_trees_in_a_registered_run(spark, tmp_path):
    """Long unsplit texts and every kind of character, through the registered query."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    every = ["".join("a" + chr(c) + "'s" for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x110000, 8192)]
    unsplit = ["".join(R.choice("abcdefghijklmnop日本語éß'.1<|>") for _ in range(n)) for n in (33, 500, 20_000)] + ["x<|endoftext|>" * 50]
    rows = list(enumerate(every + unsplit))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.query(spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        assert out[i] == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
    b = bpe.Bpe(bpe.tokenizer_path())
    b.encode(unsplit[2])
    assert b.joins > 500


def test_bpe_cache_is_bounded_by_bytes():
    b = bpe.Bpe(bpe.tokenizer_path(), cache=200_000)
    for i in range(300):
        b.learn({f"{i}x{j}".encode() * 40 for j in range(20)})
        assert b.held < 400_000
