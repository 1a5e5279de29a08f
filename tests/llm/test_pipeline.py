"""The whole pipeline against a brute-force version of it."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from veldspar.llm import bpe, decontaminate, quality

R = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join("".join(R.choice("aeioutnrsl") for _ in range(R.randint(2, 7))) for _ in range(n)) + "."


def made():
    shared, item = prose(60), prose(40)
    docs = [(i, prose(R.randint(60, 120)) + "\n" + prose(30)) for i in range(30)]
    docs += [(100 + i, docs[i][1]) for i in range(4)]
    docs += [(110 + i, docs[i][1].replace("a", "a ", 1)) for i in range(4)]
    docs += [(120 + i, prose(60) + "\n" + shared + "\n" + prose(20)) for i in range(3)]
    docs += [(130, prose(70) + "\n" + item), (131, "short."), (132, None), (133, " ".join(f"| w{i}" for i in range(80))), (134, "same words again " * 40)]
    docs += [(135, prose(70) + "\n" + "All rights reserved.\nok\n" + prose(9)), (136, docs[7][1]), (7, docs[7][1])]
    return docs, [(1, item), (2, prose(30))]


def cleaned(text):
    w = text.encode().split()
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return None
    keep = []
    for line in text.split("\n"):
        n = len(line.encode().split())
        bars, marks, shouts = line.count("|"), sum(line.count(x) for x in "#*$%&<>"), line.count("!!")
        closed = line.rstrip(" \t\n\x0b\x0c\r")[-1:] in tuple(quality.CLOSING)
        furniture = n <= 25 and any(p in line.lower() for p in quality.BOILERPLATE)
        if not n or not (bars >= 3 and bars >= 0.3 * n or marks >= 3 and marks > 0.3 * n or shouts >= 2 and shouts > 0.3 * n or not closed and n < 3 or furniture):
            keep.append(line)
    held = sum(len(x.decode()) for line in keep for x in line.encode().split())
    return "\n".join(keep) if held >= 0.5 * sum(len(x.decode()) for x in w) else None


def brute(docs, items):
    docs = [(d, c) for d, t in docs if (c := cleaned(t or "")) is not None]
    sets = [frozenset(zip(*[t.encode().lower().split()[k:] for k in range(5)])) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    docs = [min((docs[i] for i in range(len(docs)) if group[i] == g), key=lambda x: x[0]) for g in sorted(set(group))]
    words = [t.encode().split() for _, t in docs]
    heads = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(docs, words):
        gone = {i + k for i in range(len(w) - 34) if heads[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return [(d, t) for d, t in out if not any(decontaminate.normal(x) in decontaminate.normal(t) for _, x in items)]


def test_pipeline(spark, tmp_path):
    docs, items = made()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for d, text in brute(docs, items):
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), t.decode(ids, skip_special_tokens=False)))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


def test_stages_keep_columns(spark, tmp_path):
    docs, items = made()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in docs[:12]], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
