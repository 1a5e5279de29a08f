r"""LM scoring with a probabilistic suffix tree over words.

Contexts are the last one or two words, of variable length: whatever the corpus holds ``LEAST`` times is a candidate,
as context and as successor, so the tree grows with the corpus.  A context's next-word distribution lists the successors
whose frequency after it diverges from what its longest kept suffix says (``STEP`` nats over their occurrences, each left
out once), with absolute discounting; all other words share what is left in proportion to the suffix's distribution.  A
context is kept if the whole distribution gains ``GAIN`` nats.  The root is the add-one unigram distribution.  Every
token is scored by the longest kept suffix of what stands before it in its text.

The tree is a table.  A token's log ratio to the root is a sum of what its last one, two and three words add, as a listed
successor or as a context, so a row of the tree is a word sequence and its weight, and a text's score is a join.  Texts
are coded as word names once.  What is broadcast has a fixed size and decides nothing: the ``HEAD`` most frequent words and
up to ``HOT`` most frequent sequences, which would be hot keys of joins, and a bit map that says of most sequences that
they are in no table (a full one says less and costs time only).  Words and sequences are told apart by names of 63 and
64 bits.

Defined results for odd input: a null or empty text is the end token alone; a null doc_id counts as the text
'null' for the split and is kept as it is; repeated rows are counted and scored one by one; columns besides
doc_id and text are not read; with no training rows N and V are 0 and every token has probability 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bit_map, marked
from .common import dropped, slices, stored, texts
from .repeats import mix

LEAST = 3  # one occurrence is left out, and what is then left should be no single sighting
GAIN = 8.0
STEP = 4.0
DISCOUNT = 0.75
HEAD = 1 << 18
HOT = 1 << 19
END_WORD = b"\r"  # no word holds white space


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(7)) == 2


# -- counting ----------------------------------------------------------------------------------------------


def _id(word: bytes) -> int:
    """A word's name: negative, so that ranks can stand for the most frequent ones."""
    return (xxhash.xxh3_64_intdigest(word) | 1 << 63) - (1 << 64)


END = _id(END_WORD)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        name = _id(word)
        if len(self) < 300_000:
            self[word] = name
        return name


def coded(docs: DataFrame) -> DataFrame:
    """doc_id, rk, train and the names of all tokens as 64-bit integers, the end token among them."""

    def run(batches):
        get = _Ids().__getitem__
        for batch in batches:
            for part in slices(batch):
                codes = [np.fromiter(map(get, [*t.lower().split(), END_WORD]), np.int64).tobytes() for t in texts(part)]
                yield pa.RecordBatch.from_pydict({c: part.column(part.schema.get_field_index(c)) for c in ("doc_id", "rk", "train")} | {"ids": pa.array(codes, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "rk", "train", "text").mapInArrow(run, f"doc_id {kind}, rk long, train boolean, ids binary")


def word_counts(codes: DataFrame) -> DataFrame:
    """(id, c) over all tokens."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for b in batch.column(0).to_pylist():
                held.append(np.frombuffer(b, np.int64))
                size += len(held[-1])
                if size > 1_500_000:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    return codes.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    ids, c = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_pydict({"id": pa.array(ids), "c": pa.array(c.astype(np.int64))})


class Table:
    """Sorted names, found by their leading bits; the names are spread evenly, so a few steps are enough."""

    BITS = 18

    def __init__(self, names: np.ndarray):
        self.names = names
        heads = np.arange((1 << self.BITS) + 1, dtype=np.float64) * 2.0 ** (64 - self.BITS)
        self.first = np.searchsorted(names, heads[:-1].astype(np.uint64)).astype(np.int64)
        self.first = np.append(self.first, len(names))

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of names, and which are there."""
        if not len(self.names):
            return np.zeros(len(name), np.int64), np.zeros(len(name), bool)
        head = (name >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        held = self.names[np.minimum(at, len(self.names) - 1)]
        ok = (held == name) & (at < end)
        rest = np.flatnonzero((held < name) & (at + 1 < end))
        step = 0
        while len(rest):
            step += 1
            place = at[rest] + step
            held, wanted = self.names[place], name[rest]
            hit = held == wanted
            at[rest[hit]] = place[hit]
            ok[rest[hit]] = True
            rest = rest[(held < wanted) & (place + 1 < end[rest])]
        return at, ok


class Head:
    """The most frequent words: names to ranks from 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, -counts))
        self.counts = np.concatenate([[0], counts[order]])
        names = mix(ids[order].view(np.uint64))
        by_name = np.argsort(names)
        self.table, self.ranks = Table(names[by_name]), by_name + 1

    def ranked(self, ids: np.ndarray) -> np.ndarray:
        """Ranks of head words; zeros and the names of other words stay."""
        at, ok = self.table.find(mix(ids.view(np.uint64)))
        ok &= ids < 0
        return np.where(ok, self.ranks[np.minimum(at, len(self.ranks) - 1)], ids) if len(self.ranks) else ids


def _joined(part: pa.RecordBatch, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch of texts, two zeros before each, so that no sequence crosses texts; and the texts' lengths."""
    codes = [np.frombuffer(b, np.int64) for b in part.column(part.schema.get_field_index("ids")).to_pylist()]
    gap = np.zeros(2, np.int64)
    out = np.concatenate([x for c in codes for x in (gap, c)]) if codes else gap[:0]
    return head.ranked(out), np.array([len(c) for c in codes], np.int64)


def _name(*words: np.ndarray) -> np.ndarray:
    """64-bit names of sequences of two or three words."""
    with np.errstate(over="ignore"):
        h = words[0].astype(np.uint64)
        for w in words[1:]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64) + np.uint64(len(words)))
    return h


def _sequences(a: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the last words of all sequences of n words, and the words."""
    ok = np.ones(max(0, len(a) - n + 1), bool)
    for k in range(n):
        ok &= a[k : k + len(ok)] != 0
    first = np.flatnonzero(ok)
    return first + n - 1, [a[first + k] for k in range(n)]


def counted(codes: DataFrame, head, n: int, pairs=None) -> DataFrame:
    """(u, v, w, c), or without w, of all sequences of n words seen ``LEAST`` times."""
    names = ["u", "v", "w"][:n]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "ids", 4 << 20):
                words = _sequences(_joined(part, head.value)[0], n)[1]
                if pairs is not None:  # a sequence is no more frequent than its parts
                    ok = marked(pairs.value, _name(*words[:2]))
                    ok[ok] = marked(pairs.value, _name(*(w[ok] for w in words[1:])))
                    words = [w[ok] for w in words]
                held.append(words)
                size += len(words[0])
                if size > 1_500_000:
                    yield _totals(names, held)
                    held, size = [], 0
        if held:
            yield _totals(names, held)

    found = codes.select("ids").mapInArrow(run, ", ".join(f"{x} long" for x in names) + ", c long")
    return found.groupBy(*names).agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST)


def _totals(names: list[str], held: list[list[np.ndarray]]) -> pa.RecordBatch:
    words = [np.concatenate(w) for w in zip(*held, strict=True)]
    _, at, c = np.unique(_name(*words), return_index=True, return_counts=True)
    return pa.RecordBatch.from_pydict({x: pa.array(w[at]) for x, w in zip(names, words, strict=True)} | {"c": pa.array(c.astype(np.int64))})


# -- what is broadcast ------------------------------------------------------------------------------------


def _named(rows: DataFrame, words: list[str], *more: str) -> DataFrame:
    """``more`` columns with the names of the sequences."""

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_pydict({"name": pa.array(_name(*(col(w).to_numpy() for w in words)).view(np.int64))} | {c: col(c) for c in more})

    return rows.select(*words, *more).mapInArrow(run, "name long" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more))


def _frequent(table: DataFrame, most: int) -> Column:
    """Condition that at most ``most`` rows of a table with counts c meet: the most frequent ones."""
    level, held, least = F.floor(8 * F.log2("c")).cast("int"), 0, None
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r[1]
        if held > most:
            break
        least = r[0]
    return level >= least if least is not None else F.lit(False)


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Left join of a word id with a table (id, ...): the head's part is broadcast, and only rare words are dealt out.

    ``rows`` and ``table`` are stored tables, or unions of them: they are read for each part.
    """
    table = table.select(*(F.col(c).alias(key if c == "id" else c) for c in table.columns))
    inside = F.col(key) > 0
    return rows.where(inside).join(F.broadcast(table.where(inside)), key, "left").unionByName(rows.where(~inside).join(table.where(~inside).hint("shuffle_merge"), key, "left"))


# -- the tree ----------------------------------------------------------------------------------------------


def _grow(successors: list[dict[int, int]], totals: list[int], parents: list[int], root: np.ndarray, states: list[tuple[dict[int, float], float]]) -> list[int]:
    """The rule on plain dictionaries (tests hold ``learned`` against it): test candidates of one length; kept ones join ``states`` as (log ratios to the root, log of the rest's)."""

    def log_p(state: int, word: int) -> float:
        listed, rest = states[state] if state >= 0 else ({}, 0.0)
        return root[word] + listed.get(word, rest)

    out = []
    for c, n, parent in zip(successors, totals, parents, strict=True):
        gain, mass, taken, listed = 0.0, 0.0, 0.0, {}
        for word, k in c.items():
            below = log_p(parent, word)
            step = k * (np.log(max(k - 1 - DISCOUNT, 1e-9) / n) - below)
            if step >= STEP:
                gain += step
                listed[word] = np.log((k - DISCOUNT) / n) - root[word]
                mass += (k - DISCOUNT) / n
                taken += np.exp(below)
        left = n - sum(c[w] for w in listed)
        rest = np.log(max(1 - mass, 1e-9) / max(1 - taken, 1e-9))
        if not listed or gain + left * rest < GAIN:
            out.append(parent)
            continue
        # Words that the suffix lists but this context does not keep the suffix's ratio, times the rest.
        inherited, beyond = states[parent] if parent >= 0 else ({}, 0.0)
        listed = {w: x + rest for w, x in inherited.items()} | listed
        out.append(len(states))
        states.append((listed, beyond + rest))
    return out


def _tested(rows: DataFrame) -> DataFrame:
    """Rows that their context lists, by count c of n and by log probability ``below`` that the suffix gives."""
    rows = rows.withColumn("step", F.col("c") * (F.log(F.greatest(F.col("c") - 1 - DISCOUNT, F.lit(1e-9)) / F.col("n")) - F.col("below")))
    return rows.where(F.col("step") >= STEP)


def _kept(listed: DataFrame, context: list[str]) -> DataFrame:
    """(context, rest, most) of the contexts that gain enough; ``rest`` is what words that they don't list get."""
    sums = listed.groupBy(*context).agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.sum("step").alias("gain"), F.sum((F.col("c") - DISCOUNT) / F.col("n")).alias("mass"), F.sum(F.exp("below")).alias("taken"))
    sums = sums.withColumn("rest", F.log(F.greatest(1 - F.col("mass"), F.lit(1e-9)) / F.greatest(1 - F.col("taken"), F.lit(1e-9))))
    return sums.where(F.col("gain") + (F.col("n") - F.col("c")) * F.col("rest") >= GAIN).select(*context, "rest")


def learned(codes: DataFrame, head, words: DataFrame, total: int, distinct: int) -> tuple[DataFrame, DataFrame]:
    """(id, rest) of words and (name, weight, c) of longer sequences, natural logs: the tree of all rows of ``codes``.

    ``words`` has (id, c).
    """
    given = F.log((F.col("c") - DISCOUNT) / F.col("n")) - F.col("below")  # a listed word's ratio to the suffix
    pairs = stored(counted(codes, head, 2), "pairs")
    own = _looked_up(pairs, "u", words.select("id", F.col("c").alias("n")))
    own = _looked_up(own, "v", words.select("id", F.log((F.col("c") + 1) / max(1, total + distinct + 1)).alias("below")))
    own = stored(own.select("u", "v", "c", "n", "below"), "pair-rows")
    dropped(pairs)
    first = stored(_kept(_tested(own), ["u"]).withColumnRenamed("u", "id"), "words-kept")
    step = F.col("c") * (F.log(F.greatest(F.col("c") - 1 - DISCOUNT, F.lit(1e-9)) / F.col("n")) - F.col("below"))
    known = _looked_up(own, "u", first)
    known = known.withColumn("ratio", F.when(F.col("rest").isNull(), 0.0).when(step >= STEP, given).otherwise(F.col("rest")))
    pairs = stored(known.select("u", "v", "c", (F.col("below") + F.col("ratio")).alias("log_p"), (F.col("ratio") - F.coalesce("rest", F.lit(0.0))).alias("own")), "pair-weights")
    dropped(own)
    bits = bit_map(_named(pairs, ["u", "v"]))
    longer = stored(counted(codes, head, 3, bits), "triples")
    told = longer.join(pairs.select("u", "v", F.col("c").alias("n")), ["u", "v"]).join(pairs.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("log_p").alias("below")), ["v", "w"])
    listed = stored(_tested(told), "triples-listed")
    dropped(longer)
    second = stored(_kept(listed, ["u", "v"]), "pairs-kept")
    third = listed.join(second, ["u", "v"])
    two = pairs.join(second, ["u", "v"], "left").withColumn("weight", F.col("own") + F.coalesce("rest", F.lit(0.0)))
    three = third.withColumn("weight", given - F.col("rest"))
    tree = stored(_named(two.where("weight <> 0"), ["u", "v"], "weight", "c").union(_named(three, ["u", "v", "w"], "weight", "c")), "tree")
    dropped(pairs, listed, second)
    return first, tree


# -- scoring -----------------------------------------------------------------------------------------------

TEXT, WORD, SEQUENCE = 0, 1, 2


def scored(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, rk, n_tokens, n_known, train_tokens, base_score, score of every row; ``train`` picks what is learned from."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train.alias("train")).withColumn("rk", F.xxhash64("doc_id", "text"))
    codes = stored(coded(docs), "codes")
    words = stored(word_counts(codes.where("train")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # By a least count, so that no task has to order all words.
    top = words.where(_frequent(words, HEAD)).toArrow()
    head = spark.sparkContext.broadcast(Head(top.column("id").to_numpy(), top.column("c").to_numpy()))
    counts = head.value.counts

    def ranked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": pa.array(head.value.ranked(batch.column(0).to_numpy())), "c": batch.column(1)})

    ids = stored(words.select("id", "c").mapInArrow(ranked, "id long, c long"), "word-ids")
    dropped(words)
    first, tree = learned(codes.where("train"), head, ids, total, distinct)
    rests = np.zeros(len(counts))
    kept = first.where("id > 0").toArrow()
    rests[kept.column("id").to_numpy()] = kept.column("rest").to_numpy() / np.log(10)
    hot = _frequent(tree, HOT)
    top = tree.where(hot).select("name", "weight").toArrow()
    names = top.column("name").to_numpy().view(np.uint64)
    order = np.argsort(names)
    sent = spark.sparkContext.broadcast((rests, Table(names[order]), top.column("weight").to_numpy()[order] / np.log(10), np.log10(counts + 1.0)))
    cold = tree.where(~hot)
    bits = bit_map(cold)

    def run(batches):
        """A row for each text, and one for each of its rare words and sequences that may be in the rest of the tree."""
        rests, names, weights, logs = sent.value
        for batch in batches:
            for part in slices(batch, "ids", 4 << 20):
                ids, sizes = _joined(part, head.value)
                if not len(sizes):
                    continue
                ends = np.cumsum(sizes + 2)
                begins = ends - sizes
                owner = np.repeat(np.arange(len(sizes)), sizes + 2)
                rank = np.maximum(ids, 0)  # 0: what is not in the head
                own = rests[rank]
                seen = [(np.full(len(at := np.flatnonzero(ids < 0)), WORD), owner[at], ids[at])]
                for n in (2, 3):
                    last, seq = _sequences(ids, n)
                    name = _name(*seq)
                    at, ok = names.find(name)
                    own[last[ok]] += weights[at[ok]]
                    ok = ~ok
                    ok[ok] = marked(bits.value, name[ok])
                    seen.append((np.full(int(ok.sum()), SEQUENCE), owner[last[ok]], name[ok].view(np.int64)))
                adds, base, inside = (np.concatenate([[0], np.cumsum(x)]) for x in (own, logs[rank], ids > 0))
                of = lambda x: x[ends] - x[begins]
                kind, row, key = (np.concatenate(x) for x in zip(*seen, strict=True))
                rows = len(sizes)
                text = pa.StructArray.from_arrays([pa.array(sizes), pa.array(of(inside).astype(np.int64)), pa.array(of(base)), pa.array(of(adds))], ["n_tokens", "n_head", "base", "score"])
                rk = part.column(part.schema.get_field_index("rk"))
                yield pa.RecordBatch.from_pydict({
                    "rk": rk.take(pa.array(np.concatenate([np.arange(rows), row]))),
                    "kind": pa.array(np.concatenate([np.full(rows, TEXT), kind]).astype(np.int8)),
                    "key": pa.array(np.concatenate([rk.to_numpy(), key])),
                    "text": text.take(pa.array(np.arange(rows + len(kind)), mask=np.arange(rows + len(kind)) >= rows)),
                })

    parts = codes.mapInArrow(run, "rk long, kind byte, key long, text struct<n_tokens:long,n_head:long,base:double,score:double>")
    rare = ids.where("id < 0").join(first.where("id < 0"), "id", "left")
    held = rare.select(F.lit(WORD).cast("byte").alias("kind"), F.col("id").alias("key"), F.log10(F.col("c") + 1).alias("base"), F.coalesce(F.col("rest") / np.log(10), F.lit(0.0)).alias("score"))
    held = held.union(cold.select(F.lit(SEQUENCE).cast("byte"), "name", F.lit(0.0), F.col("weight") / np.log(10)))
    found = parts.join(held.hint("shuffle_merge"), ["kind", "key"], "left").where((F.col("kind") == TEXT) | F.col("base").isNotNull())
    # Rows that repeat an id and a text add alike: a mean over the copies is each copy's value.
    copies = F.sum((F.col("kind") == TEXT).cast("long"))
    sums = found.groupBy("rk").agg(
        F.max("text.n_tokens").alias("n_tokens"), F.max("text.n_head").alias("n_head"), F.round(F.sum((F.col("kind") == WORD).cast("long")) / copies).cast("long").alias("known"),
        (F.max("text.base") + F.coalesce(F.sum("base"), F.lit(0.0)) / copies).alias("base"), (F.max("text.score") + F.coalesce(F.sum("score"), F.lit(0.0)) / copies).alias("score"),
    )
    out = codes.select("doc_id", "rk", "train").join(sums, "rk")
    out = out.withColumn("base_score", F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1))))
    return out.select("doc_id", "rk", "train", "n_tokens", (F.col("n_head") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("score")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, ~held_out(docs["doc_id"]))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

