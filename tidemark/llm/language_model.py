"""Scores of whole texts by two language models learned from the training texts of the same table.

* ``base_score``: words by their smoothed frequency among the training texts.
* ``score``: a causal self-attention model on subword ids (:mod:`tidemark.llm.attention`).

Words are counted in one pass, all of them. Texts then meet the counts in two ways with one result: the most frequent words
(``FREQUENT`` at most) are looked up where the text is read, the others are joined by word. The texts' subword ids are
stored once. From them come, over every training text, the tokens' counts and the counts of slots behind slots; what a driver
holds of these is bounded by the vocabulary and the number of slots. The attention model is trained on every token of every
training text, each a target once with the context it has when scored: texts are dealt to rounds, in a round each task trains
from the same weights on all its texts, and Spark averages the weights by the tokens learned from. Tasks follow the splits of
the stored texts, so other splits give slightly other weights.

Cases: a null or empty text is its end alone; with no training texts all counts are zero and the attention reads nothing;
rows of equal id are scored by themselves; an empty table gives no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import attention
from tidemark.llm.common import give_back, packed, unpacked, written
from tidemark.llm.tokens import END, VOCABULARY, blocks, known_pieces, vocabulary_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words looked up where a text is read; their number bounds what is broadcast.
FREQUENT = 1 << 18
#: Steps per doubling of a frequency in the choice of frequent words.
STEPS = 16
#: Rounds of training.
ROUNDS = 4
#: Characters whose words are looked up at a time.
WORDS = 2 << 20
#: Ids counted at a time, ids of texts that are trained on or scored at a time (a longer text by itself).
PART, TOKENS = 1 << 20, 1 << 18
#: Bytes in which an id is stored.
ID = "<u2"


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, A-Z in lower case; of each word in order, its number among them and its text's number."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    found = split.flatten().dictionary_encode()
    at, of = found.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    none = pc.index(found.dictionary, "").as_py()
    if none >= 0:
        at, of = at[at != none], of[at != none]
    return found.dictionary, at, of


def smaller(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, few enough that their words take little memory."""
    for block in blocks(batch):
        at = held = 0
        for k, text in enumerate(block):
            held += len(text)
            if held > WORDS:
                yield block[at : k + 1]
                at, held = k + 1, 0
        yield block[at:]
    give_back()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times in training texts, times); the empty word is the end."""
    for batch in batches:
        train, done = batch["train"].to_numpy(zero_copy_only=False), 0
        for texts in blocks(batch["text"]):
            own = train[done : done + len(texts)]
            done += len(texts)
            words, at, of = words_of(texts)
            times = np.bincount(at, minlength=len(words))
            learnt = np.bincount(at[own[of]], minlength=len(words))
            seen = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.take(pa.array(seen)).cast(pa.string()), pa.array([""])]),
                    pa.array([*learnt[seen], own.sum()], pa.int64()),
                    pa.array([*times[seen], len(texts)], pa.int64()),
                ],
                ["word", "n", "times"],
            )


READ = "struct<n_tokens: long, n_known: long, base: double, rare: array<string>, ids: binary>"


def _read(texts: Iterator[pa.Array], frequent: Broadcast, ends: int, vocabulary: str) -> Iterator[pa.Array]:
    """What the frequent words of each text give, its other words, and its subword ids."""
    table = frequent.value
    known, counts = {w: k for k, w in enumerate(table["word"].to_pylist())}, table["n"].to_numpy()
    logs = np.log10(np.append(counts, 0) + 0.5)
    pieces = known_pieces(vocabulary)
    for batch in texts:
        sizes, n_known, base, rare, ids = [], [], [], [], []
        for block in smaller(batch):
            words, at, of = words_of(block)
            place = (known.get(w, -1) for w in words.to_numpy(zero_copy_only=False))
            found = np.fromiter(place, np.int64, len(words))[at]
            n = np.bincount(of, minlength=len(block))
            sizes.append(n + 1)
            n_known.append(np.bincount(of, np.append(counts, 0)[found] > 0, len(block)).astype(np.int64) + (ends > 0))
            base.append(np.bincount(of[found >= 0], logs[found[found >= 0]], len(block)) + np.log10(ends + 0.5))
            left = found < 0
            bounds = np.concatenate([[0], np.cumsum(np.bincount(of[left], minlength=len(block)))])
            rare.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(at[left])).cast(pa.string())))
            ids += [np.frombuffer(x, "<u4").astype(ID).tobytes() for x in pieces.of_block(block)]
        arrays = [
            pa.array(np.concatenate(sizes), pa.int64()),
            pa.array(np.concatenate(n_known), pa.int64()),
            pa.array(np.concatenate(base)),
            pa.concat_arrays(rare),
            pa.array(ids, pa.binary()),
        ]
        yield pa.StructArray.from_arrays(arrays, ["n_tokens", "n_known", "base", "rare", "ids"])


def sequences(ids: pa.Array, end: int) -> Iterator[np.ndarray]:
    """Ids of texts in a row, an end before the first and behind each; some tokens at a time."""
    last = np.array([end], ID)
    parts, held = [last], 0
    for x in ids:
        text = np.frombuffer(x.as_buffer(), ID)
        for at in range(0, len(text), PART):
            parts.append(text[at : at + PART])
            held += len(parts[-1])
            if held >= PART:
                yield np.concatenate(parts)
                parts, held = [parts[-1][-1:]], 0
        parts.append(last)
    yield np.concatenate(parts)


def _cells(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["cell", "n"])


def _token_counts(batches: Iterator[pa.RecordBatch], size: int, end: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(size, np.int64)
    for batch in batches:
        for ids in sequences(batch["ids"], end):
            counts += np.bincount(ids[1:], minlength=size)
    yield _cells(counts)


def _pair_counts(batches: Iterator[pa.RecordBatch], slot: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
    """Slots behind slots."""
    counts, slot = np.zeros(attention.SLOTS**2, np.int64), slot.astype(np.int32)
    for batch in batches:
        for ids in sequences(batch["ids"], end):
            slots = slot[ids]
            counts += np.bincount(slots[:-1] * attention.SLOTS + slots[1:], minlength=len(counts))
    yield _cells(counts)


CELLS = "cell long, n long"


def summed(parts: DataFrame, cells: int) -> np.ndarray:
    """Counts by cell; the vocabulary and the slots bound their number."""
    found = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def _blocks(batch: pa.Array) -> Iterator[list[np.ndarray]]:
    """Ids of a batch's texts, some tokens at a time."""
    block, held = [], 0
    for x in batch:
        block.append(np.frombuffer(x.as_buffer(), ID))
        held += len(block[-1])
        if held > TOKENS:
            yield block
            block, held = [], 0
    yield block


def _trained(batches: Iterator[pa.RecordBatch], weights: np.ndarray, model: Broadcast, end: int) -> Iterator[pa.RecordBatch]:
    """Weights that one task's texts lead to, times the tokens it learned from."""
    trainer = attention.Trainer(attention.shaped(weights), *model.value)
    for batch in batches:
        for texts in _blocks(batch["ids"]):
            trainer.learn(texts, end)
    if trainer.targets:
        values = attention.flat(trainer.weights).astype(float)
        columns = [np.arange(len(values), dtype=np.int32), values * trainer.targets, np.full(len(values), trainer.targets)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "total", "n"])


def learned(texts: DataFrame, model: Broadcast, end: int) -> np.ndarray:
    """Weights after ``ROUNDS`` rounds of training in tasks and averaging; every text (rid, ids) is learned in one round."""
    weights = attention.flat(attention.start())
    for k in range(ROUNDS):
        dealt = texts.filter(F.pmod(F.xxhash64("rid"), F.lit(ROUNDS)) == k).select("ids")
        train = partial(_trained, weights=weights, model=model, end=end)
        mean = dealt.mapInArrow(train, "at int, total double, n long").groupBy("at")
        mean = mean.agg((F.sum("total") / F.sum("n")).alias("value")).toPandas()
        if len(mean):
            weights[mean["at"].to_numpy()] = mean["value"].to_numpy()
    return weights


def _scores(ids: Iterator[pa.Array], weights: np.ndarray, model: Broadcast, end: int) -> Iterator[pa.Array]:
    scorer = attention.Scorer(attention.shaped(weights), *model.value)
    for batch in ids:
        out = [scorer.scores(block, end) for block in _blocks(batch)]
        yield pa.array(np.concatenate(out) / np.log(10))


def scored(
    docs: DataFrame, train: Column, text_col: str = "text", carry: list[str] | None = None, vocabulary: str = VOCABULARY, end: int = END, frequent: int = FREQUENT
) -> DataFrame:
    """Every row with held_out (not ``train``), n_tokens (words and the end), n_known (of them, seen in training),
    train_tokens, base_score and score (both log10 of a probability). ``frequent`` changes no result."""
    from tokenizers import Tokenizer

    spark, size = docs.sparkSession, Tokenizer.from_file(vocabulary_path(vocabulary)).get_vocab_size()
    if size > 1 << 16:
        raise ValueError("ids are stored in two bytes")
    rows = docs.select(
        packed(docs, carry), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text")
    )
    words = rows.select("train", "text").mapInArrow(_word_counts, "word string, n long, times long")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "words")
    step = F.floor(F.log2("times") * STEPS)
    n, distinct, ends = words.agg(
        F.sum("n"), F.count_if(F.col("n") > 0), F.max(F.when(F.col("word") == "", F.col("n")))
    ).first()
    n, ends, least, held = n or 0, ends or 0, 0, 0
    for at, more in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        if (held := held + more) > frequent:
            least = at + 1
            break
    common = words.filter((step >= least) & (F.col("word") != "")).select("word", "n").toArrow()
    frequent_words = spark.sparkContext.broadcast(common)

    read = F.arrow_udf(_iterated(partial(_read, frequent=frequent_words, ends=ends, vocabulary=vocabulary)), READ)
    texts = rows.select("row", "train", F.monotonically_increasing_id().alias("rid"), read("text").alias("t"))
    texts = written(texts.select("row", "train", "rid", "t.*"), "texts")

    gain = F.sum(F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))).alias("gain")
    others = words.filter((step < least) & (F.col("n") > 0)).select("word", "n")
    rare = texts.select("rid", F.explode("rare").alias("word")).join(others, "word")
    rare = rare.groupBy(F.col("rid").alias("rare_rid")).agg(gain, F.count("*").alias("more"))

    learnt = texts.filter("train").select("rid", "ids")
    counts = summed(learnt.select("ids").mapInArrow(partial(_token_counts, size=size, end=end), CELLS), size)
    of, slot = attention.classes(counts)
    pairs = summed(learnt.select("ids").mapInArrow(partial(_pair_counts, slot=slot, end=end), CELLS), attention.SLOTS**2)
    prior = attention.Prior(counts, of, slot, pairs.reshape(attention.SLOTS, -1))
    model = spark.sparkContext.broadcast((of, slot, prior))
    weights = learned(learnt, model, end)

    score = F.arrow_udf(_iterated(partial(_scores, weights=weights, model=model, end=end)), "double")
    every = texts.withColumn("score", score("ids")).withColumn("unknown", F.size("rare")).drop("ids", "rare")
    out = every.join(rare, F.col("rid") == F.col("rare_rid"), "left")
    base = F.col("base") + F.col("unknown") * F.log10(F.lit(0.5)) + F.coalesce("gain", F.lit(0.0))
    out = out.select(
        "row",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (distinct + 1)))).alias("base_score"),
        "score",
    )
    return unpacked(out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _iterated(fn):
    """``fn`` with the signature by which Spark knows a function of batches."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from fn(batches)

    return of
