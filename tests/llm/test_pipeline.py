"""The pipeline stage by stage against plain computations, and its columns."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import DOCUMENT
from tests.llm.test_native import brute_groups
from tests.llm.test_similar import five_words
from tests.llm.test_texts import slow_measure
from tidemark.llm import queries
from tidemark.llm.common import written


def rules_failed(text):
    words, chars, symbols, dups, repeats = slow_measure(text)
    lines = sum(1 for line in text.split("\n") if line.strip(" \t\v\f\r"))
    return (
        words < 50
        or repeats / words > 0.5
        or 100 * symbols > 10 * words
        or 2 * dups > lines
        or not 3 * words <= chars <= 10 * words
    )


def condemned_hosts(rows):
    """Hosts whose failure rate, drawn to that of all documents by the fitted beta prior, is above 0.8."""
    docs, failed = Counter(), Counter()
    for _, text, host in rows:
        docs[host] += 1
        failed[host] += rules_failed(text or "")
    every, mean = sum(docs.values()), sum(failed.values()) / sum(docs.values())
    chance = mean * (1 - mean)
    strength = 1.0
    if chance:
        # What the hosts' rates vary beyond counting, weighted by documents.
        beyond = sum(failed[h] ** 2 / docs[h] for h in docs) / every - mean**2 - len(docs) * chance / every
        strength = min(1e6, max(1.0, chance / beyond - 1)) if beyond > 0 else 1e6
    return {h for h in docs if (failed[h] + mean * strength) / (docs[h] + strength) > 0.8}


def plain_pipeline(rows):
    """(id, text, source) left after the first three stages: all quality rules, exact copies, five words at 0.8."""
    bad = condemned_hosts(rows)
    rows = [r for r in rows if not rules_failed(r[1] or "") and r[2] not in bad]
    kept = []
    for members in brute_groups(rows).values():
        kept.append(max((rows[i] for i in members), key=lambda r: (r[0] is not None, r[0] or 0)))
    sets, label = [five_words(r[1]) for r in kept], list(range(len(kept)))
    for i, j in combinations(range(len(kept)), 2):
        if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for r, g in zip(kept, label, strict=True):
        groups[g].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_stages(spark, odd, small, name):
    docs = small if name == "documents" else odd
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    out, at = docs, []
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, SF), "test")
        at.append(out)
    assert all(x.columns == docs.columns for x in at[:-1])
    near = [(r["doc_id"], r["text"], r["source"]) for r in at[2].collect()]
    assert Counter(near) == Counter(plain_pipeline(rows))
    mixed = Counter((r["doc_id"], r["text"]) for r in at[3].collect())
    assert set(mixed) <= {r[:2] for r in near} and max(mixed.values()) <= 3
    packed = Counter(r["doc_id"] for r in at[4].filter("piece = 0").collect())
    assert packed == Counter(k[0] for k, n in mixed.items() for _ in range(n))


def test_run_equals_its_stages(spark, small):
    out = small
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, SF), "test")
    drawn = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, queries.QUERIES["pipeline"](spark, SF).select(*drawn).collect())) == Counter(
        map(tuple, out.select(*drawn).collect())
    )


def test_empty(spark):
    docs = spark.createDataFrame([], DOCUMENT)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
    assert docs.count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
