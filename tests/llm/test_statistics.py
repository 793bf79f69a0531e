"""Periodic runs, the filter audit and language-model scores: brute force, SQL, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tripwire.llm import audit, loglinear, runs
from tripwire.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LONG = "ab cd ab cd ab " * 9_000 + "end"
EDGES = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, LONG, "en"), (5, "The cat sat. " * 6, None), (5, "The cat sat. " * 6, None), (None, "The cat sat. " * 6, "en"), (None, None, None),
    (7, "A A A A A A b", "en"), (8, "x y x y x y x y x y z\x0bz z z z z z", "fr"), (9, "CAPITALS ONLY | $", ""), (-3, "q " * 7 + "r " * 7, "xx"), (11, "The cat sat. " * 6, "fr"), (12, "", None),
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def edges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGES, "doc_id long, text string, lang string")
    return rows.withColumn("n_runs", F.lit("clash")).withColumn("word", F.lit(1)).withColumn("part", F.lit(2)).withColumn("words", F.lit(3)).withColumn("n", F.lit(4)).withColumn("runs", F.lit(5))


def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def random_words(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        passage = [rng.randrange(rng.choice((2, 4, 900))) for _ in range(rng.randrange(1, 24))]
        out += (passage * 9)[: rng.randrange(1, 9 * len(passage))] + [rng.randrange(9) for _ in range(rng.randrange(3))]
    return out


def test_runs_are_those_of_brute_force():
    rng, many = random.Random(4), 0
    for case in range(400):
        words = random_words(rng) if case % 4 else [rng.randrange(2) for _ in range(rng.randrange(130))]
        got = sorted(zip(*(x.tolist() for x in runs.find(np.array(words, np.uint64))), strict=True))
        assert got == brute_runs(words), words
        many += len(got)
    assert many > 300


def test_runs_of_other_exponents():
    rng = random.Random(6)
    for _ in range(60):
        words = random_words(rng)
        for times in (3, 5):
            got = sorted(zip(*(x.tolist() for x in runs.find(np.array(words, np.uint64), None, 4, times)), strict=True))
            assert got == brute_runs(words, 4, times)


def test_transforms_convolve_exactly():
    rng = np.random.default_rng(2)
    for prime in runs.PRIMES:
        a, b = (rng.integers(0, prime, (3, 16), dtype=np.uint64) for _ in range(2))
        got = runs.back(runs.transform(a, prime) * runs.transform(b, prime) % np.uint64(prime), prime)
        expected = [[sum(int(x[i]) * int(y[(k - i) % 16]) for i in range(16)) % prime for k in range(16)] for x, y in zip(a, b, strict=True)]
        assert got.tolist() == expected


def test_long_sequences_take_all_primes_and_little_time():
    found = runs.find(np.tile(np.arange(90_000, dtype=np.uint64), 5))
    assert [x.tolist() for x in found] == [[0], [450_000], [90_000]]
    assert [x.tolist() for x in runs.find(np.zeros(300_000, np.uint64))] == [[0], [300_000], [1]]


def brute_collapse(doc_id, text):
    words, n = words_of(text), len(words_of(text))
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_runs_query_equals_brute_force(spark, edges, tmp_path):
    rng = random.Random(9)
    rows = [x for x in EDGES if x[1] != LONG] + [(100 + k, " ".join(f"w{x}" for x in random_words(rng)), "en") for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "words").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    expected = [brute_collapse(k, text) for k, text, _ in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert sum(x[1] > 0 for x in expected) > 60 and sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows) > 5


def test_collapse_edges(spark, edges):
    got = runs.collapse(edges)
    assert got.columns == ["doc_id", "runs", "collapsed"] and runs.collapse(edges.limit(0)).count() == 0
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(EDGES) and rows[1].runs == [] and rows[1].collapsed == "" and rows[3].collapsed == ""
    assert [tuple(x) for x in rows[4].runs] == [(0, 45_000, 5)] and rows[4].collapsed == "ab cd ab cd ab end"
    assert [tuple(x) for x in rows[7].runs] == [(0, 6, 1)] and rows[7].collapsed == "A b"
    assert [tuple(x) for x in rows[-3].runs] == [(0, 7, 1), (7, 7, 1)] and rows[-3].collapsed == "q r"


def brute_audit(documents, labels):
    good, toxic = ({k for k, *flags in labels if k is not None and flags[c] == 1} for c in (0, 1))
    smallest = {}
    for k, text, _ in documents:
        if k is not None:
            smallest[text or ""] = min(k, smallest.get(text or "", k))
    fails = []
    for k, text, lang in documents:
        text, words = text or "", words_of(text)
        conditions = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), k is not None and smallest[text] < k
        fails.append((lang or "", {x for x, c in zip("ABCDE", conditions, strict=True) if c}, k in good, k in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        own, total = [x for x in fails if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                here = [x for x in own if letter in x[1] and not x[1] & set(order[:step])]
                total[letter] += len(here)
                out[part, "".join(order), step + 1] = (
                    sum(not x[1] & set(order[: step + 1]) for x in own), len(here), sum(letter in x[1] for x in own) - len(here), sum(x[1] == {letter} for x in own), sum(x[2] for x in here), sum(x[3] for x in here),
                )
        for key in [x for x in out if x[0] == part]:
            out[key] += (total[key[1][key[2] - 1]],)
    return out


def test_audit_equals_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("word", "Word", "WORD", "w$rd", f"w{rng.random()}")) for _ in range(rng.choice((3, 120, 200)))) for _ in range(40)] + ["", None]
    rows = [x for x in EDGES] + [(200 + k, rng.choice(texts), rng.choice(("en", "fr", None, ""))) for k in range(400)]
    rows += rows[-30:]
    labels = [(200 + k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 400, 2)] + [(200, 1, 1), (None, 1, 1), (5, 1, 0)]
    from pyspark.sql import functions as F

    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("quality", F.lit(1)).withColumn("mask", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op12_filter_audit"](spark, str(tmp_path))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*audit.COUNTED, "shapley")) for r in got.collect()}
    expected = brute_audit(rows, labels)
    assert found == expected and got.count() == len(expected) == 600 * 4
    with duckdb.connect() as db:
        for name in ("documents", "labels"):
            db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        result = db.execute(ORACLES["op12_filter_audit"])
        names = [x[0] for x in result.description]
        assert sorted(names) == sorted(got.columns)
        by_sql = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*audit.COUNTED, "shapley")) for r in (dict(zip(names, x, strict=True)) for x in result.fetchall())}
    assert by_sql == expected


def test_audit_of_empty_tables(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(edges.limit(0).drop("words", "part", "n"), labels).count() == 0
    rows = audit.audit(edges, labels).collect()
    assert len(rows) == 600 * 4 and all(r.good_lost == r.toxic_lost == 0 for r in rows)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*words_of((text or "").translate(LOWER)), None]


def is_held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


def brute_base(rows):
    count = Counter(w for k, text in rows if not is_held_out(k) for w in tokens_of(text))
    total, distinct = sum(count.values()), len(count)
    score = lambda w: math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    return [(k, is_held_out(k), len(own := tokens_of(text)), sum(count[w] > 0 for w in own), total, sum(map(score, own))) for k, text in rows]


def compared(got, rows):
    by_key = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=by_key)
    expected = sorted(brute_base(rows), key=by_key)
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    assert np.allclose([x[5] for x in got], [x[5] for x in expected], rtol=1e-9)


def test_base_scores_are_exact_whatever_the_head(spark, edges, monkeypatch):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = documents.unionByName(edges.select("doc_id", "text"))
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    for words, unseen, flush in ((100_000, 1_000, 200_000), (40, 2, 50), (0, 0, 1000)):
        monkeypatch.setattr(loglinear, "HEAD_WORDS", words)
        monkeypatch.setattr(loglinear, "UNSEEN_WORDS", unseen)
        monkeypatch.setattr(loglinear, "COUNTED_WORDS", flush)
        compared(loglinear.score(rows.repartition(3)).collect(), texts)


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    got = loglinear.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert len(held) > 80 and sum(r.score - r.base_score for r in held) / tokens > 0.04  # in log10 a token


def test_probabilities_of_all_tokens_sum_to_one():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(900)]
    count = rng.integers(2, 400, 900)
    # 70 words beyond the head, with 90 occurrences in all
    seen = loglinear.Vocabulary.of(words, count, ["new"], int(count.sum()) + 90, 970, 50)
    model = loglinear.Model(seen.weight)
    trainer = loglinear.Trainer(model, 0)
    inputs = np.append(seen.inputs[rng.integers(0, 900, 5_000)], 0)
    trainer.learn(loglinear.contexts(inputs), np.append(seen.classes[rng.integers(0, 900, 5_000)], 0))
    assert not np.allclose(model.classes, 0) and len(seen.weight) <= loglinear.CLASSES
    # one context, followed by each class; within a class by each of its words
    each = np.arange(len(seen.weight))
    p = np.exp(model.log_probabilities([np.full(len(each), 5), np.full(len(each), 9)], each))
    assert p.sum() == pytest.approx(1, abs=1e-6)
    inside = np.bincount(seen.classes[:900], seen.count[:900] + 0.1, len(seen.weight))
    inside[0] += 50.1
    inside[-1] += 90 + 0.1 * 70 + 0.1
    assert np.allclose(inside, seen.weight)
    assert seen.n_tokens == count.sum() + 140 and seen.n_distinct == 971


def test_contexts_stop_at_the_text():
    assert [x.tolist() for x in loglinear.contexts(np.array([3, 4, 0, 5, 0, 0, 6]))] == [[0, 3, 4, 0, 5, 0, 0], [0, 0, 3, 0, 0, 0, 0]]


def test_scores_without_anything_to_learn(spark, edges):
    assert loglinear.score(edges.limit(0)).count() == 0
    held = [k for k in range(300) if is_held_out(k)][:3]
    rows = [(k, "some words here") for k in held]
    got = loglinear.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compared(got, rows)
    assert all(r.score < 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_keys_tell_words_apart_and_tables_find_them():
    rng = random.Random(7)
    words = list({bytes(rng.choices(b"ab", k=rng.choice((1, 2, 7, 8, 9, 15, 16, 17, 24, 25, 40, 700)))) for _ in range(3_000)})
    text = b" ".join(words)
    chunk = loglinear.Words.of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(chunk.keys[0].tolist())) == len(words)
    assert (chunk.keys == loglinear.keys_of(words)).all()  # whatever stands beside a word
    table = loglinear.Table(loglinear.keys_of(words[::2]))
    assert table.find(chunk.keys).tolist() == [k // 2 if k % 2 == 0 else -1 for k in range(len(words))]
    assert loglinear.Table(loglinear.keys_of([])).find(chunk.keys).max() == -1


def test_scores_too_large_for_plain_sums():
    model = loglinear.Model(np.arange(1.0, 20.0))
    model.classes[:] = 40.0
    model.vectors[:] = 1.0
    before = [np.array([3, 4])] * loglinear.CONTEXT
    assert np.isfinite(got := model.log_probabilities(before, np.array([0, 5]))).all()
    assert np.allclose(got, np.log(model.prior[[0, 5]]), atol=1e-3)
