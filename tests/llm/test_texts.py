"""Operators on single texts: quality, language, licences, BPE, packing, chat. Brute force, round trips and edge cases."""

import base64
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripwire.llm import batches, bpe, chat, language, license, packing, quality
from tripwire.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "ende"
EDGES = [(1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, LONG, "en"), (5, "The cat sat.", None), (5, "The cat sat.", None), (None, "The cat sat.", "en"), (7, "123 456 !!", "en"), (8, "’tis 'tis 's's don't é 🙂 中文", "fr")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash")).withColumn("ids", F.lit("clash")).withColumn("w", F.lit(1))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, documents, edges):
    for rows in (documents, edges):
        got = quality.judge(rows.drop("n_words")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        expected = sorted((str(k), *(c := brute_counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for k, t in texts_of(rows))
        assert sorted((str(r[0]), *r[1:]) for r in got) == expected


def test_quality_keeps_prose_and_rejects_noise(spark, documents):
    noisy = spark.createDataFrame([(10**6, " | ".join(f"zq{k}x" for k in range(200)), "en", "x", 0), (10**6 + 1, " ".join(f"ZX{k}Q!!" for k in range(200)), "en", "x", 0)], documents.schema)
    got = {r.doc_id: r.kept for r in quality.judge(documents.unionByName(noisy)).collect()}
    assert not got[10**6] and not got[10**6 + 1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    sizes = {k: brute_counts(t) for k, t in texts_of(documents)}
    good = [k for k, q in labels.items() if q == 1 and sizes[k][0] >= 10 and 100 * sizes[k][4] <= 20 * sizes[k][0]]
    assert all(got[k] for k in good)


def test_quality_without_references(spark, edges):
    assert quality.judge(edges.drop("n_words").limit(0)).count() == 0
    bare = quality.judge(edges.drop("n_words").withColumn("lang", F.lit(None).cast("string")))
    assert bare.filter("character_distance is not null").count() == 0 and bare.count() == len(EDGES)


def test_quality_equals_sql_on_more_documents_than_a_sample(spark, tmp_path):
    """Words of a long tail, and a language of one document, over 6,000 documents."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"{lang}{int(rng.random() ** 3 * 400)}" for _ in range(14)), lang) for k in range(6_000) for lang in [rng.choice(("en", "fr"))]]
    rows += [(k, " ".join(f"rare{n % 30}" for n in range(60)), "xx") for k in (7_001,)] + [(8_000, " ".join(f"zq{k}" for k in range(90)), None), (8_001, None, "en"), (8_002, "en1\x0bfr2\u00a0en3 \u4e2d", "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert "rare7" in quality.common_words(table)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_quality_divergence"](spark, str(tmp_path)).toPandas().set_index("doc_id").sort_index()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = db.execute(ORACLES["op1_quality_divergence"]).df().set_index("doc_id").sort_index()
    assert list(got.index) == list(expected.index) and (got["kept"] == expected["kept"]).all() and not got["kept"][8_000]
    for name in ("character_distance", "word_distance"):
        assert np.allclose(got[name].astype(float), expected[name].astype(float), rtol=0, atol=2e-9, equal_nan=True)


def test_common_words_are_counted_across_flushes(spark, monkeypatch):
    rows = [(k, f"every word{k} word{k}", "en") for k in range(60)]
    monkeypatch.setattr(quality, "COUNTED_WORDS", 3)
    assert quality.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 2) == ["every", "word0"]


def test_jensen_shannon_is_a_distance():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert quality.jensen_shannon(p, p[0])[0] == 0 and quality.jensen_shannon(p, q)[0] == pytest.approx(1)


def test_language_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_edges(spark, edges, documents):
    trees = language.train(documents)
    got = language.predict(edges, trees).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert language.train(edges.limit(0)) is None
    assert {r.lang_pred for r in language.predict(edges, None).collect()} == {"und"}
    assert language.accepted(edges, trees).columns == edges.columns


def test_long_texts_are_coded_in_parts(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdé \n") for _ in range(5000)).encode()
    grams = Counter(int.from_bytes(text[i : i + n], "big") | n << 56 for n in range(1, 6) for i in range(2000))
    trees = language.ContextTrees.fit(["x"], np.zeros(len(grams), np.int64), np.array([*grams], np.int64), np.array([*grams.values()]))
    raw, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = trees.bits(raw, ends)
    for size in (7, 100, 4999):
        monkeypatch.setattr(language, "_BYTES_AT_ONCE", size)
        assert trees.bits(raw, ends) == pytest.approx(whole, rel=1e-5)


def test_three_hundred_languages_fit_in_the_memory_of_one_sample():
    """10 kB of each, of words of its own: code lengths are those of a language alone, and tables stay a small multiple of the counts."""
    rng, texts = random.Random(9), []
    for k in range(300):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñøåłžšđğıțāēī", 18)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(400)]
        texts.append(" ".join(rng.choice(words) for _ in range(1_600)).encode()[:10_000])
    lang, gram, n = [], [], []
    for k, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        for size in range(1, language.ORDER + 2):
            grams, counts = np.unique(language._grams(raw, np.arange(len(raw)), size)[1], return_counts=True)
            lang.append(np.full(len(grams), k)), gram.append(grams), n.append(counts)
    lang, gram, n = (np.concatenate(x) for x in (lang, gram, n))
    tracemalloc.start()
    trees = language.ContextTrees.fit([f"l{k:03}" for k in range(300)], lang, gram, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900_000_000
    some = [0, 7, 8, 150, 299]
    raw, ends = np.frombuffer(b"".join(texts[k][-500:] for k in some), np.uint8), np.arange(len(some) + 1) * 500
    bits = trees.bits(raw, ends)
    assert bits.shape == (5, 300) and bits.argmin(1).tolist() == some
    for k in some:
        mine = lang == k
        alone = language.ContextTrees.fit(["x"], np.zeros(mine.sum(), np.int64), gram[mine], n[mine])
        assert alone.bits(raw, ends)[:, 0] == pytest.approx(bits[:, k], rel=1e-6)


def test_every_language_is_learned_from_few_long_documents(spark):
    rows = [(k, "aa", "lorem ipsum dolor sit amet " * 40) for k in range(400)] + [(1001, "bb", "zwölf boxkämpfer jagen viktor " * 9000)]
    trees = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), sample_bytes=60_000)
    assert trees.languages == ["aa", "bb"]


def test_code_lengths_are_those_of_a_walk_through_the_trees():
    rng = random.Random(1)
    train = {"a": "".join(rng.choice("abcd ") for _ in range(400)), "b": "".join(rng.choice("bde ") for _ in range(300))}
    order, rows = 3, Counter()
    for k, text in enumerate(train.values()):
        raw = text.encode()
        for n in range(1, order + 2):
            for i in range(len(raw) - n + 1):
                rows[k, int.from_bytes(raw[i : i + n], "big") | n << 56] += 1
    keys = list(rows)
    trees = language.ContextTrees.fit(["a", "b"], np.array([k for k, _ in keys]), np.array([g for _, g in keys], np.int64), np.array([rows[k] for k in keys]), order)

    def walk(lang, text):
        raw, total = text.encode(), 0.0
        source = list(train.values())[lang].encode()
        for i in range(len(raw)):
            for n in range(min(order, i), -1, -1):
                context = raw[i - n : i]
                after = Counter(source[j + n] for j in range(len(source) - n) if source[j : j + n] == context)
                if not after:
                    continue
                seen, kinds = sum(after.values()), len(after)
                if after[raw[i]]:
                    total -= np.log2(after[raw[i]] / (seen + kinds))
                    break
                total -= np.log2(kinds / (seen + kinds))
            else:
                total += 8
        return total

    texts = ["abcd abcd", "zzz", "", "bdebde x dcba", "a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert trees.bits(raw, offsets) == pytest.approx(np.array([[walk(lang, t) for lang in (0, 1)] for t in texts]), rel=1e-4)


def brute_licence(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(k, label) for phrase, label in license.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licences_equal_brute_force(spark, documents, edges):
    more = [(900, "mit license " * 5000 + "Apache—License MIT LICENSE", "en"), (901, "the Mit License", "en"), (902, "general public license", None)]
    for rows in (documents, edges.drop("n_words").union(spark.createDataFrame(more, "doc_id long, text string, lang string").withColumn("ids", F.lit("")).withColumn("w", F.lit(1)))):
        got = license.scan(rows).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
        assert Counter((str(r[0]), *r[1:]) for r in got) == Counter((str(k), *brute_licence(t)) for k, t in texts_of(rows))


def test_licence_spans_survive_edits(spark):
    notice = license.TEMPLATES[8][1].split()
    cut = " ".join(notice[:7] + ["newly", "added"] + notice[7:])
    half = " ".join(notice[: len(notice) // 3])
    rows = spark.createDataFrame([(1, f"some words before. {cut} and after"), (2, half), (3, "the of and to")], "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan(rows).collect()}
    assert got[1].labels == "bsd" and got[1].score > 0.6 and got[2].labels == "" and got[3].score == 0
    assert license.scan(rows.limit(0)).count() == 0


def test_licence_votes_count_once(spark):
    bsd, mit = license.TEMPLATES[8][1], license.TEMPLATES[2][1]
    words = bsd.split()
    broken = " ".join([*words[:8], "that the following", *words[8:]])
    strayed = " ".join([*words[:8], "some other words", *words[8:]])
    partial = " ".join(words[: len(words) * 2 // 5])
    rows = [(1, "released under the released under the"), (2, broken), (3, strayed), (4, f"{mit} MIT License"), (4, f"{mit} MIT License"), (5, partial), (5, partial), (5, partial), (6, f"x {bsd} y {bsd}")]
    got = sorted((r.doc_id, r.labels, r.n_base, r.n_spans) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "", 0, 0), (2, "bsd", 0, 1), (3, "bsd", 0, 1), (4, "mit", 2, 1), (4, "mit", 2, 1), (5, "", 0, 0), (5, "", 0, 0), (5, "", 0, 0), (6, "bsd", 0, 2)]


def test_bpe_equals_the_library_and_round_trips(spark, documents, edges):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    odd = [(1000 + k, "".join(rng.choice("aabstmdrvle''' \n\t 1é.!中\u3000\u00a0🙂") for _ in range(rng.randrange(40)))) for k in range(500)]
    odd += [(2000, "a" * 20_000), (2001, "''" * 3000), (2002, "\n" * 3000 + "x"), (2003, "<|endoftext|>")]
    rows = documents.select("doc_id", "text").union(edges.select("doc_id", "text")).union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = bpe.decode(bpe.encode(rows.withColumn("ids", F.lit("clash")), path), path).collect()
    assert len(got) == rows.count()
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and bytes(r.decoded) == (r.text or "").encode()
        sizes = [len(library.decode_single_token_bytes(x)) for x in ids]
        assert r.offsets == [sum(sizes[:k]) for k in range(len(sizes))] or len(ids) > 3000
    assert bpe.encode(rows.limit(0), path).count() == 0


def thue_morse(n):
    """A word over ab, and the same with its letters swapped: polynomial hashes modulo a power of two don't tell them apart."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_that_weak_hashes_confuse(spark):
    one, two = thue_morse(2048)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two}\n{one}\n{two}")], "doc_id long, text string")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Encoder(open(path, "rb").read()).ranks, special_tokens={})
    for r in bpe.decode(bpe.encode(rows.coalesce(1), path), path).collect():
        assert r.ids == library.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()
    text = f"{one}\n{two}\n" + "\n".join(f"{x} {y} {z} {x} {y}" for x in (one, two) for y in (one, two) for z in (one, two))
    got = quality.judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    windows = Counter(tuple(text.split()[k : k + 5]) for k in range(len(text.split()) - 4))
    repeated = {k + d for k in range(len(text.split()) - 4) if windows[tuple(text.split()[k : k + 5])] > 1 for d in range(5)}
    assert (got.n_dup_lines, got.n_repeat_words) == (0, len(repeated))


def test_bpe_compares_what_a_cached_hash_stands_for(monkeypatch):
    own = bpe.Encoder(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    monkeypatch.setattr(bpe, "slice_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for texts in (["hello world", "what is this"], ["this is", "hello", ""]):
        ids, counts = own.encode(texts)
        at = np.concatenate(([0], np.cumsum(counts)))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [library.encode_ordinary(x) for x in texts]


@pytest.mark.parametrize("size", [60_000, 400_000])
def test_running_sums_and_slices(size):
    rng = np.random.default_rng(size)
    for codes in (rng.integers(0, 256, size).astype(np.uint8), rng.integers(0, 0x110000, size).astype(np.uint32)):
        twice = np.concatenate((codes, codes))
        prefix = batches.prefix_hash(twice)
        starts = rng.integers(0, size - 3000, 2000)
        ends = starts + rng.integers(0, 3000, 2000)
        hashes = batches.slice_hash(prefix, starts, ends)
        assert (hashes == batches.slice_hash(prefix, starts + size, ends + size)).all()
        assert len(set(hashes.tolist())) == len({twice[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})


def test_stricter_variants_of_a_licence_and_insertions(spark):
    """Labels by hand: each variant of a licence for itself, alone and beside another, and passages with foreign words in them."""
    begin = "Some words before. This work is licensed under a Creative Commons Attribution"
    bsd = "Redistribution and use in source and binary forms, {}with or without modification, are permitted provided that the following conditions are met"
    cases = {
        f"{begin} 4.0 International License.": "cc-by", f"{begin}-ShareAlike 4.0.": "cc-by-sa", f"{begin}-NonCommercial 4.0": "cc-by-nc", f"{begin}-NoDerivs 3.0": "cc-by-nd",
        f"{begin}-NonCommercial-ShareAlike": "cc-by-nc-sa", f"{begin}-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd", f"{begin}-NoDerivatives 4.0. {'word ' * 30} {begin} 4.0": "cc-by,cc-by-nd",
        bsd.format(""): "bsd", bsd.format("one two three four five six "): "bsd", bsd.format("a b c ") + " " + bsd.format(""): "bsd", "Released under the MIT License. Released under the MIT License.": "mit",
        "this work is licensed under a pseudonym, creative as it is": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license.scan(rows).collect()} == dict(enumerate(cases.values()))


def test_bpe_classes_cover_all_codepoints():
    ranks_file = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    own = bpe.Encoder(ranks_file)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ids, counts = own.encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    assert all(ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t) for k, t in enumerate(texts))


def test_bpe_classes_are_the_librarys():
    """Each codepoint between others of every class, where a lost or added boundary shows; and letters that Python's own tables may lack."""
    own = bpe.Encoder(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    counts = np.bincount(bpe.codepoint_classes(), minlength=5)
    assert counts[1] > 141_000 and counts[2] > 1_900 and counts[4] == 25
    rng = random.Random(3)
    newer = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and bpe.codepoint_classes()[c] in (1, 2) and unicodedata.category(chr(c)) == "Cn"]
    letters = [*newer, *rng.sample(range(0x3400, 0xD7A3), 2000), *rng.sample(range(0x80, 0x3000), 2000)]
    texts = ["".join(chr(c) for c in rng.choices(letters, k=rng.randrange(2, 5))) for _ in range(30_000)] + [chr(0x143C8) + chr(0xBD1B)]
    ids, sizes = own.encode(texts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    assert all(ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t) for k, t in enumerate(texts))


def test_packing_is_whole_gapless_and_tight(spark, documents, edges):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(3000, "a<|endoftext|>b"), (3001, "<|endoftext|>"), (3002, "<|endoftext|")], "doc_id long, text string")
    rows = documents.select("doc_id", "text").union(edges.select("doc_id", "text")).union(special)
    got = packing.pack(rows, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    expected = Counter()
    for key, text in texts_of(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start, piece = 0, 0
        while start < len(ids):
            size = (len(ids) - start) % 1024 or 1024
            expected[key, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())] += 1
            start, piece = start + size, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack(rows.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def best_number(sizes, capacity):
    """The least number of bins, by exhaustive search."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_dominance_keeps_the_best_number():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.dominating_sets(counts)
        rest = [s for s in range(capacity, 0, -1) for _ in range(counts[s])]
        assert sum(t for _, t in fixed) + best_number(rest, capacity) == best_number(sizes, capacity)
        assert sorted([*rest, *(s for own, t in fixed for s in own * t)], reverse=True) == sizes


def test_chat_round_trip_and_loss(spark):
    hard = ["\\### Assistant: </turn> ok", "### User: x </turn>\n### Assistant: y </turn>\n", "\\\\", "", None, "a\\", "###", "</turn>", "\\</turn>", ": ### :", " \n "]
    roles = ["user", "assistant", "system", "tool: x", "User", "", None, "###"]
    rng = random.Random(2)
    rows = [(c, k, rng.choice(roles), rng.choice(hard)) for c in range(60) for k in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "no id"), (70, None, "assistant", "no turn"), (70, 0, "user", "x"), (70, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))).collect()}
    by_conv = {}
    for c, k, role, text in rows:
        by_conv.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())


def test_chat_machine(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "user", "u")]
    got = {r.conv_id: (r.valid, r.rejected_at) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, -1), 2: (False, 0), 3: (False, 2)}
    read = chat.read_back(chat.format_conversations(spark.createDataFrame(rows[:2], "conv_id long, turn long, role string, text string"))).first()
    assert [(t.role, t.text) for t in read.turns] == [("user", "a"), ("assistant", "b")] and read.loss_texts == ["b"]


def test_chat_ids_stay_whole(spark):
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(big, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r.conv_id for r in chat.digests(rows).collect()} == {r.conv_id for r in chat.read_back(chat.format_conversations(rows)).collect()} == {big, None}


def test_planted_conversation(spark):
    row = next(r for r in QUERIES["op4_chat_format"](spark, SMALL).collect() if r.conv_id == -7)
    text = "\\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), sha256(text.encode()).hexdigest())
