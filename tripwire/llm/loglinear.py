"""Scores of texts by a log-bilinear language model, beside a smoothed unigram base.

Tokens are the words (runs of bytes other than space and 09-0D, A-Z in lower case), and one end per text. A training
text's tokens are counted; the base score of a text is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))).

The model gives P(token | the ``CONTEXT`` tokens before) as P(class | context) * P(token | class). The most frequent tokens
are classes of their own; other tokens of the head, which are at most ``HEAD_WORDS``, are put into classes by their count; what is
rarer, and one token for all unknown, is the last class. Within a class tokens have their count + 0.1 as weight. Class
scores are bilinear: a context's vector is a sum of its tokens' vectors, each times the matrix of its place, and a
class scores with that vector times its own, plus its bias. Scores are normalised by sums over all classes, by batched
matrix products, so the probabilities of all tokens sum to one.

Training is noise-contrastive estimation in numpy over all training texts: in each round every task starts from the
same parameters, passes once over its texts, and the parameters are averaged, weighted by tokens. Rounds take disjoint shares
of the texts by a hash of doc_id, small ones first. A task sends as many numbers as there are parameters, and these are summed as a stream.

Counts are exact whatever the vocabulary's size. Words of the head are looked up in a broadcast table whose size is
bounded; the others of a text are sent to the counts by word, and what they add comes back to the text by sums.

Edge cases: a null text is the empty text and has the end only; a null doc_id counts as the empty text in its hash;
rows equal in doc_id and text get equal rows, as many as they are; where nothing is learned (an empty table, or all
held out) every token is unknown; texts are read whole; words over ``HEAD_BYTES`` bytes are never in the head; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.batches import Lookup, mix, release, row_chunks, text_buffer, word_spans
from tripwire.llm.language import id_crc
from tripwire.sources.storage import Scratch, stored

SMOOTHING = 0.1
#: Tokens before one that the model sees, tokens with a vector of their own as context, classes, and width of vectors.
CONTEXT, INPUTS, CLASSES, WIDTH = 2, 1024, 256, 16
#: Of the classes, those of rarer words by count.
RARE = 16
#: Bounds of the broadcast table: words, and bytes of a word; unseen words that are as frequent are listed as well.
HEAD_WORDS, HEAD_BYTES, UNSEEN_WORDS = 100_000, 64, 1_000
#: Training: tokens of a step, noise classes of a step, rates of vectors and of biases, and sixteenths of the texts of each round.
BATCH, NOISE, RATE, BIAS_RATE, ROUNDS = 1024, 32, 0.15, 0.015, (1, 4, 11)
#: Words that a task counts before it passes the counts on, and parameters in a row.
COUNTED_WORDS, BLOCK = 200_000, 512
_SCORED_AT_ONCE = 1024
#: Sizes of counts: eight to a doubling.
_STEPS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a word whose lanes are hashed one after another for many words at once; longer words are hashed alone.
_LANES = 512


def _keys(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each slice of ``raw``: a hash, its first and its last eight bytes, and its length, which up to 16 bytes tell it apart."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(padded) - 7,), np.uint64, padded.data, strides=(1,))  # the eight bytes from each byte on
    size = end - begin
    head = lanes[begin] & _MASKS[np.minimum(size, 8)]
    tail = np.where(size > 8, lanes[np.maximum(end - 8, 0)], np.uint64(0))
    key = mix(head ^ mix(tail + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    long = np.flatnonzero(size > 16)
    for k in range(8, min(_LANES, int(size.max(initial=0))) - 8, 8):
        long = long[size[long] > k + 8]
        key[long] = mix(key[long] ^ lanes[begin[long] + k])
    for k in np.flatnonzero(size > _LANES).tolist():
        key[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return np.stack((key, head, tail, size.astype(np.uint64)))


def keys_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in words], dtype=np.int64)
    return _keys(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])) if words else ends, ends)


class Table:
    """Positions of words in a list of words."""

    def __init__(self, keys: np.ndarray):
        _, one = np.unique(keys[0], return_index=True)  # of two words with one hash the first is found, the other is not
        self.keys, self.of, self.position = keys, Lookup(keys[0][one]), one

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each word, or -1."""
        got = self.of.find(keys[0])
        at = self.position[got] if len(self.position) else got
        same = got >= 0
        for own, other in zip(self.keys[1:], keys[1:], strict=True):
            same &= own[at] == other if len(own) else False
        return np.where(same, at, -1)


@dataclass
class Words:
    """Of a chunk of texts: the lower-case bytes, each word's place, keys and text, and each text's first word."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    keys: np.ndarray
    of_text: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Words:
        own, at = _LOWER[raw[offsets[0] : offsets[-1]]], offsets - offsets[0]
        begin, end = word_spans(own, at)
        first = np.searchsorted(begin, at)
        return cls(own, begin, end, _keys(own, begin, end), np.repeat(np.arange(len(at) - 1), np.diff(first)), first)

    def distinct(self, which: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(different words, number of each word into them), of the words at ``which``."""
        _, one, number = np.unique(self.keys[0][which], return_index=True, return_inverse=True)
        spelled, one = self.raw.tobytes(), which[one]
        return [spelled[b:e] for b, e in zip(self.begin[one].tolist(), self.end[one].tolist(), strict=True)], number

    def tokens(self, of_word: np.ndarray, of_end: int) -> np.ndarray:
        """A number for each token, ends included, from one for each word."""
        texts = len(self.first) - 1
        out = np.full(len(self.begin) + texts, of_end, of_word.dtype)
        out[np.arange(len(self.begin)) + self.of_text] = of_word
        return out


def contexts(inputs: np.ndarray) -> list[np.ndarray]:
    """The tokens 1, 2, ... places before each; before a text's first token there are ends, which are 0."""
    out, inside = [], np.ones(len(inputs), bool)
    for k in range(1, CONTEXT + 1):
        before = np.concatenate((np.zeros(min(k, len(inputs)), inputs.dtype), inputs[:-k]))
        before[~inside] = 0
        inside &= before != 0
        out.append(before)
    return out


def is_held_out() -> Column:
    return id_crc() % 10 == 0


def word_counts(documents: DataFrame) -> DataFrame:
    """word, c (occurrences in training texts), n (in all)."""
    limit = COUNTED_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words that occur often in the task's first chunks are counted by position, the others by name: c and n
        often: list[bytes] = []
        table, counts, sums, chunks = Table(keys_of([])), np.zeros((2, 0), np.int64), {}, 0

        def counted(words: list[bytes], c: np.ndarray | list[int], n: np.ndarray | list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in words], pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        for batch in release(batches):
            raw, offsets, _ = text_buffer(batch.column(1))
            held = np.array(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for lo, hi in row_chunks(offsets):
                chunk = Words.of(raw, offsets[lo : hi + 1])
                at, trained = table.find(chunk.keys), ~held[lo:hi][chunk.of_text]
                known = at >= 0
                counts += np.stack([np.bincount(at[x], minlength=len(often)) for x in (known & trained, known)])
                words, number = chunk.distinct(np.flatnonzero(~known))
                n, c = np.bincount(number, minlength=len(words)), np.bincount(number, trained[~known], len(words)).astype(np.int64)
                for word, x, y in zip(words, c.tolist(), n.tolist(), strict=True):
                    had = sums.get(word)
                    sums[word] = (x, y) if had is None else (had[0] + x, had[1] + y)
                chunks += 1
                if chunks in (1, 8):
                    more = [x for x, (_, n) in sums.items() if n > 1]
                    often, counts = often + more, np.concatenate((counts, np.array([sums.pop(x) for x in more], np.int64).reshape(-1, 2).T), axis=1)
                    table = Table(keys_of(often))
                if len(sums) > limit:
                    yield counted([*sums], *zip(*sums.values(), strict=True))
                    sums.clear()
        yield counted(often, *counts)
        if sums:
            yield counted([*sums], *zip(*sums.values(), strict=True))

    rows = documents.select(is_held_out(), "text").mapInArrow(run, "word string, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Words of the head with their counts and classes, and what all tokens sum up to.

    Inputs and classes are numbers: 0 is the end in both, the last class is the tail. ``weight`` is a class's sum of counts + 0.1.
    """

    words: list[bytes]
    count: np.ndarray
    inputs: np.ndarray
    classes: np.ndarray
    weight: np.ndarray
    n_tokens: int
    n_distinct: int
    n_ends: int

    @classmethod
    def of(cls, words: list[str], count: np.ndarray, unseen: list[str], n_words: int, n_distinct: int, n_ends: int) -> Vocabulary:
        """From the head's words and counts, unseen words, occurrences and number of all training words, and training texts."""
        order = sorted(range(len(words)), key=lambda k: (-count[k], words[k]))
        words, count = [words[k] for k in order], np.asarray(count, np.int64)[order]
        rank, own = np.arange(len(words)), CLASSES - RARE - 1
        below = np.log2(count[own - 1] / np.minimum(count, count[own - 1])) if len(words) >= own else np.zeros(len(words))
        classes = np.where(rank < own - 1, rank + 1, own + np.minimum(RARE - 1, below.astype(np.int64)))
        weight = np.bincount(classes, count + SMOOTHING, CLASSES).astype(float)  # integers if there are no words
        weight[0] += n_ends + SMOOTHING
        rest = n_distinct - len(words)
        weight[-1] += n_words - count.sum() + SMOOTHING * (rest + 1)
        # classes that no word has are left out
        number = np.cumsum(weight > 0) - 1
        fill = np.zeros(len(unseen), np.int64)
        return cls(
            [x.encode() for x in [*words, *unseen]], np.concatenate((count, fill)), np.concatenate((np.minimum(rank + 1, INPUTS - 1), fill + INPUTS - 1)),
            np.concatenate((number[classes], fill + number[-1])), weight[weight > 0], n_words + n_ends, n_distinct + (n_ends > 0), n_ends,
        )

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the base probability of tokens with these counts."""
        return np.log10((count + SMOOTHING) / (self.n_tokens + SMOOTHING * (self.n_distinct + 1)))


def _size(count: str) -> Column:
    return F.floor(F.log2(count) * _STEPS).cast("int")


def _least_size(rows: list, most: int) -> int:
    """The least size of count such that words of it and above are ``most`` at most."""
    least, total = 1 << 20, 0
    for r in sorted(rows, key=lambda r: -r["size"]):
        total += r["words"]
        if total > most:
            break
        least = r["size"]
    return least


def vocabulary(documents: DataFrame, counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """(the vocabulary, the counts of training words that aren't in its head)."""
    n_ends = documents.filter(~is_held_out()).count()
    short = F.octet_length("word") <= HEAD_BYTES
    seen, unseen = counts.filter("c > 0"), counts.filter("c = 0").filter(short)
    by_size = seen.groupBy(_size("c").alias("size"), short.alias("short")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).collect()  # a few hundred rows
    least = _least_size([r for r in by_size if r["short"]], HEAD_WORDS)
    in_head = short & (_size("c") >= least)
    head = seen.filter(in_head).select("word", "c").toArrow()
    often = _least_size(unseen.groupBy(_size("n").alias("size")).agg(F.count("*").alias("words")).collect(), UNSEEN_WORDS)
    unknown = [r["word"] for r in unseen.filter(_size("n") >= often).select("word").collect()]
    totals = [sum(r[c] for r in by_size) for c in ("c", "words")]
    return Vocabulary.of(head["word"].to_pylist(), head["c"].to_numpy(), sorted(unknown), *totals, n_ends), seen.filter(~in_head).select("word", "c")


class Model:
    """Parameters: vectors of inputs, a matrix for each place of the context, vectors and biases of classes; and how far each was moved."""

    def __init__(self, weight: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.prior = weight / weight.sum()
        places = np.stack([np.eye(WIDTH) * x for x in (0.7, *[0.3] * (CONTEXT - 1))])
        made = rng.normal(0, 0.3, (INPUTS, WIDTH)), places, np.zeros((len(weight), WIDTH)), np.log(self.prior)
        self.vectors, self.places, self.classes, self.bias = self.parts = [x.astype(np.float32) for x in made]
        self.moved = [np.full(x.shape, 1e-6, np.float32) for x in self.parts]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.parts, *self.moved)])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.parts, *self.moved):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def log_probabilities(self, before: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """Natural logs of P(class | context), normalised over all classes; each different context is normalised once."""
        _, one, number = np.unique(sum(x.astype(np.int64) * INPUTS**k for k, x in enumerate(before)), return_index=True, return_inverse=True)
        context = sum(self.vectors[x[one]] @ m for x, m in zip(before, self.places, strict=True))
        norm, turned = np.zeros(len(one)), np.ascontiguousarray(self.classes.T)
        for lo in range(0, len(one), _SCORED_AT_ONCE):
            scores = context[lo : lo + _SCORED_AT_ONCE] @ turned
            scores += self.bias
            most = scores.max(1, keepdims=True)
            scores -= most
            norm[lo : lo + _SCORED_AT_ONCE] = most[:, 0] + np.log(np.exp(scores, out=scores).sum(1))
        return np.einsum("ij,ij->i", context[number], self.classes[classes]).astype(float) + self.bias[classes] - norm[number]


def _summed(rows: np.ndarray, number: np.ndarray, many: int) -> np.ndarray:
    """Sums of the rows that have each number."""
    order = np.argsort(number, kind="stable")
    placed = number[order]
    first = np.flatnonzero(np.append(True, placed[1:] != placed[:-1]))
    out = np.zeros((many, rows.shape[1]), np.float32)
    out[placed[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Steps of noise-contrastive estimation: a token's class against classes drawn by weight, which a step's tokens share."""

    def __init__(self, model: Model, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.upto, self.log_noise = np.cumsum(model.prior), np.log(NOISE * model.prior).astype(np.float32)

    def learn(self, before: list[np.ndarray], classes: np.ndarray) -> None:
        for lo in range(0, len(classes), BATCH):
            self._step([x[lo : lo + BATCH] for x in before], classes[lo : lo + BATCH])

    def _step(self, before: list[np.ndarray], classes: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(m.bias) - 1)
        rows = [m.vectors[x] for x in before]
        context = sum(r @ c for r, c in zip(rows, m.places, strict=True))
        own, other = m.classes[classes], m.classes[noise]
        right = (context * own).sum(1) + (m.bias - self.log_noise)[classes]
        wrong = context @ other.T + (m.bias - self.log_noise)[noise]
        up, down = 1 / (1 + np.exp(np.clip(right, -30, 30))), -1 / (1 + np.exp(np.clip(-wrong, -30, 30)))
        back = up[:, None] * own + down @ other
        of_classes = _summed(up[:, None] * context, classes, len(m.bias))
        np.add.at(of_classes, noise, down.T @ context)
        of_bias = np.bincount(classes, up, len(m.bias)) + np.bincount(noise, down.sum(0), len(m.bias))
        of_vectors = _summed(np.concatenate([back @ c.T for c in m.places]), np.concatenate(before), len(m.vectors))
        changes = of_vectors, np.stack([r.T @ back for r in rows]), of_classes, of_bias.astype(np.float32)
        for x, moved, change in zip(m.parts, m.moved, changes, strict=True):
            change /= len(classes)
            moved += change * change
            x += (BIAS_RATE if x is m.bias else RATE) * change / np.sqrt(moved)


def train(documents: DataFrame, words: Vocabulary) -> Model:
    """The model, after a pass over all training texts in rounds."""
    model, spark = Model(words.weight), documents.sparkSession
    keep = min(len(words.words), HEAD_WORDS)
    known = (words.words[:keep], words.inputs[:keep], words.classes[:keep])
    share = F.floor(id_crc() / 10) % sum(ROUNDS)
    for number, sixteenths in enumerate(ROUNDS):
        begin = sum(ROUNDS[:number])
        shared = spark.sparkContext.broadcast((known, words.weight, model.flat()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            (spelled, inputs, classes), weight, flat = shared.value
            own, seen, trainer = Model(weight), 0, None
            for batch in release(batches):
                if trainer is None:
                    own.put(flat)
                    trainer, table = Trainer(own, number), Table(keys_of(spelled))
                    inputs, classes = np.append(inputs, INPUTS - 1), np.append(classes, len(weight) - 1)  # at -1: any other word
                raw, offsets, _ = text_buffer(batch.column(0))
                for lo, hi in row_chunks(offsets):
                    chunk = Words.of(raw, offsets[lo : hi + 1])
                    at = table.find(chunk.keys)
                    trainer.learn(contexts(chunk.tokens(inputs[at], 0)), chunk.tokens(classes[at], 0))
                    seen += len(chunk.begin) + hi - lo
            if seen:
                flat = own.flat()
                rows = range(0, len(flat), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK for k in rows], pa.int32()), pa.array([float(seen)] * len(rows)), pa.array([flat[k : k + BLOCK] for k in rows], pa.list_(pa.float32()))], names=["block", "weight", "values"])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in release(batches):
                for block, weight, values in zip(batch["block"].to_pylist(), batch["weight"].to_pylist(), batch["values"], strict=True):
                    row = np.append(np.asarray(values.values, np.float64), 1) * weight
                    sums[block] = sums[block] + row if block in sums else row
            rows = [pa.array(sums, pa.int32()), pa.array([x[:-1] / x[-1] for x in sums.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(rows, names=["block", "values"])

        texts = documents.filter(~is_held_out() & (share >= begin) & (share < begin + sixteenths)).select("text")
        sent = texts.mapInArrow(run, "block int, weight double, values array<float>").repartition("block")
        blocks = sorted(sent.mapInArrow(averaged, "block int, values array<double>").collect())  # the parameters
        if blocks:
            model.put(np.concatenate([r["values"] for r in blocks]))
        shared.unpersist()
    return model


_ROWS = "doc_id long, digest long, word string, n long, n_tokens long, n_known long, base double, more double"


def _text_scores(documents: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """For each text a row with what its ends and its words of the head give, and one for each of its other words.

    ``base`` lacks the logs of the other words' weights, and the model's score is above it by ``more``. A text's own row has
    a word with a space in it, so it meets no count.
    """
    shared = documents.sparkSession.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        table = Table(keys_of(words.words))
        # the last of each: any other word
        log_count = np.append(np.log10(words.count + SMOOTHING), 0)
        inputs, classes = np.append(words.inputs, INPUTS - 1), np.append(words.classes, len(words.weight) - 1)
        inside, known = log_count - np.log10(words.weight)[classes], np.append(words.count > 0, False)
        for batch in release(batches):
            raw, offsets, _ = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                chunk, texts = Words.of(raw, offsets[lo : hi + 1]), hi - lo
                at = table.find(chunk.keys)
                size = np.diff(chunk.first) + 1
                sums = lambda x, of=chunk.of_text, n=texts: np.bincount(of, x, n)
                log_p = model.log_probabilities(contexts(chunk.tokens(inputs[at], 0)), chunk.tokens(classes[at], 0)) / np.log(10)
                score = sums(log_p, np.repeat(np.arange(texts), size)) + sums(inside[at])
                base = sums(log_count[at] + words.base(1 - SMOOTHING)) + words.base(words.n_ends)
                n_known = sums(known[at]).astype(np.int64) + (words.n_ends > 0)
                left = np.flatnonzero(at < 0)
                spelled, which = chunk.distinct(left)
                pair, n = np.unique(chunk.of_text[left] * (len(spelled) + 1) + which, return_counts=True)
                of, word = np.divmod(pair, len(spelled) + 1)
                rows, none = np.concatenate((np.arange(texts), of)), np.zeros(len(of), np.int64)
                digest = np.array([int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)], np.int64)
                spelled = [*(f" {k}" for k in digest.tolist()), *(spelled[k].decode() for k in word.tolist())]
                columns = (np.concatenate((np.zeros(texts, np.int64), n)), *(np.concatenate((x, none)) for x in (size, n_known, base, score - base)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, texts).take(pa.array(rows)), pa.array(digest[rows]), pa.array(spelled, pa.string()), *map(pa.array, columns)], names=[x.split()[0] for x in _ROWS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, _ROWS)


def score(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, and the log10 probabilities base_score and score."""
    with Scratch(documents.sparkSession) as tmp:
        counts = tmp.stored(word_counts(documents))
        words, rest = vocabulary(documents, counts)
        rows = _text_scores(documents, words, train(documents, words)).join(rest, "word", "left")
        other = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)
        by_text = rows.groupBy("doc_id", "digest").agg(
            F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.when(F.col("n") > 0, other).otherwise(0)).alias("base"), F.sum("more").alias("more"),
        )
        each = [F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")]
        scores = [(F.col("base") / F.col("copies")).alias("base_score"), ((F.col("base") + F.col("more")) / F.col("copies")).alias("score")]
        one = by_text.select("doc_id", is_held_out().alias("held_out"), *each, F.lit(words.n_tokens).cast("long").alias("train_tokens"), *scores, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return stored(one.drop("copy"))
