"""Language-model scoring with a hidden Markov model.

Tokens are words (A-Z lower-cased) and one end per text. Word counts of all training texts are aggregated in the cluster. The most
frequent words, 2^17 at most, go to every task; what a text owes to all other words comes by joining its rare words with the count
table. Every text is read into words twice: to count them, and to write what training and scoring need of it.

The model emits word classes: each of the most frequent words is a class, the others share 256 classes by their last three
bytes, the end is one. Baum-Welch goes over all training texts in every round, expected counts summed across partitions, until
the likelihood settles. Texts are cut into segments only to work side by side: transfer matrices, multiplied in order with
scaling, carry what the rest of a text says, so training and scoring are exact over whole texts. Within a shared class a word
has probability (c + 0.1) / sum over the class, unknown words counting as one more word with c = 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import fold_of, id_and_text, in_batches, read, settle, sliced

FOLDS = 10
HEAVY = 1 << 17
OWN_CLASSES = 4096
BUCKETS = 256
STATES = 4
SEGMENT = 64
TRAIN_SEGMENT, TRAIN_TOKENS, RESCALE = 1024, 1_000_000, 8
ROUNDS, SETTLED = 13, 1e-5
SEED = 11
FLUSH = 400_000


def words_of(text: str) -> list[bytes]:
    """bytes.lower() and bytes.split() treat exactly A-Z and the six ASCII spaces."""
    return text.encode().lower().split()


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


class Codes(dict):
    """word -> code: the place of a heavy word, or HEAVY words' number plus the bucket of any other."""

    def __init__(self, heavy: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(heavy))
        self.n = len(heavy)

    def __missing__(self, word: bytes) -> int:
        code = self.n + bucket_of(word)
        if len(self) < self.n + FLUSH:
            self[word] = code
        return code


@dataclass
class Vocabulary:
    heavy: list[bytes]  # by count, descending; the first OWN_CLASSES are classes of their own
    counts: np.ndarray  # of the heavy words
    total: int  # N, ends included
    kinds: int  # V, the end included
    ends: int
    bucket_mass: np.ndarray  # sum of c + 0.1 over the words of each shared class, and 0.1 for unknown ones
    least: int  # the count from which a word is heavy

    def __post_init__(self):
        own = min(OWN_CLASSES, len(self.heavy))
        buckets = np.fromiter(map(bucket_of, self.heavy), np.int64, len(self.heavy))
        self.own = own
        self.n_classes = own + BUCKETS + 1
        self.end_class = own + BUCKETS
        self.class_of = np.concatenate([np.where(np.arange(len(self.heavy)) < own, np.arange(len(self.heavy)), own + buckets), own + np.arange(BUCKETS + 1)])
        log_c = np.log10(self.counts + 0.1)
        self.log_count = np.concatenate([log_c, np.zeros(BUCKETS), [np.log10(self.ends + 0.1)]])
        mass = np.log10(self.bucket_mass)
        inside = np.where(np.arange(len(self.heavy)) < own, 0.0, log_c - mass[buckets])
        self.log_inside = np.concatenate([inside, -mass, [0.0]])
        class_mass = np.concatenate([self.counts[:own] + 0.1, self.bucket_mass, [self.ends + 0.1]])
        self.class_share = class_mass / class_mass.sum()
        self.base_norm = np.log10(self.total + 0.1 * (self.kinds + 1))

    def code_arrays(self, texts: list[str], codes: Codes, rare: list[Counter] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all tokens, one text behind the other, and the texts' lengths; the end is a text's last token. rare takes each
        text's words that aren't heavy."""
        end, parts, lengths = len(self.heavy) + BUCKETS, [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            lengths[i] = len(words) + 1
            found = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
            parts += [found, np.array([end], np.int32)]
            if rare is not None:
                rare.append(Counter([words[k] for k in np.flatnonzero(found >= len(self.heavy)).tolist()]))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), lengths


@dataclass
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def first_model(share: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    emit = share[:, None] * np.exp(0.5 * rng.standard_normal((len(share), STATES)))
    even = np.full(STATES, 1 / STATES)
    return Model(even, 0.9 * np.eye(STATES) + 0.1 / STATES, emit / emit.sum(axis=0))


def segments(lengths: np.ndarray, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, length) of the segments of all texts, in order."""
    n = -(-lengths // most)
    text = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    return text, (np.cumsum(lengths) - lengths)[text] + nth * most, np.minimum(most, lengths[text] - nth * most)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=0)


def _edges(classes: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray, model: Model, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the rest of its text says of every segment (states, segments): the distribution of its first state given the tokens
    before, and the likelihood of the tokens behind given its last state, up to a factor. Segments of a text are multiplied
    out as transfer matrices; texts of one segment need none. emit: as from _near_one()."""
    before, behind = np.repeat(model.start[:, None], len(text), axis=1), np.ones((STATES, len(text)))
    n_parts = np.bincount(text)
    many = np.flatnonzero(n_parts[text] > 1)
    if not len(many):
        return before, behind
    order = many[np.argsort(-size[many], kind="stable")]
    live = np.searchsorted(-size[order], -np.arange(size[order[0]]), side="left").tolist()
    onward, starts = np.ascontiguousarray(model.step.T), first[order]
    moved = np.repeat(np.eye(STATES)[:, :, None], len(order), axis=2)  # last state, first state, segment
    whole = np.empty((STATES, STATES, len(text)))
    for t, n in enumerate(live):
        m = moved.shape[2]
        if n < m:
            whole[:, :, order[n:m]] = moved[:, :, n:]
            moved = np.ascontiguousarray(moved[:, :, :n])
        if t:
            moved = (onward @ moved.reshape(STATES, -1)).reshape(STATES, STATES, n)
        moved *= emit.take(classes[starts[:n] + t], axis=1)[:, None, :]
        if t % RESCALE == RESCALE - 1:
            moved /= moved.sum(axis=(0, 1))
    whole[:, :, order[: moved.shape[2]]] = moved
    whole[:, :, many] /= whole[:, :, many].sum(axis=(0, 1))
    texts = np.unique(text[many])
    at = (np.cumsum(n_parts) - n_parts)[texts]
    for k in range(int(n_parts.max()) - 1):
        own = at[n_parts[texts] > k + 1] + k
        before[:, own + 1] = _unit(onward @ np.einsum("jin,in->jn", whole[:, :, own], before[:, own]))
    for k in range(int(n_parts.max()) - 1):
        own = (at + n_parts[texts] - 1)[n_parts[texts] > k + 1] - k
        behind[:, own - 1] = _unit(model.step @ np.einsum("jin,jn->in", whole[:, :, own], behind[:, own]))
    return before, behind


def _near_one(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Emissions by their class's mean over the states (states, classes), and those means. Products of them stay in range for
    many tokens, so that they need scaling only now and then."""
    mean = model.emit.mean(axis=1)
    return np.ascontiguousarray((model.emit / mean[:, None]).T), mean


def expected_counts(classes: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch, exact over whole texts: expected starts, steps, and emissions (classes, states); and the log10 likelihood."""
    starts, steps, emitted = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(model.emit), STATES))
    if not len(lengths):
        return starts, steps, emitted, 0.0
    text, first, size = segments(lengths, TRAIN_SEGMENT)
    is_first, is_last = np.append(True, text[1:] != text[:-1]), np.append(text[1:] != text[:-1], True)
    emit, mean = _near_one(model)
    before, behind = _edges(classes, text, first, size, model, emit)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size[order[0]]), side="left")  # segments that have a token t
    at = np.append(0, np.cumsum(live)).tolist()  # the tokens, t by t
    live, origin = live.tolist(), first[order]
    flat, seen, alpha, likely = np.empty(at[-1], np.intp), [], [], 0.0
    onward, back = np.ascontiguousarray(model.step.T), model.step
    for t, n in enumerate(live):
        flat[at[t] : at[t + 1]] = now = classes[origin[:n] + t]
        now = emit.take(now, axis=1)
        own = (onward @ alpha[-1][:, :n] if t else before[:, order]) * now
        if t % RESCALE == RESCALE - 1:
            scale = own.sum(axis=0)
            own /= scale
            now /= scale
            likely += np.log10(scale).sum()
        seen.append(now)
        alpha.append(own)
    likely += np.bincount(flat, minlength=len(mean)) @ np.log10(mean)
    gamma, last, beta, m = np.empty((STATES, at[-1])), np.empty((STATES, len(order))), np.zeros((STATES, 0)), 0
    for t in range(len(live) - 1, -1, -1):
        own, ends = alpha.pop(), order[m : live[t]]
        if live[t] > m:
            last[:, ends] = ended = own[:, m:]
            likely += np.log10(ended.sum(axis=0)).sum()
            ahead = behind[:, ends]
            tail = ahead / (ended * ahead).sum(axis=0)
        if m:
            weighted = seen.pop() * beta
            steps += own[:, :m] @ weighted.T
            beta = back @ weighted if live[t] == m else np.concatenate([back @ weighted, tail], axis=1)
        else:
            beta = tail
        m = live[t]
        np.multiply(own, beta, out=gamma[:, at[t] : at[t + 1]])
    steps *= model.step
    # the step from a segment to the next one of its text
    entered = np.empty((STATES, len(order)))
    entered[:, order] = seen.pop() * beta
    left = np.flatnonzero(~is_last)
    cross = last[:, left], entered[:, left + 1]
    norm = (cross[0] * (model.step @ cross[1])).sum(axis=0)
    steps += model.step * (cross[0] @ (cross[1] / norm).T)
    starts += gamma[:, : at[1]][:, is_first[order]].sum(axis=1)
    for k in range(STATES):
        emitted[:, k] = np.bincount(flat, gamma[k], len(emitted))
    return starts, steps, emitted, float(likely)


def refit(counts: tuple, share: np.ndarray) -> Model:
    """The model of expected counts, smoothed towards the classes' shares."""
    start, steps, emit = counts
    unit = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return Model(unit(start + 1, 0), unit(steps + 1, 1), unit(emit + 20 * share[:, None], 0))


def log_likelihoods(classes: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """The exact log10 likelihood of each text's class sequence, by the scaled forward recursion."""
    text, first, size = segments(lengths)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")
    log_scale = np.zeros(len(text))
    emit, mean = _near_one(model)
    by_class, starts = np.ascontiguousarray(emit.T), first[order]
    moved = np.tile(np.eye(STATES), (len(text), 1, 1))  # rows: the state before the segment
    for t in range(SEGMENT):
        n = live[t]
        if not n:
            break
        now = (moved[:n].reshape(-1, STATES) @ model.step).reshape(n, STATES, STATES)
        np.multiply(now, by_class.take(classes[starts[:n] + t], axis=0)[:, None, :], out=moved[:n])
        if t % RESCALE == RESCALE - 1:
            scale = moved[:n].sum(axis=(1, 2), keepdims=True)
            moved[:n] /= scale
            log_scale[:n] += np.log10(scale[:, 0, 0])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    moved, log_scale = moved[back], log_scale[back]
    out = np.bincount(text, log_scale, len(lengths))
    out += np.bincount(np.repeat(np.arange(len(lengths)), lengths), np.log10(mean)[classes], len(lengths))
    n = -(-lengths // SEGMENT)
    base = np.cumsum(n) - n
    # A step into the first token must give the start distribution: start = before @ step.
    state = np.tile(np.linalg.solve(model.step.T, model.start), (len(lengths), 1))
    by_size = np.argsort(-n, kind="stable")
    for k in range(int(n.max(initial=0))):
        rows = by_size[: np.searchsorted(-n[by_size], -(k + 1), side="right")]
        state[rows] = np.einsum("ni,nij->nj", state[rows], moved[base[rows] + k])
        scale = state[rows].sum(axis=1)
        state[rows] /= scale[:, None]
        out[rows] += np.log10(scale)
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """(word, bucket, c) over the training texts; partitions send each of their words once (or once per FLUSH words)."""

    def count(batches):
        def rows(found: Counter):
            words = list(found)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(bucket_of, words), pa.int32()), pa.array(found.values(), pa.int64())], names=["word", "bucket", "c"])

        found: Counter = Counter()
        for batch in batches:
            for part in sliced(batch, 2_000_000):
                for text in part.column(0).to_pylist():
                    found.update(words_of(text))
                if len(found) > FLUSH:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    return train.select("text").mapInArrow(count, "word binary, bucket int, c long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    per_bucket = counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds")).collect()  # BUCKETS rows
    total, kinds = sum(r.c for r in per_bucket) + n_texts, sum(r.kinds for r in per_bucket) + (n_texts > 0)
    level = F.floor(8 * F.log2("c")).alias("level")
    levels = counts.groupBy(level).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("kinds")).collect()  # a few hundred rows
    least, room = 1 << 62, HEAVY
    for r in sorted(levels, key=lambda r: -r.c):
        room -= r.kinds
        if room < 0:
            break
        least = r.c
    most = counts.filter(F.col("c") >= least).select("word", "c").collect()  # HEAVY rows at most
    most.sort(key=lambda r: (-r.c, bytes(r.word)))
    heavy, c = [bytes(r.word) for r in most], np.array([r.c for r in most], float)
    mass = np.full(BUCKETS, 0.1)
    for r in per_bucket:
        mass[r.bucket] += r.c + 0.1 * r.kinds
    for w, n in zip(heavy[:OWN_CLASSES], c[:OWN_CLASSES].tolist(), strict=True):
        mass[bucket_of(w)] -= n + 0.1
    return Vocabulary(heavy, c, total, kinds, n_texts, np.maximum(mass, 0.1), least)


CODED = "doc_id long, taught boolean, crc long, n_tokens long, n_known long, base double, inside double, classes binary, words array<binary>, times array<int>"


def coded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """What training and scoring need of every row (doc_id, taught, text): the classes of its tokens (two bytes each), what its heavy
    words and its end give to the scores, and its rare words with their numbers."""
    n_heavy = len(vocab.heavy)

    def encode(batches):
        codes = Codes(vocab.heavy)
        names = [x.split()[0] for x in CODED.split(", ")]
        for batch in batches:
            for part in sliced(batch, 2_000_000):
                texts = part.column("text").to_pylist()
                rare: list[Counter] = []
                found, lengths = vocab.code_arrays(texts, codes, rare)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                known = (found < n_heavy) | (found == n_heavy + BUCKETS) & (vocab.ends > 0)
                sums = lambda w: np.bincount(owner, w, len(lengths))  # noqa: E731, B023
                of_class, at = vocab.class_of[found].astype("<u2").view(np.uint8), np.append(0, np.cumsum(2 * lengths))
                classes = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(of_class)])
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in rare])), pa.int32())
                columns = [part.column("doc_id"), part.column("taught"), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array(lengths), pa.array(sums(known).astype(np.int64))]
                columns += [pa.array(sums(vocab.log_count[found]) - lengths * vocab.base_norm), pa.array(sums(vocab.log_inside[found])), classes]
                columns += [pa.ListArray.from_arrays(ends, pa.array([x for own in rare for x in f(own)], kind)) for f, kind in ((Counter.keys, pa.binary()), (Counter.values, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_batches(rows.select("doc_id", "taught", "text")).mapInArrow(encode, CODED)


def train(rows: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model of all texts of rows (doc_id, text)."""
    return fitted(settle(coded(rows.withColumn("taught", F.lit(True)), vocab), "lm-coded"), vocab, rounds)


def fitted(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all coded texts, in the cluster: until a round changes the likelihood by less than SETTLED of it, `rounds` at
    most. Every round reads the classes that were written once."""
    share = vocab.class_share
    model = first_model(share)
    n_steps, n_classes, before = STATES * STATES, vocab.n_classes, None
    for _ in range(rounds):

        def expect(batches, model=model):
            sums = np.zeros(STATES + n_steps + n_classes * STATES + 1)
            for some in _some_tokens(batches):
                classes, lengths = np.frombuffer(b"".join(some), "<u2"), np.fromiter(map(len, some), np.int64, len(some)) // 2
                sums += np.concatenate([np.ravel(x) for x in expected_counts(classes, lengths, model)])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], names=["at", "n"])

        total = np.zeros(STATES + n_steps + n_classes * STATES + 1)
        for r in in_batches(texts.select("classes")).mapInArrow(expect, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[r["at"]] = r.n
        start, steps, emit, likely = np.split(total, np.cumsum([STATES, n_steps, n_classes * STATES]))
        model = refit((start, steps.reshape(STATES, STATES), emit.reshape(n_classes, STATES)), share)
        if before is not None and abs(likely[0] - before) <= SETTLED * abs(before):
            break
        before = likely[0]
    return model


def _some_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The coded texts in lists of about TRAIN_TOKENS tokens, a text at least."""
    texts, size = [], 0
    for batch in batches:
        for coded in batch.column(0):
            text = coded.as_py()
            if texts and size + len(text) > 2 * TRAIN_TOKENS:
                yield texts
                texts, size = [], 0
            texts.append(text)
            size += len(text)
    if texts:
        yield texts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (log10).

    Learns from the rows whose crc32(id as text) mod folds isn't 0. An empty or null text is just its end. Without training
    texts all counts are 0. Rows that repeat an id and text get the same scores.
    """
    texts, counts, vocab = _read(docs, id_col, text_col, folds)
    model = fitted(texts.filter("taught"), vocab)

    def likelihood(batches):
        for batch in batches:
            for part in sliced(batch, 1_000_000):
                lengths = part.column("n_tokens").to_numpy()
                classes = np.frombuffer(b"".join(x.as_py() for x in part.column("classes")), "<u2")
                likely = log_likelihoods(classes, lengths, model) + part.column("inside").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(likely)], names=[*kept, "likely"])

    kept = ["doc_id", "crc", "n_tokens", "n_known", "base"]
    own = texts.select(*kept, "inside", "classes").mapInArrow(likelihood, "doc_id long, crc long, n_tokens long, n_known long, base double, likely double")
    return _with_rare(own, texts, counts, vocab, folds)


def base_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """score() without its last column, for which nothing is trained."""
    texts, counts, vocab = _read(docs, id_col, text_col, folds)
    own = texts.select("doc_id", "crc", "n_tokens", "n_known", "base", F.lit(0.0).alias("likely"))
    return _with_rare(own, texts, counts, vocab, folds).drop("score")


def _read(docs: DataFrame, id_col: str, text_col: str, folds: int) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """The coded texts, the word counts of those that are learnt from, and what follows from these."""
    rows = in_batches(id_and_text(docs, id_col, text_col)).withColumn("taught", fold_of(F.col("doc_id"), folds) != 0)
    counts = settle(word_counts(rows.filter("taught")), "lm-counts")
    vocab = vocabulary(counts, docs.filter(fold_of(F.col(id_col), folds) != 0).count())
    return settle(coded(rows, vocab), "lm-coded"), counts, vocab


def _with_rare(own: DataFrame, texts: DataFrame, counts: DataFrame, vocab: Vocabulary, folds: int) -> DataFrame:
    """The scores of own with what each text owes to its rare words, by their counts."""
    rare = texts.select("doc_id", "crc", F.explode(F.arrays_zip("words", "times")).alias("x")).select("doc_id", "crc", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    light = counts.filter(F.col("c") < vocab.least).select("word", "c")
    c = F.coalesce("c", F.lit(0))
    joined = rare.join(light.hint("merge"), "word", "left").groupBy("doc_id", "crc").agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    joined = joined.select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "rare", "rare_known")
    out = own.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "crc")))
    out = out.join(joined, out["doc_id"].eqNullSafe(joined["_id"]) & (out["crc"] == joined["_crc"]), "left")
    rare_sum = F.coalesce(F.col("rare") / F.col("copies"), F.lit(0.0))
    return out.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + rare_sum).alias("base_score"), (F.col("likely") + rare_sum).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base columns of query(), which SQL can express; the score in thousandths, rounded down."""
    found = base_scores(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.floor(F.col("base_score") * 1000).cast("long").alias("base_milli"))


_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""
SQL = f"""
WITH d AS (
  SELECT doc_id, {_SQL_CRC} % 10 = 0 AS held_out,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d UNION ALL SELECT doc_id, held_out, NULL FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
  CAST(floor(sum(log10((coalesce(c, 0) + 1e-1) / (n + 1e-1 * (v + 1)))) * 1000) AS BIGINT) AS base_milli
FROM t LEFT JOIN c ON t.word IS NOT DISTINCT FROM c.word CROSS JOIN n GROUP BY doc_id, held_out
"""
