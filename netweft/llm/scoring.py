"""Language-model scores: a log-bilinear model of words, trained by noise-contrastive estimation.

Tokens are lower-cased words and one end token per document. The network's vocabulary are the words
seen at least twice, at most the ``VOCABULARY`` commonest; every word has a vector as context and one as
target. The context of a token is the sum of the linearly transformed vectors of the two tokens before it. So
that probabilities can be normalised for every token, the vocabulary lies in groups of ``GROUP``
words of like frequency: a word's probability is that of its group given the context times that of the word
in its group given the context, both log-bilinear. Words beyond the vocabulary fall into classes by
their last two bytes (the commonest ``SUFFIXES`` endings, and the rest), which the network predicts like
groups; in a class their probability comes from smoothed counts, with one unknown word per class.

Training reads all training tokens once, in rounds of texts by checksum, each ``GROWTH`` times the one before; their number grows
with the logarithm of the tokens, so that more text always means more steps from a better start. In a round each task runs
stochastic noise-contrastive estimation on its own texts (some ``TASK`` tokens) from common parameters, with noise groups and
noise words of the group drawn from the unigram distribution, and parameters are averaged by tokens, in two steps of sums over
pieces of the parameters; the texts of the first round are too few to drift apart. Scores come from batched matrix products over all groups, and over all words of
a group for the tokens in it.

What is gathered: word counts by 64-bit word hash (all training tokens) and gradients of all training tokens. The
counts of the at most ``COMMON`` commonest words go to every worker; other words of a document meet
their counts in a join.

Defined cases: null and empty texts consist of the end token; a null id isn't held out and trains;
repeated rows train and are scored each; without training tokens the counts are zero and the model
is uniform over the classes; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import arrow_kernel, arrow_schema, cut, id_remainder

VOCABULARY, GROUP, SUFFIXES = 16_384, 128, 62
COMMON = 1 << 18
DIMENSIONS, GROUP_NOISE, WORD_NOISE, RATE, BATCH, SEED = 24, 64, 2, 0.15, 8192, 11
#: Contexts that are scored at a time: their scores stay in the processor's cache.
ROWS = 512
#: Tokens of a training task at least, where there are so many; how rounds grow; pieces of the parameters.
TASK, GROWTH, PARTS, SALTS = 500_000, 8, 16, 64
#: Distinct words that a task gathers before it hands them on.
GATHERED = 1 << 20
FOLDS, HELD_OUT = 5, 1


def _suffix(block: tokens.Block) -> np.ndarray:
    """The last two bytes of each word as a number (one-byte words: that byte)."""
    last = block.data[block.end - 1].astype(np.int32)
    before = np.where(block.end - block.start > 1, block.data[np.maximum(block.end - 2, 0)], 0).astype(np.int32)
    return before * 256 + last


def _signed(h: np.ndarray) -> np.ndarray:
    """Hashes as signed 64-bit numbers; the end token's is 0, which no word has."""
    return np.where(h == 0, 1, h.view(np.int64))


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, suffix, c``: how often each word occurs, and 0 with the number of documents."""
    schema = "h long, suffix int, n long"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = documents = 0

        def merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(inverse, n, len(u)).astype(np.int64)

        def give(h: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000]), pa.array(s[k : k + 100_000], pa.int32()), pa.array(n[k : k + 100_000])], schema=target)

        for batch in batches:
            documents += len(batch)
            for block in tokens.blocks(batch.column("text")):
                h = _signed(block.hashes())
                held.append(merge([(h, _suffix(block), np.ones(len(h)))]))
                size += len(held[-1][0])
                if size > GATHERED:
                    held = [merge(held)]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield from give(*held[0])
                        held, size = [], 0
        if held:
            yield from give(*merge(held))
        if documents:
            yield from give(np.array([0]), np.array([-1]), np.array([documents]))

    return docs.mapInArrow(run, schema).groupBy("h").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("c"))


class Vocabulary:
    """Word hashes and suffixes to token numbers: words by rank, the end, classes of further words."""

    def __init__(self, words: np.ndarray, suffixes: list[int]) -> None:
        if len(words) + 2 + SUFFIXES > 1 << 16:
            raise ValueError("token numbers are sorted as 16 bits")
        order = np.argsort(words)
        self.hashes, self.ranks, self.size, self.end = words[order], order.astype(np.int32), len(words), len(words)
        self.by_suffix = np.full(65536, self.end + 1 + SUFFIXES, np.int32)
        self.by_suffix[suffixes] = self.end + 1 + np.arange(len(suffixes))
        self.groups = -(-self.size // GROUP)
        self.group_of = np.concatenate([np.arange(self.size) // GROUP, self.groups + np.arange(2 + SUFFIXES)]).astype(np.int32)
        self.tokens, self.classes = len(self.group_of), self.groups + 2 + SUFFIXES

    def __call__(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = self.by_suffix[suffix]
        if self.size:
            at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
            out = np.where(self.hashes[at] == h, self.ranks[at], out)
        return out


def sequences(block: tokens.Block, vocabulary: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers with an end after each document, those one and two before (ends before the first), and document bounds."""
    n, end = len(block.rows), vocabulary.end
    bounds = block.first + np.arange(n + 1)
    x = np.full(len(h) + n, end, np.int32)
    word = np.ones(len(x), bool)
    word[bounds[1:] - 1] = False
    x[word] = vocabulary(h, _suffix(block))
    one = np.concatenate([[end], x[:-1]]).astype(np.int32)
    two = np.concatenate([[end, end], x[:-2]])[: len(x)].astype(np.int32)
    start = bounds[:-1]
    two[start] = end
    second = start + 1
    two[second[second < bounds[1:]]] = end
    return x, one, two, bounds


def _row_sums(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of their gradients; pairs of columns are summed as complex numbers, which takes half the time."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    g = np.take(g, order, axis=0)
    return at[first], np.add.reduceat(g.view(np.complex64), first, axis=0).view(np.float32) if g.ndim > 1 else np.add.reduceat(g, first)


class LogBilinear:
    """Scores of groups and words: c = A r[one] + B r[two]; c . u[group] + s[group]; c . q[word] + b[word]."""

    NAMES = ("r", "q", "u", "a", "b", "bias_q", "bias_u")

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray) -> None:
        """``counts`` by token number; biases start at the unigram distribution."""
        self.v, d = vocabulary, DIMENSIONS
        rng = np.random.Generator(np.random.Philox(SEED))
        make = lambda n, x: (rng.standard_normal((n, d)) * x).astype(np.float32)
        counts = counts + 0.5
        by_group = np.bincount(vocabulary.group_of, counts, vocabulary.classes)
        self.p_group = by_group / by_group.sum()
        self.p_word = counts[: vocabulary.size] / by_group[vocabulary.group_of[: vocabulary.size]]
        self.upto = np.concatenate([[0], np.cumsum(counts[: vocabulary.size])])
        self.p = {
            "r": make(vocabulary.tokens, 0.3), "q": make(vocabulary.size, 0.1), "u": make(vocabulary.classes, 0.1), "a": np.eye(d, dtype=np.float32), "b": np.eye(d, dtype=np.float32) / 2,
            "bias_q": np.log(self.p_word).astype(np.float32), "bias_u": np.log(self.p_group).astype(np.float32),
        }

    def start(self, rng: np.random.Generator) -> None:
        """Before the steps of a task."""
        self.rng, self.square = rng, {k: np.full(x.shape, 0.1, np.float32) for k, x in self.p.items()}
        self.odds_u, self.odds_q = (np.log(k * p).astype(np.float32) for k, p in ((GROUP_NOISE, self.p_group), (WORD_NOISE, self.p_word)))
        self.upto_u = np.cumsum(self.p_group)

    def _move(self, name: str, at, g: np.ndarray) -> None:
        s = self.square[name]
        s[at] += g * g
        self.p[name][at] += np.float32(RATE) * g / np.sqrt(s[at])

    def step(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One batch: gradients of the noise-contrastive objective, summed over its tokens."""
        p, v = self.p, self.v
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r1, r2 = np.take(p["r"], one, axis=0), np.take(p["r"], two, axis=0)
        c = r1 @ p["a"].T + r2 @ p["b"].T
        group = v.group_of[x]
        # Groups: the token's own against noise that the batch shares.
        noise = np.minimum(np.searchsorted(self.upto_u, self.rng.random(GROUP_NOISE)), v.classes - 1)
        own = np.take(p["u"], group, axis=0)
        g_own = 1 - sigmoid(np.einsum("bd,bd->b", c, own) + p["bias_u"][group] - self.odds_u[group])
        g_noise = -sigmoid(c @ p["u"][noise].T + p["bias_u"][noise] - self.odds_u[noise])
        back = g_own[:, None] * own + g_noise @ p["u"][noise]
        moves = [("u", *_row_sums(np.concatenate([group, noise]), np.concatenate([g_own[:, None] * c, g_noise.T @ c])))]
        at, g = _row_sums(np.concatenate([group, noise]), np.concatenate([g_own, g_noise.sum(0)]))
        moves.append(("bias_u", at, g))
        # Words: the token's own against noise from its group.
        is_word = np.flatnonzero(x < v.size)
        if len(is_word):
            w, cw = x[is_word], c[is_word]
            low = self.upto[group[is_word] * GROUP]
            high = self.upto[np.minimum((group[is_word] + 1) * GROUP, v.size)]
            drawn = np.searchsorted(self.upto, low + self.rng.random((WORD_NOISE, len(w))) * (high - low), "right") - 1
            some = np.concatenate([w[None], np.clip(drawn, 0, v.size - 1)])
            q = np.take(p["q"], some, axis=0)
            g = -sigmoid(np.einsum("kbd,bd->kb", q, cw) + p["bias_q"][some] - self.odds_q[some])
            g[0] += 1
            back[is_word] += np.einsum("kb,kbd->bd", g, q)
            moves.append(("q", *_row_sums(some.ravel(), (g[:, :, None] * cw).reshape(-1, cw.shape[1]))))
            moves.append(("bias_q", *_row_sums(some.ravel(), g.ravel())))
        moves.append(("r", *_row_sums(np.concatenate([one, two]), np.concatenate([back @ p["a"], back @ p["b"]]))))
        moves += [("a", slice(None), back.T @ r1), ("b", slice(None), back.T @ r2)]
        for name, at, g in moves:
            self._move(name, at, g.astype(np.float32))

    def log10(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's group, and of words in it."""
        p, v = self.p, self.v
        out = np.empty(len(x))
        c = np.take(p["r"] @ p["a"].T, one, axis=0) + np.take(p["r"] @ p["b"].T, two, axis=0)
        group = np.take(v.group_of, x)
        u = np.ascontiguousarray(p["u"].T)
        for k in range(0, len(x), ROWS):
            out[k : k + ROWS] = _log_softmax(c[k : k + ROWS] @ u + p["bias_u"], group[k : k + ROWS])
        order = np.argsort(group.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(v.groups + 1))
        for k in range(v.groups):
            a, b = k * GROUP, min((k + 1) * GROUP, v.size)
            q = np.ascontiguousarray(p["q"][a:b].T)
            for j in range(bounds[k], bounds[k + 1], ROWS):
                m = order[j : min(j + ROWS, bounds[k + 1])]
                out[m] += _log_softmax(np.take(c, m, axis=0) @ q + p["bias_q"][a:b], np.take(x, m) - a)
        return out / np.log(10)


def _log_softmax(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The normalised logarithm at one column of each row; ``s`` is overwritten."""
    at = np.arange(len(s))
    picked = s[at, own]
    if s.max() > 80:  # beyond what single precision takes
        top = s.max(1)
        return picked - top - np.log(np.exp(s - top[:, None]).sum(1))
    return picked - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))


def _averaged(rows: DataFrame, *keys: str) -> DataFrame:
    """Of ``part, salt, weight, sums`` the sums by the keys; a task holds one sum at a time for each of its keys."""
    schema = "part int, salt int, weight double, sums binary"
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, salt, weight, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "weight", "sums")), strict=True):
                x = held.setdefault((part, salt if "salt" in keys else 0), [0.0, 0.0])
                x[0] += weight
                x[1] = x[1] + np.frombuffer(sums)
        for (part, salt), (weight, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([weight]), pa.array([sums.tobytes()], pa.binary())], schema=target)

    return rows.repartition(*keys).mapInArrow(run, schema)


def train_round(texts: DataFrame, model: LogBilinear, tasks: int) -> None:
    """Each task trains from the model's parameters on its own texts; the model takes the average by tokens."""
    schema = "part int, salt int, weight double, sums binary"
    target = arrow_schema(texts.sparkSession, schema)
    common = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, own, done = TaskContext.get().partitionId(), common.value, 0
        own.p = {k: x.copy() for k, x in own.p.items()}  # a worker may serve several tasks
        rng = np.random.Generator(np.random.Philox(key=[SEED, at]))
        own.start(rng)
        for batch in batches:
            for block in tokens.blocks(batch.column("text")):
                x, one, two, _ = sequences(block, own.v, _signed(block.hashes()))
                order = rng.permutation(len(x))
                for k in range(0, len(x), BATCH):
                    m = order[k : k + BATCH]
                    own.step(x[m], one[m], two[m])
                done += len(x)
        if done:
            flat = np.concatenate([own.p[n].ravel() for n in own.NAMES]).astype(float) * done
            for k, piece in enumerate(np.array_split(flat, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at % SALTS], pa.int32()), pa.array([float(done)]), pa.array([piece.tobytes()], pa.binary())], schema=target)

    trained = texts.coalesce(tasks).mapInArrow(run, schema)
    found = _averaged(_averaged(trained, "part", "salt"), "part").toArrow().sort_by("part")  # PARTS rows
    common.destroy()
    if found.num_rows:
        flat = np.concatenate([np.frombuffer(x) / w for x, w in zip(found.column("sums").to_pylist(), found.column("weight").to_pylist(), strict=True)])
        for n in model.NAMES:
            size = model.p[n].size
            model.p[n] = flat[:size].reshape(model.p[n].shape).astype(np.float32)
            flat = flat[size:]


def rounds(tokens_: int) -> int:
    """Two, and one more each time the tasks grow by ``GROWTH``; parts of a checksum bound them."""
    n = 2
    while n < 11 and tokens_ > TASK * GROWTH ** (n - 1):
        n += 1
    return n


class Trained(NamedTuple):
    """Stored word counts and what each worker needs: model, logarithms of class sums, counts of vocabulary and common words."""

    counts: DataFrame
    model: LogBilinear
    within: np.ndarray
    own_log: np.ndarray
    common_h: np.ndarray
    common_log: np.ndarray
    n_train: int
    n_distinct: int


def train(texts: DataFrame) -> Trained:
    """Counts and model of a column ``text``."""
    spark = texts.sparkSession
    counts = cut(word_counts(texts), "lm-words")
    # The commonest words by steps of the count, as many whole steps as fit in COMMON.
    step = F.floor(F.log2("c") * 8).cast("int")
    levels = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).toArrow().sort_by([("step", "descending")]).to_pydict()
    least, some = 0, 0
    for level, n in zip(levels["step"], levels["n"], strict=True):
        if some + n > COMMON:
            least = level + 1
            break
        some += n
    common = counts.where(step >= least).select("h", "c").toArrow().sort_by("h")  # at most COMMON rows
    common_h, common_log = common.column("h").to_numpy(), np.log10(common.column("c").to_numpy() + 0.5)
    ends = counts.where("h = 0").agg(F.sum("c")).first()[0] or 0
    words = counts.where("h != 0 AND c > 1").orderBy(F.desc("c"), "h").limit(VOCABULARY).select("h", "c").toArrow()
    order = np.lexsort((words.column("h").to_numpy(), -words.column("c").to_numpy()))
    word_h, word_c = words.column("h").to_numpy()[order], words.column("c").to_numpy()[order]
    listed = F.broadcast(spark.createDataFrame(pa.table({"h": word_h})))  # at most VOCABULARY rows
    rest = counts.where("h != 0").join(listed, "h", "left_anti")
    rest = rest.groupBy("suffix").agg(F.count("*").alias("v"), F.sum("c").alias("n")).toArrow().sort_by([("n", "descending"), ("suffix", "ascending")])  # at most 65536 rows
    suffix, distinct, total = (rest.column(c).to_numpy() for c in ("suffix", "v", "n"))
    vocabulary = Vocabulary(word_h, suffix[:SUFFIXES].tolist())
    held = np.zeros(vocabulary.tokens)
    held[: vocabulary.size], held[vocabulary.end] = word_c, ends
    kinds = np.zeros(vocabulary.tokens)
    np.add.at(held, vocabulary.by_suffix[suffix], total)
    np.add.at(kinds, vocabulary.by_suffix[suffix], distinct)
    model = LogBilinear(vocabulary, held)
    n_train = int(held.sum())
    if n_train:
        last = rounds(n_train) - 1
        part = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(GROWTH**last))
        for k in range(last + 1):
            low, high = (GROWTH ** (k - 1) if k else 0), GROWTH**k
            train_round(texts.where((part >= low) & (part < high)), model, max(1, n_train * (high - low) // GROWTH**last // TASK))
    else:
        model.p["r"][:] = 0
    # Words of a class share its probability by their counts, one unknown word among them.
    within = np.log10(held + 0.5 * (kinds + 1))
    return Trained(counts, model, within, np.log10(held[: vocabulary.end + 1] + 0.5), common_h, common_log, n_train, int(vocabulary.size + distinct.sum() + (ends > 0)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored(docs, train(docs.where(~held).select("text")), held)


def scored(docs: DataFrame, trained: Trained, held: Column) -> DataFrame:
    """Scores of ``doc_id, text`` under a trained model."""
    table = docs.sparkSession.sparkContext.broadcast(tuple(trained[1:6]))
    schema = "doc_id long, n_tokens long, common_known long, model double, common double, unseen array<long>"

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        model, within, own_log, common_h, common_log = table.value
        end_at = np.searchsorted(common_h, 0) if len(common_h) else 0
        end_common = len(common_h) and end_at < len(common_h) and common_h[end_at] == 0
        end = model.v.end
        for block in tokens.blocks(batch.column("text")):
            h = _signed(block.hashes())
            x, one, two, bounds = sequences(block, model.v, h)
            # The token's count enters with the base's sums; words of the vocabulary and ends need none.
            own = model.log10(x, one, two) - np.where(x <= end, own_log[np.minimum(x, end)], within[x])
            sums = np.concatenate([[0], np.cumsum(own)])
            at = np.minimum(np.searchsorted(common_h, h), max(len(common_h) - 1, 0))
            hit = common_h[at] == h if len(common_h) else np.zeros(len(h), bool)
            logs = np.concatenate([[0], np.cumsum(np.where(hit, common_log[at], 0.0) if len(common_h) else np.zeros(len(h)))])
            hits = np.concatenate([[0], np.cumsum(hit)])
            misses = h[~hit]
            lists = np.concatenate([[0], np.cumsum(~hit)])[block.first]
            f = block.first
            n = len(block.rows)
            unseen = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(misses))
            if not end_common:  # the end token is looked up like a rare word
                values = np.insert(misses, lists[1:], 0)
                unseen = pa.ListArray.from_arrays(pa.array(lists + np.arange(n + 1), pa.int32()), pa.array(values))
            yield {
                "doc_id": batch.column("doc_id").slice(block.rows.start, n), "n_tokens": np.diff(bounds),
                "common_known": hits[f[1:]] - hits[f[:-1]] + int(end_common), "model": sums[bounds[1:]] - sums[bounds[:-1]],
                "common": logs[f[1:]] - logs[f[:-1]] + (common_log[end_at] if end_common else 0.0), "unseen": unseen,
            }

    parts = cut(arrow_kernel(docs, schema, rows).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    words = parts.select("row", F.explode("unseen").alias("h"))
    known = words.join(trained.counts.select("h", "c"), "h").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 0.5)).alias("rare"))
    unseen = F.size("unseen") - F.coalesce("rare_known", F.lit(0))
    logs = F.col("common") + F.coalesce("rare", F.lit(0.0)) + unseen * F.log10(F.lit(0.5))
    return parts.join(known, "row", "left").select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(trained.n_train).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(trained.n_train + 0.5 * (trained.n_distinct + 1))))).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
