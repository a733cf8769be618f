"""Hidden Markov language model: counts, Baum-Welch training and exact likelihoods.

Method: expected counts of Baum-Welch are summed within each partition and added up
across partitions by Spark; the next model goes out as a broadcast of fixed size.  A text's
likelihood is the scaled forward recursion over its whole token sequence.  The recursion
runs over pieces of ``PIECE`` tokens at once as products of state matrices, which are then
chained from piece to piece, so that it is exact for texts of any length.

Vocabulary: every distinct training word is counted.  Words found ``min_count`` times or more
are symbols of their own, with emissions of their own in each state, so their number grows with
the corpus, up to ``symbols`` of the most frequent (a bound of memory: 8 bytes a state and word on
the driver and in each task).  All others are too rare to say anything of states and emit one of 256
classes (by their last bytes), and a word's share of its class follows its count, with one
place for unknown words, so the probabilities of all words sum to one.  Counts of at most
``HEAD`` frequent words are broadcast (16 bytes each, a fixed bound); the rest of the tokens
look theirs up in a shuffle join, so no vocabulary size is assumed.  Words meet by a 64-bit
hash.

Expected counts travel as one row for each word that a task has seen, with a number for each state.

Defined cases: null or empty texts have one token, the end; ids are of any type and pass through;
columns beside id and text are not read and do not come out; texts of any length are read whole; a null id is neither held out
nor learnt from; with no training text N and V are 0; repeated rows count and score one by
one; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Frequent words whose counts are broadcast at most.
HEAD = 1 << 20
#: Words found less often have no emissions of their own.
MIN_COUNT = 64
#: Tokens of a piece of the recursion; classes of rare words.
PIECE, CLASSES = 64, 256
#: Tasks a core of a round of training at most.
TASKS_A_CORE = 2
#: Distinct words a task gathers before it hands on their counts.
GATHER = 1 << 21


# ----------------------------------------------------------------------------- counting


def _words(texts: list[bytes]):
    """Words, distinct hashes, the distinct word of each token, class of each distinct word."""
    w = C.Words([C.lower_ascii(t) for t in texts], C.SPACE)
    u, at, inverse = np.unique(C.word_hashes(w), return_index=True, return_inverse=True)
    last = w.data[w.end[at] - 1].astype(np.int64)
    before = w.data[np.maximum(w.end[at] - 2, w.start[at])].astype(np.int64)
    return w, u, inverse, (last * 31 + before * 17) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def merged():
        h = np.concatenate([x[0] for x in held])
        u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([x[2] for x in held])).astype(np.int64)
        return u, np.concatenate([x[1] for x in held])[at], n

    def out(u, c, n):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "c", "n"])

    for batch in batches:
        for _, texts in C.text_slices(batch.column(0)):
            _, u, inverse, c = _words(texts)
            held.append((u, c, np.bincount(inverse, minlength=len(u))))
            size += len(u)
            if size > 2 * GATHER:
                held = [merged()]
                size = len(held[0][0])
                if size > GATHER:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*merged())


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c, n): hash, class and count of every distinct word of the only column."""
    return texts.mapInArrow(_count, "h long, c int, n long").groupBy("h").agg(F.min("c").alias("c"), F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach, from a histogram of fixed size."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    total, least = 0, (steps[0]["least"] + 1 << 8) if steps else 1
    for s in steps:
        total += s["k"]
        if total > most:
            break
        least = s["least"]
    return least


@dataclass
class Vocabulary:
    """What every executor holds: frequent words, class totals and the corpus totals."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    ends: int
    tokens: int
    words: int
    n_symbols: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def within_class(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.class_tokens + 0.5 * (self.class_words + 1))[k])

    @property
    def end(self) -> int:
        return self.n_symbols + CLASSES


def vocabulary(counts: DataFrame, ends: int, symbols: int, head: int = HEAD, min_count: int = MIN_COUNT) -> Vocabulary:
    """``counts`` must be settled: it is read several times."""
    t_symbol, t_head = max(min_count, _threshold(counts, symbols)), _threshold(counts, head)
    table = counts.filter(F.col("n") >= min(t_head, t_symbol)).select("h", "n", "c").toArrow()
    h = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, n = h[order], table.column(1).to_numpy()[order]
    own = n >= t_symbol
    symbol = np.where(own, np.cumsum(own) - 1, -1)
    totals = counts.groupBy("c").agg(F.sum(F.when(F.col("n") < t_symbol, F.col("n"))).alias("t"), F.count(F.when(F.col("n") < t_symbol, 1)).alias("w"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("v")).collect()
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        tokens[r["c"]], words[r["c"]] = r["t"] or 0, r["w"]
    n_all, v_all = sum(r["all"] for r in totals) + ends, sum(r["v"] for r in totals) + (ends > 0)
    return Vocabulary(h, n, symbol, tokens, words, ends, n_all, v_all, int(own.sum()))


# ----------------------------------------------------------------------------- encoding

ENCODED = "rid long, doc_id {id}, held_out boolean, n_tokens long, known long, base double, inner double, seq binary, tail array<struct<h:long,c:int>>"


def encode(docs: DataFrame, vocab, text: str = "text") -> DataFrame:
    """Each row of rid, doc_id, held_out, ``text`` as a sequence of symbols.

    Tokens outside the broadcast words stand in ``tail``; ``known``, ``base`` and
    ``inner`` sum what the others add to the known tokens and the scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        for batch in batches:
            for lo, texts in C.text_slices(batch.column(3)):
                yield _encode(batch.slice(lo, len(texts)), texts, v)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "doc_id", "held_out", text).mapInArrow(run, ENCODED.format(id=id_type))


def _encode(rows: pa.RecordBatch, texts: list[bytes], v: Vocabulary) -> pa.RecordBatch:
    n = len(texts)
    w, u, inverse, cls = _words(texts)
    if len(v.hashes):
        k = np.minimum(np.searchsorted(v.hashes, u), len(v.hashes) - 1)
        found = v.hashes[k] == u
        count, symbol = np.where(found, v.counts[k], 0), np.where(found, v.symbol[k], -1)
    else:
        found, count, symbol = np.zeros(len(u), bool), np.zeros(len(u), np.int64), np.full(len(u), -1)
    inner = np.where(found & (symbol < 0), v.within_class(count, cls), 0.0)
    seq_of = np.where(symbol >= 0, symbol, v.n_symbols + cls)
    owner = w.owner()
    sums = lambda x: np.bincount(owner, weights=x[inverse], minlength=n).astype(np.float64)
    known = sums(found.astype(float)).astype(np.int64) + (v.ends > 0)
    base = sums(np.where(found, v.base(count), 0.0)) + v.base(np.array(v.ends))
    size = np.diff(w.first)
    seq = np.full(len(inverse) + n, v.end, dtype=np.uint32)
    seq[np.arange(len(inverse)) + owner] = seq_of[inverse]
    offsets = np.concatenate(([0], np.cumsum(4 * (size + 1)))).astype(np.int32)
    rare = np.flatnonzero(~found[inverse])
    tail_at = np.searchsorted(rare, w.first).astype(np.int32)
    tail = pa.StructArray.from_arrays([pa.array(u[inverse[rare]].view(np.int64)), pa.array(cls[inverse[rare]].astype(np.int32))], names=["h", "c"])
    return pa.RecordBatch.from_arrays(
        [
            *(rows.column(i) for i in range(3)),
            pa.array(size + 1),
            pa.array(known),
            pa.array(base),
            pa.array(sums(inner)),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(seq)]),
            pa.ListArray.from_arrays(pa.array(tail_at), tail),
        ],
        names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "seq", "tail"],
    )


def _sequences(column, limit: int = 1 << 20):
    """(first row, symbols of all rows, where each row begins) in slices of bounded size."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    values = np.frombuffer(column.buffers()[2], dtype=np.uint32)
    lo = 0
    while lo < len(column):
        hi = min(len(column), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit // 4, side="right")) - 1))
        yield lo, values[offsets[lo] : offsets[hi]].astype(np.int64), offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# -------------------------------------------------------------------------------- model


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def _local(seq: np.ndarray, m: Hmm) -> tuple[np.ndarray, np.ndarray, Hmm]:
    """The symbols that occur, the sequence as places among them, and the model of those alone,
    so that a slice costs no more for a large vocabulary."""
    used, place = np.unique(seq, return_inverse=True)
    return used, place, Hmm(m.start, m.move, m.emit[:, used])


class _Pieces:
    """Sequences cut into pieces of PIECE tokens, longest pieces first."""

    def __init__(self, seq: np.ndarray, first: np.ndarray):
        length = np.diff(first)
        self.n_docs = len(length)
        n = (length + PIECE - 1) // PIECE
        self.begin = np.concatenate(([0], np.cumsum(n)))
        doc = np.repeat(np.arange(self.n_docs), n)
        inner = np.arange(self.begin[-1]) - self.begin[doc]
        size = np.minimum(PIECE, length[doc] - inner * PIECE)
        self.order = np.argsort(-size, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        at = (first[doc] + inner * PIECE)[self.order]
        size = size[self.order]
        self.is_first = (inner == 0)[self.order]
        self.active = np.array([int((size > t).sum()) for t in range(PIECE)])
        grid = at[:, None] + np.arange(PIECE)
        self.symbol = seq[np.minimum(grid, len(seq) - 1)]
        self.n = n

    def chain_order(self):
        """For piece 0, 1, ... of each text: (texts that have it, its row)."""
        docs = np.argsort(-self.n, kind="stable")
        for j in range(int(self.n.max(initial=0))):
            docs = docs[self.n[docs] > j]
            yield docs, self.place[self.begin[docs] + j]


def _products(p: _Pieces, m: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the product of its state matrices, scaled, and the log of the scale."""
    k, n = len(m.start), len(p.symbol)
    emit = np.ascontiguousarray(m.emit.T)
    x = np.where(p.is_first[:, None, None], m.start[None, None, :], m.move[None]) * emit[p.symbol[:, 0]][:, None, :]
    log = np.zeros(n)
    for t in range(1, PIECE):
        a = p.active[t]
        if not a:
            break
        x[:a] = (x[:a].reshape(a * k, k) @ m.move).reshape(a, k, k) * emit[p.symbol[:a, t]][:, None, :]
        if t % 8 == 0 or t == PIECE - 1:
            top = x[:a].max(axis=(1, 2))
            x[:a] /= top[:, None, None]
            log[:a] += np.log(top)
    return x, log


def _forward(p: _Pieces, m: Hmm, product: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each text, state shares before each piece)."""
    k = len(m.start)
    likelihood, state = np.zeros(p.n_docs), np.full((p.n_docs, k), 1.0 / k)
    before = np.zeros((len(product), k))
    for docs, rows in p.chain_order():
        v = state[docs]
        before[rows] = v
        v = np.einsum("dk,dkl->dl", v, product[rows])
        total = v.sum(axis=1)
        likelihood[docs] += np.log(total) + log[rows]
        state[docs] = v / total[:, None]
    return likelihood, before


def log_likelihood(seq: np.ndarray, first: np.ndarray, m: Hmm) -> np.ndarray:
    """Natural logarithm of the probability of each sequence."""
    if not len(seq):
        return np.zeros(len(first) - 1)
    p = _Pieces(seq, first)
    product, log = _products(p, m)
    return _forward(p, m, product, log)[0]


def expected_counts(seq: np.ndarray, first: np.ndarray, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(starts, moves, emissions, log likelihood) expected over the sequences."""
    p = _Pieces(seq, first)
    k, s = m.emit.shape
    product, log = _products(p, m)
    likelihood, before = _forward(p, m, product, log)
    after = np.ones((len(product), k))
    for docs, rows in reversed(list(p.chain_order())):
        back = np.einsum("dkl,dl->dk", product[rows], after[rows])
        back /= back.sum(axis=1, keepdims=True)
        has_previous = ~p.is_first[rows]
        j = p.place[p.order[rows[has_previous]] - 1]
        after[j] = back[has_previous]
    emit = np.ascontiguousarray(m.emit.T)
    n = len(p.symbol)
    alpha = np.zeros((PIECE, n, k))
    a = np.where(p.is_first[:, None], m.start[None], before @ m.move) * emit[p.symbol[:, 0]]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, PIECE):
        c = p.active[t]
        if not c:
            break
        a = (alpha[t - 1, :c] @ m.move) * emit[p.symbol[:c, t]]
        alpha[t, :c] = a / a.sum(axis=1, keepdims=True)
    beta = after.copy()
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((k, s))
    for t in range(PIECE - 1, -1, -1):
        c = p.active[t]
        if not c:
            continue
        g = alpha[t, :c] * beta[:c]
        g /= g.sum(axis=1, keepdims=True)
        for i in range(k):
            emissions[i] += np.bincount(p.symbol[:c, t], weights=g[:, i], minlength=s)
        right = emit[p.symbol[:c, t]] * beta[:c]
        left = alpha[t - 1, :c] if t else before[:c]
        inner = slice(None) if t else ~p.is_first[:c]
        norm = np.einsum("ni,ij,nj->n", left, m.move, right)
        moves += (left[inner] / norm[inner, None]).T @ right[inner] * m.move
        if t == 0:
            starts += g[p.is_first[:c]].sum(axis=0)
        b = right @ m.move.T
        beta[:c] = b / b.sum(axis=1, keepdims=True)
    return starts, moves, emissions, float(likelihood.sum())


def initial(unigram: np.ndarray, states: int) -> Hmm:
    """Clinging states whose emissions are the unigram bent by a hash of state and symbol."""
    ids = np.arange(states, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(len(unigram), dtype=np.uint64)
    bend = 0.2 + 1.6 * (C.mix64(ids + np.uint64(0x5EED)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    emit = unigram * bend
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1.0 / states), move, emit / emit.sum(axis=1, keepdims=True))


def train(encoded: DataFrame, unigram: np.ndarray, states: int = 6, rounds: int = 4, prior: float = 50.0) -> Hmm:
    """Baum-Welch over all rows of ``encoded`` (column ``seq``).

    A round runs in at most ``TASKS_A_CORE`` tasks a core, so that a word's counts are added up
    within tasks as far as can be: what is shuffled follows cores and words, not input splits.
    """
    model, names = initial(unigram, states), [f"n{i}" for i in range(states)]
    sc = encoded.sparkSession.sparkContext
    dealt = encoded.select("seq").coalesce(TASKS_A_CORE * sc.defaultParallelism)
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, total = shared.value, None
            for batch in batches:
                for _, seq, first in _sequences(batch.column(0)):
                    used, place, mine = _local(seq, m)
                    start, move, emit = expected_counts(place, first, mine)[:3]
                    if total is None:
                        total = np.zeros(len(start)), np.zeros(move.shape), np.zeros(m.emit.shape)
                    total[0][:] += start
                    total[1][:] += move
                    total[2][:, used] += emit
            if total is not None:
                some = np.flatnonzero(total[2].any(axis=0))
                # Starts stand under -1, the moves into state j under -2 - j.
                key = np.concatenate([some, -1 - np.arange(states + 1)])
                n = np.concatenate([total[2][:, some], total[0][:, None], total[1]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(row, pa.float32()) for row in n)], names=["k", *names])

        sums = [F.sum(F.col(c).cast("double")).alias(c) for c in names]
        rows = dealt.mapInArrow(count, "k long, " + ", ".join(f"{c} float" for c in names)).groupBy("k").agg(*sums).toArrow()
        total = np.zeros((states, 1 + states + len(unigram)))
        if rows.num_rows:
            k = rows.column(0).to_numpy()
            total[:, np.where(k >= 0, 1 + states + k, -1 - k)] = np.stack([rows.column(1 + i).to_numpy() for i in range(states)])
        shared.unpersist()
        start, move, emit = total[:, 0] + 1, total[:, 1 : 1 + states] + 1, total[:, 1 + states :]
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit + prior * unigram) / (emit.sum(axis=1, keepdims=True) + prior))
    return model


def score(encoded: DataFrame, model: Hmm) -> DataFrame:
    """``encoded`` without seq and tail, plus ``forward``: log10 likelihood of the symbols."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, seq, first in _sequences(batch.column(7)):
                _, place, mine = _local(seq, shared.value)
                parts.append(log_likelihood(place, first, mine) / np.log(10))
            out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out)], names=[*names, "forward"])

    kinds = ["long", encoded.schema["doc_id"].dataType.simpleString(), "boolean", "long", "long", "double", "double", "double"]
    return encoded.select(*names, "seq").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip([*names, "forward"], kinds, strict=True)))


def score_texts(docs: DataFrame, train_when: Column, held_out: Column, doc_id: str = "doc_id", text: str = "text", states: int = 6, rounds: int = 4, symbols: int = HEAD, head: int = HEAD, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    learnt = docs.filter(train_when)
    counts = C.settle(word_counts(learnt.select(F.col(text).alias("text"))))
    vocab = vocabulary(counts, learnt.count(), symbols, head, min_count)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocab)
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.coalesce(train_when, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    flag = F.when(F.col("learn"), F.col("rid")).otherwise(-1 - F.col("rid"))  # the sign tells what is learnt from
    encoded = C.settle(encode(slim.withColumn("rid", flag), shared))
    unigram = np.zeros(vocab.end + 1)
    own = vocab.symbol >= 0
    unigram[vocab.symbol[own]] = vocab.counts[own]
    unigram[vocab.n_symbols : vocab.end] = vocab.class_tokens
    unigram[vocab.end] = vocab.ends
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    model = train(encoded.filter("rid >= 0"), unigram, states, rounds)
    n, v = vocab.tokens, vocab.words
    per_class = F.array(*[F.lit(float(x)) for x in vocab.class_tokens + 0.5 * (vocab.class_words + 1)])
    rare = encoded.select("rid", F.explode("tail").alias("t")).select("rid", "t.h", "t.c")
    seen = rare.join(counts.select("h", "n"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = seen.groupBy("rid").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("t_known"),
        F.sum(F.log10((F.col("n") + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("t_base"),
        F.sum(F.log10((F.col("n") + 0.5) / F.element_at(per_class, F.col("c") + 1))).alias("t_inner"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return score(encoded, model).join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("t_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base")).alias("base_score"),
        (F.col("forward") + F.col("inner") + zero("t_inner")).alias("score"),
    )
