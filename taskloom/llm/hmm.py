"""Language model scoring with a hidden Markov model, over all words of the corpus.

Latent states emit words through classes. Each of the most frequent words is a
class; any other word's class is told by its last bytes; the end of a text is a
class of its own. Baum-Welch trains states over classes: each partition runs
the scaled forward and backward recursions over its whole texts, and expected
counts are summed across partitions. The last round counts, for every other word
too, how often each state emits it; that table is partitioned by word and grows
with the vocabulary. A word of at least LEAST occurrences has its own emission in
each state, shrunk towards its class's:

    P(word | state) = P(class | state) * (n(word, state) + firm * share(word)) / (n(class, state) + firm)

Words below that, and one for all words never seen, share what is left of their class in
proportion to their counts plus one. All words of a class together have its probability.

The score is the scaled forward recursion's exact likelihood of the whole text.
The frequent words go to all tasks; texts meet the other words' counts and
emissions in a join, in chunks of many texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm import _blobs, _words
from taskloom.llm._memory import lean, lean_cogroup, lean_group
from taskloom.llm._store import Workspace, shuffle_width

#: Classes of frequent words at most, then those of other words, then that of the end of a text.
FREQUENT, RARE = 64_000, 1024
END = FREQUENT + RARE
#: Occurrences from which a word has emissions of its own; words joined in one task; tokens of a chunk, and of what one recursion holds.
LEAST, TASK_WORDS, HELD, WAVE = 5, 1 << 20, 1 << 19, 3 << 18
#: Tokens from which on a text's recursions go piece by piece, and those of a piece.
LONG, PIECE = 1 << 18, 1 << 14
#: Slots, at most, of the filter that tells words with emissions of their own.
FILTER = 1 << 26
_END_HASH = np.uint64(0x656E642D6F66)


@dataclass(frozen=True)
class Settings:
    states: int = 8
    #: Rounds at most; training stops before where a round gains less than this, in nats a token.
    rounds: int = 5
    gain: float = 1e-4
    seed: int = 29
    #: Part of the corpus's class shares in each state's, and how firmly states hold at first.
    prior: float = 0.03
    stay: float = 0.9
    #: Words that are classes of their own, at most; not over FREQUENT.
    frequent: int = FREQUENT
    #: How many occurrences a word's share of its class counts for in its own emissions.
    firm: float = 2.0


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # by class, then state


class Frequent:
    """The frequent words in order of their hashes, with their counts; a word's class is its place here."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, kinds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.kinds = hashes[order], counts[order], kinds[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the words are frequent)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def classes(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes, whether the words are frequent)."""
        at, hit = self.find(hashes)
        return np.where(hit, at, FREQUENT + rare_class(tails)).astype(np.uint16), hit


def rare_class(tails: np.ndarray) -> np.ndarray:
    return (_words.mix(tails.astype(np.uint64)) % np.uint64(RARE)).astype(np.int64)


def _flat(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens, lengths, where each sequence begins)."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
    return flat, lengths, np.cumsum(lengths) - lengths


def _waves(lengths: np.ndarray, tokens: int) -> Iterator[np.ndarray]:
    """Sequences that aren't empty by falling length, in groups of about so many tokens."""
    order = np.argsort(-lengths, kind="stable")[: int((lengths > 0).sum())]
    ends = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")))
        yield order[at:end]
        at = end


def _steps(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all tokens step by step, where each step begins) of sequences by falling length: the first tokens of all, then the second ones of those that have one."""
    live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right")
    edge = np.concatenate(([0], np.cumsum(live)))
    column = np.arange(edge[-1]) - np.repeat(edge[:-1], live)
    return begin[column] + np.repeat(np.arange(len(live)), live), edge


def _relative(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions by their row's greatest, and its logarithm: so no step underflows, however rare a word is."""
    top = np.maximum(emit.max(axis=1), 1e-300)
    return emit / top[:, None], np.log(top)


def forward(model: Model, sequences: list[np.ndarray], emit: np.ndarray | None = None) -> np.ndarray:
    """Natural log likelihood of each sequence of rows of ``emit``, the model's classes if not given, by the scaled recursion."""
    rows, top = _relative(model.emit if emit is None else emit)
    flat, lengths, begin = _flat(sequences)
    out, one = np.zeros(len(sequences)), np.ones(len(model.start))
    for wave in _waves(lengths, WAVE):
        place, edge = _steps(begin[wave], lengths[wave])
        tokens = flat[place]
        seen, scale = rows[tokens], np.empty(len(tokens))
        edges = edge.tolist()
        alpha = model.start[None] * seen[: edges[1]]
        for t in range(len(edges) - 1):
            a, b = edges[t], edges[t + 1]
            if t:
                alpha = alpha[: b - a] @ model.move
                alpha *= seen[a:b]
            s = alpha @ one
            scale[a:b] = s
            alpha /= s[:, None]
        total = np.log(scale) + top[tokens]
        column = np.arange(len(tokens)) - np.repeat(edge[:-1], np.diff(edge))
        out[wave] = np.bincount(column, total, len(wave))
    return out


@dataclass
class Expected:
    """What the expectation step counts: moves between states, starts and the log likelihood."""

    moves: np.ndarray
    starts: np.ndarray
    loglik: float = 0.0


def posteriors(model: Model, sequences: list[np.ndarray], counts: Expected) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places among all sequences' tokens, each state's probability there) of the forward and backward recursions over whole sequences.

    Adds moves, starts and the log likelihood to ``counts``. A very long
    sequence goes piece by piece: forward first, keeping the states before
    each piece, then backward, so that it holds one piece at a time.
    """
    rows, top = _relative(model.emit)
    flat, lengths, begin = _flat(sequences)
    if not len(flat):
        return
    counts.loglik += float(top[flat].sum())
    emit, move = rows.astype(np.float32), model.move.astype(np.float32)
    ordinary = np.where(lengths <= LONG, lengths, 0)
    for wave in _waves(ordinary, WAVE):
        n = lengths[wave]
        inner = _recursion(emit, move, flat, begin[wave], n, model.start.astype(np.float32)[None], None, None)
        counts.starts += inner[2]
        counts.moves += inner[1] * model.move
        counts.loglik += inner[3]
        yield inner[0]
    for i in np.flatnonzero(lengths > LONG).tolist():
        cuts = range(0, int(lengths[i]), PIECE)
        before = [np.full(len(model.start), np.nan)]
        state = None
        for c in cuts:
            own = emit[flat[begin[i] + c : begin[i] + min(c + PIECE, int(lengths[i]))]]
            for e in own:
                state = (model.start if state is None else state @ move) * e
                state = state / state.sum()
            before.append(state)
        after = None
        for c, old in reversed(list(zip(cuts, before, strict=False))):
            n = np.array([min(PIECE, int(lengths[i]) - c)])
            inner = _recursion(emit, move, flat, begin[i : i + 1] + c, n, (model.start if not c else old @ model.move).astype(np.float32)[None], None if not c else old, after)
            after = inner[4]
            counts.moves += inner[1] * model.move
            counts.loglik += inner[3]
            if not c:
                counts.starts += inner[2]
            yield inner[0]


def _recursion(emit: np.ndarray, move: np.ndarray, flat: np.ndarray, at: np.ndarray, n: np.ndarray, first: np.ndarray, old: np.ndarray | None, after: np.ndarray | None):
    """((places, posteriors), moves by sums of alpha and beta, states at the first tokens, log likelihood, beta before the first).

    Of sequences by falling length n that begin at places ``at``, from the state probabilities ``first`` of
    their first tokens. Of one piece of a longer sequence: ``old`` has the states before it, ``after`` the beta behind it.
    """
    k = move.shape[0]
    place, edge = _steps(at, n)
    seen = emit[flat[place]]
    edges, back = edge.tolist(), np.ascontiguousarray(move.T)
    alpha, scale, one = np.empty_like(seen), np.empty(len(place), np.float32), np.ones(k, np.float32)
    before = None
    for t in range(len(edges) - 1):
        a, b = edges[t], edges[t + 1]
        now = alpha[a:b]
        if before is None:
            np.multiply(first, seen[a:b], out=now)
        else:
            np.matmul(before[: b - a], move, out=now)
            now *= seen[a:b]
        s = now @ one
        scale[a:b] = s
        now /= s[:, None]
        before = now
    # From here on seen is beta times emission by scale, and then the posterior.
    seen /= scale[:, None]
    beta = np.ones((edges[-1] - edges[-2], k), np.float32)
    if after is not None:
        beta[0] = after / (alpha[-1] @ after)
    moves = np.zeros((k, k))
    for t in range(len(edges) - 2, 0, -1):
        a, b, c = edges[t - 1], edges[t], edges[t + 1]
        onward = seen[b:c]
        onward *= beta
        moves += alpha[a : a + c - b].T @ onward
        alpha[b:c] *= beta
        beta = np.ones((b - a, k), np.float32)
        np.matmul(onward, back, out=beta[: c - b])
    start = seen[: edges[1]] * beta
    alpha[: edges[1]] *= beta
    if old is not None:
        moves += np.outer(old, start[0])
    alpha /= (alpha @ one)[:, None]
    return (place, alpha), moves, alpha[: edges[1]].sum(axis=0).astype(np.float64), float(np.log(scale, dtype=np.float64).sum()), start[0] @ back


def _by_class(kinds: np.ndarray, gamma: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(kinds, gamma[:, j], size) for j in range(gamma.shape[1])], axis=1)


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(by class and state, by move, by start, log likelihood) of Baum-Welch's expectation step."""
    k = len(model.start)
    classes, counts = np.zeros((END + 1, k)), Expected(np.zeros((k, k)), np.zeros(k))
    flat = _flat(sequences)[0].astype(np.int64)
    for at, gamma in posteriors(model, sequences, counts):
        classes += _by_class(flat[at], gamma, END + 1)
    return classes, counts.moves, counts.starts, counts.loglik


def _counts(rows: DataFrame) -> DataFrame:
    """(h, kind, c): how often each token occurs in training texts; kind: the class of the word were it rare."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        size = ends = 0

        def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word = np.concatenate([kept[0], *[h[0] for h in held]])
            tail = np.concatenate([kept[1], *[h[1] for h in held]])
            weight = np.concatenate((kept[2], np.ones(len(word) - len(kept[2]), np.int64)))
            both, first, which = np.unique(word, return_index=True, return_inverse=True)
            return both, tail[first], np.bincount(which, weight, len(both)).astype(np.int64)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kept[0].view(np.int64)), pa.array(rare_class(kept[1])), pa.array(kept[2])], names=["h", "kind", "c"])

        for batch in batches:
            ends += batch.num_rows
            for group in _words.words_of(batch.column("t"), tails=True):
                held.append((group.hashes, group.tails))
                size += len(group.hashes)
                if size >= 1 << 20:
                    kept = fold()
                    held, size = [], 0
                    if len(kept[0]) >= 1 << 20:
                        yield packed()
                        kept = tuple(x[:0] for x in kept)
        kept = fold()
        yield packed()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(_END_HASH)]), pa.array([RARE]), pa.array([ends])], names=["h", "kind", "c"])

    counted = rows.where("not held").select("t").mapInArrow(lean(work), "h long, kind long, c long")
    return counted.groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


def _class_mass(counts: DataFrame, frequent: Frequent) -> np.ndarray:
    """Mass of each class: its words' counts and one more for each; in the rare ones, one for words never seen."""
    rows = counts.groupBy("kind").agg(F.sum("c"), F.count(F.lit(1))).collect()
    mass = np.zeros(END + 1)
    mass[: len(frequent.counts)] = frequent.counts + 1
    for kind, c, n in rows:
        mass[FREQUENT + kind] += c + n
    # Frequent words are classes of their own, so their kinds do without them.
    np.subtract.at(mass, FREQUENT + frequent.kinds, frequent.counts + 1)
    mass[FREQUENT:END] = np.maximum(mass[FREQUENT:END], 0) + 1
    mass[END] = max(mass[END], 1)
    return mass


def _chunks(rows: DataFrame, frequent: Frequent) -> DataFrame:
    """(chunk, held_out, tokens, packed rows): many texts each, as classes of 16 bits, with the hashes of words that aren't frequent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = int.from_bytes(os.urandom(8), "little") >> 2
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(kind: bool) -> pa.RecordBatch:
            nonlocal number
            rows_, held[kind], size[kind] = held[kind], [], 0
            number += 1
            keys = np.array([0 if r[0] is None else r[0] for r in rows_], np.int64)
            null = np.array([r[0] is None for r in rows_], np.uint8)
            lengths = np.array([len(r[1]) for r in rows_], np.uint32)
            classes = np.concatenate([r[1] for r in rows_])
            words, which = np.unique(np.concatenate([r[2] for r in rows_]), return_inverse=True)
            blob = _blobs.squeeze(_blobs.pack(keys, null, lengths, classes.astype(np.uint16), words, _blobs.small(which)), 3)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([kind]), pa.array([len(classes)]), pa.array([blob], pa.binary())], names=["g", "held", "n", "b"])

        for batch in batches:
            keys, outs = batch.column("k").to_pylist(), batch.column("held").to_pylist()
            for group in _words.words_of(batch.column("t"), tails=True):
                classes, hit = frequent.classes(group.hashes, group.tails)
                for i, (a, b) in enumerate(zip(group.edges[:-1].tolist(), group.edges[1:].tolist(), strict=True), group.first):
                    held[outs[i]].append((keys[i], np.append(classes[a:b], np.uint16(END)), group.hashes[a:b][~hit[a:b]]))
                    size[outs[i]] += b - a + 1
                for kind in (False, True):
                    if size[kind] >= HELD:
                        yield flush(kind)
        for kind in (False, True):
            if held[kind]:
                yield flush(kind)

    return rows.mapInArrow(lean(work), "g long, held boolean, n long, b binary")


def _texts(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(sequences of classes, all classes one after the other, the other packed columns)."""
    keys, null, lengths, classes, words, which = _blobs.unpack(_blobs.unsqueeze(blob))
    ends = np.cumsum(lengths.astype(np.int64))
    flat = classes.astype(np.int64)
    return [flat[b - int(n) : b] for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)], flat, [keys, null, lengths, words, which.astype(np.int64)]


class Filter:
    """Slots that some words fall into, of bounded number; words that share one by chance pass, too."""

    def __init__(self, words: DataFrame):
        many = words.count()
        self.bits = min(FILTER, max(1 << 12, 1 << (16 * many).bit_length()))
        bits = self.bits

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = _slot(batch.column("h").to_numpy().view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(slot & 63)], names=["w", "s"])

        found = words.select("h").mapInArrow(lean(work), "w long, s long").groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(s as int))")).alias("b")).toArrow()
        self.map = np.zeros(bits // 64, np.int64)
        self.map[found.column("w").to_numpy()] = found.column("b").to_numpy()

    def passes(self, words: np.ndarray) -> np.ndarray:
        slot = _slot(words, self.bits)
        return (self.map[slot >> 6] >> (slot & 63)) & 1 == 1


def _slot(words: np.ndarray, bits: int) -> np.ndarray:
    return (_words.mix(words ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Packed chunks, as many at a time as a recursion holds."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for blob, n in zip(batch.column("b").to_pylist(), batch.column("n").to_pylist(), strict=True):
            held.append(blob)
            size += n
            if size >= WAVE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _round(chunks: DataFrame, model: Model, words: int | None = None, own: Filter | None = None) -> DataFrame:
    """One expectation step over all training texts: rows (k, s0, ...) of sums by class, and below 0 moves, starts and the log likelihood.

    With ``words``, also rows (k, b) of packed sums by word, for words that pass ``own``, in so many buckets k.
    """
    k = len(model.start)
    columns = [f"s{j}" for j in range(k)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, counts = np.zeros((END + 1, k)), Expected(np.zeros((k, k)), np.zeros(k))
        held = (np.zeros(0, np.uint64), np.zeros((0, k), np.float32))

        def sums() -> pa.RecordBatch:
            order, parts = _blobs.by_bucket(_bucket(held[0], words))
            rows = [(g, _blobs.pack(held[0][order[a:b]], held[1][order[a:b]].ravel())) for g, a, b in parts]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), *[pa.nulls(len(rows), pa.float64())] * k], names=["k", "b", *columns])

        for blobs in _together(batches):
            parts = [_texts(b) for b in blobs]
            sequences = [s for p in parts for s in p[0]]
            flat = np.concatenate([p[1] for p in parts])
            if words:
                # Tokens that aren't frequent words, and which of these chunks' words they are; -1 where it isn't counted.
                names, which = np.unique(np.concatenate([p[2][3] for p in parts]), return_inverse=True)
                base = np.cumsum([0, *[len(p[2][3]) for p in parts]])
                rare = np.full(len(flat), -1)
                rare[(flat >= FREQUENT) & (flat < END)] = np.concatenate([which[base[i] + p[2][4]] for i, p in enumerate(parts)])
                counted = own.passes(names)
                number = np.where(counted, np.cumsum(counted) - 1, -1)
                rare[rare >= 0] = number[rare[rare >= 0]]
                names = names[counted]
                total = np.zeros((len(names), k))
            for at, gamma in posteriors(model, sequences, counts):
                classes += _by_class(flat[at], gamma, END + 1)
                if words and len(names):
                    some = rare[at]
                    hit = some >= 0
                    total += _by_class(some[hit], gamma[hit], len(names))
            if words and len(names):
                both, which = np.unique(np.concatenate((held[0], names)), return_inverse=True)
                held = both, _by_class(which, np.concatenate((held[1], total.astype(np.float32))), len(both)).astype(np.float32)
                if len(both) >= TASK_WORDS:
                    yield sums()
                    held = (np.zeros(0, np.uint64), np.zeros((0, k), np.float32))
        if words:
            yield sums()
        live = np.flatnonzero(classes.any(axis=1))
        number = np.concatenate((live, np.arange(-k, 0), [-k - 1, -k - 2]))
        values = np.concatenate((classes[live], counts.moves, counts.starts[None], np.full((1, k), counts.loglik)))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.nulls(len(number), pa.binary()), *[pa.array(values[:, j]) for j in range(k)]], names=["k", "b", *columns])

    return chunks.where("not held").select("n", "b").mapInArrow(lean(work), "k long, b binary, " + ", ".join(f"{c} double" for c in columns))


def _summed(step: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The sums of all parts; what reaches the driver is of the model's size."""
    summed = step.where("b is null").groupBy("k").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()
    number = summed.column("k").to_numpy()
    values = np.column_stack([summed.column(f"s{j}").to_numpy() for j in range(k)])
    classes = np.zeros((END + 1, k))
    classes[number[number >= 0]] = values[number >= 0]
    special = {int(n): v for n, v in zip(number[number < 0], values[number < 0], strict=True)}
    none = np.zeros(k)
    return classes, np.array([special.get(j - k, none) for j in range(k)]), special.get(-k - 1, none), float(special.get(-k - 2, none)[0])


def first_model(mass: np.ndarray, settings: Settings) -> Model:
    k, share = settings.states, mass / mass.sum()
    rng = np.random.Generator(np.random.PCG64(settings.seed))
    emit = share[:, None] * rng.gamma(2.0, 0.5, (len(share), k))
    model = Model(np.full(k, 1 / k), np.full((k, k), (1 - settings.stay) / max(1, k - 1)), emit / emit.sum(axis=0))
    np.fill_diagonal(model.move, settings.stay if k > 1 else 1.0)
    return model


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray, float], mass: np.ndarray, settings: Settings) -> Model:
    """The maximisation step."""
    classes, moves, starts, _ = counts
    emit = classes + settings.prior * classes.sum(axis=0) * (mass / mass.sum())[:, None]
    moves, starts = moves + 1.0, starts + 1.0
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(chunks: DataFrame, mass: np.ndarray, settings: Settings, tokens: int, words: int, own: Filter, work: Workspace) -> tuple[Model, np.ndarray | None, DataFrame | None, list[float]]:
    """(model, its last counts by class, table (k, b) of counts by word, log likelihood by round) of Baum-Welch over all whole texts.

    The last round, the one after a round that gained too little or the one that the settings allow last, also counts words.
    """
    model, path, classes = first_model(mass, settings), [], None
    for n in range(settings.rounds):
        last = n == settings.rounds - 1 or (len(path) > 1 and path[-1] - path[-2] < settings.gain * max(tokens, 1))
        step = _round(chunks, model, words if last else None, own)
        step = work.save(step, "round") if last else step
        counts = _summed(step, settings.states)
        if not counts[0].any():
            return model, None, None, path
        work.release()
        path.append(counts[3])
        model, classes = improved(counts, mass, settings), counts[0]
        if last:
            return model, classes, step.where("b is not null").select("k", "b"), path
    return model, classes, None, path


def _bucket(words: np.ndarray, tasks: int, salt: np.ndarray | int = 0) -> np.ndarray:
    return ((_words.mix(words + np.uint64(7)) + np.uint64(salt)) % np.uint64(tasks)).astype(np.int64)


@dataclass
class Emissions:
    """Emissions of all classes, and how words that aren't frequent share theirs."""

    model: Model
    mass: np.ndarray
    #: By class and state: expected counts of all its words, and those of its words without emissions of their own.
    count: np.ndarray
    left: np.ndarray
    #: Mass of the words without emissions of their own, one for words never seen among them.
    mass_left: np.ndarray
    firm: float

    def of_words(self, kinds: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Emissions of words from their class, their count and what states emitted of them."""
        c = FREQUENT + kinds
        share = ((counts + 1) / self.mass[c])[:, None]
        return self.model.emit[c] * (sums + self.firm * share) / (self.count[c] + self.firm)

    def table(self) -> np.ndarray:
        """By class and state: of frequent words and the end, their emissions; of the others, that of a word never seen."""
        out = self.model.emit.copy()
        rare = slice(FREQUENT, END)
        part = self.left[rare] / self.mass_left[rare, None] + self.firm / self.mass[rare, None]
        out[rare] *= part / (self.count[rare] + self.firm)
        return out


def _words_table(sums: DataFrame | None, counts: DataFrame, k: int) -> DataFrame:
    """(h, kind, c, v): words that aren't frequent, with what each state emitted of them where they have emissions of their own."""

    def add(table: pa.Table) -> pa.Table:
        parts = [_blobs.unpack(b) for b in table.column("b").to_pylist()]
        words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = _by_class(which, np.concatenate([p[1].reshape(-1, k) for p in parts]), len(words)).astype(np.float32)
        return pa.table({"h": pa.array(words.view(np.int64)), "v": pa.array([v.tobytes() for v in total], pa.binary())})

    if sums is None:
        return counts.withColumn("v", F.lit(None).cast("binary"))
    made = sums.groupBy("k").applyInArrow(lean_group(add), "h long, v binary")
    return counts.join(made, "h", "left").select("h", "kind", "c", F.when(F.col("c") >= LEAST, F.col("v")).alias("v"))


def _emissions(words: DataFrame, model: Model, mass: np.ndarray, classes: np.ndarray | None, settings: Settings) -> Emissions:
    """What words without emissions of their own have of each class, from sums by class over the table of words."""
    k = settings.states

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = np.zeros((RARE, k)), np.zeros(RARE)
        for batch in batches:
            kind, c = batch.column("kind").to_numpy(), batch.column("c").to_numpy()
            has = np.asarray(batch.column("v").is_valid())
            weight += np.bincount(kind[has], c[has] + 1.0, RARE)
            own += _by_class(kind[has], np.frombuffer(b"".join(batch.column("v").filter(pa.array(has)).to_pylist()), np.float32).reshape(-1, k), RARE)
        live = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(weight[live]), *[pa.array(own[live, j]) for j in range(k)]], names=["kind", "w", *[f"s{j}" for j in range(k)]])

    names = ["w", *[f"s{j}" for j in range(k)]]
    part = words.where("kind < " + str(RARE)).select("kind", "c", "v").mapInArrow(lean(work), "kind long, " + ", ".join(f"{n} double" for n in names))
    found = part.groupBy("kind").agg(*[F.sum(n).alias(n) for n in names]).collect()
    count = np.zeros_like(model.emit) if classes is None else classes
    left, mass_left = count.copy(), mass.copy()
    for r in found:
        left[FREQUENT + r["kind"]] -= np.array([r[n] for n in names[1:]])
        mass_left[FREQUENT + r["kind"]] -= r["w"]
    return Emissions(model, mass, count, np.maximum(left, 0), np.maximum(mass_left, 1), settings.firm)


def _answers(chunks: DataFrame, words: DataFrame, emissions: Emissions, tasks: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(chunk, packed numbers of words with their counts and emissions): what each chunk's words that aren't frequent are.

    A word that more chunks ask for than one task should hold goes to several tasks, and chunks are dealt among them.
    """
    k = emissions.model.emit.shape[1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, blob in zip(batch.column("g").to_pylist(), batch.column("b").to_pylist(), strict=True):
                names = _blobs.unpack(_blobs.unsqueeze(blob))[4]
                salt = np.zeros(len(names), np.uint64)
                if len(hot[0]):
                    at = np.minimum(np.searchsorted(hot[0], names), len(hot[0]) - 1)
                    salt = np.where(hot[0][at] == names, np.uint64(g) % hot[1][at], np.uint64(0))
                order, parts = _blobs.by_bucket(_bucket(names, tasks, salt))
                made = [(b, _blobs.pack(np.array([g]), names[order[x:y]], _blobs.small(order[x:y]))) for b, x, y in parts]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["q", "b"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("h").to_numpy().view(np.uint64)
            times = np.ones(len(names), np.int64)
            if len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], names), len(hot[0]) - 1)
                times = np.where(hot[0][at] == names, hot[1][at], np.uint64(1)).astype(np.int64)
            each = np.repeat(np.arange(len(names)), times)
            salt = (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(names[each], tasks, salt)), *[batch.column(c).take(pa.array(each)) for c in ("h", "kind", "c", "v")]], names=["q", "h", "kind", "c", "v"])

    def meet(asked: pa.Table, table: pa.Table) -> pa.Table:
        made: list[tuple[int, bytes]] = []
        if len(asked) and len(table):
            h = table.column("h").to_numpy().view(np.uint64)
            order = np.argsort(h)
            h, c, kind = h[order], table.column("c").to_numpy()[order], table.column("kind").to_numpy()[order]
            v = table.column("v").combine_chunks().take(pa.array(order))
            has = np.asarray(v.is_valid())
            own = np.zeros((len(h), k), np.float32)
            own[has] = emissions.of_words(kind[has], c[has], np.frombuffer(b"".join(v.filter(pa.array(has)).to_pylist()), np.float32).reshape(-1, k).astype(np.float64))
            for blob in asked.column("b").to_pylist():
                g, names, number = _blobs.unpack(blob)
                at = np.minimum(np.searchsorted(h, names), len(h) - 1)
                hit = h[at] == names
                at = at[hit]
                if len(at):
                    made.append((int(g[0]), _blobs.squeeze(_blobs.pack(number[hit], _blobs.small(c[at]), has[at].astype(np.uint8), own[at][has[at]].ravel()))))
        return pa.table({"g": pa.array([m[0] for m in made], pa.int64()), "b": pa.array([m[1] for m in made], pa.binary())})

    left = chunks.select("g", "b").mapInArrow(lean(ask), "q long, b binary").groupBy("q")
    right = words.select("h", "kind", "c", "v").mapInArrow(lean(place), "q long, h long, kind long, c long, v binary").groupBy("q")
    return left.cogroup(right).applyInArrow(lean_cogroup(meet), "g long, b binary")


def _score(chunks: DataFrame, answers: DataFrame, emissions: Emissions, frequent: Frequent, ends: int) -> DataFrame:
    """(k, held, n, known, logs, score) of every text: ``logs`` sums log10 of counts plus one."""
    k = emissions.model.emit.shape[1]

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("k", "held", "n", "known", "logs", "score")}
        # Answers are by the words' numbers in the one chunk that a group has.
        told = [_blobs.unpack(_blobs.unsqueeze(b)) for b in found.column("b").to_pylist()]
        number, c, has, own = (np.concatenate([t[i] for t in told]) if told else np.zeros(0, d) for i, d in enumerate((np.int64, np.int64, np.uint8, np.float32)))
        number, c = number.astype(np.int64), c.astype(np.int64)
        place = np.where(has == 1, np.cumsum(has.astype(np.int64)) - 1, -1)
        table = np.concatenate((emissions.table(), own.reshape(-1, k).astype(np.float64)))
        log_count = np.log10(np.append(np.append(frequent.counts, np.zeros(END - len(frequent.counts))), ends) + 1.0)
        for blob, held in zip(rows.column("b").to_pylist(), rows.column("held").to_pylist(), strict=True):
            _, flat, (keys, null, lengths, names, which) = _texts(blob)
            lengths = lengths.astype(np.int64)
            text = np.repeat(np.arange(len(lengths)), lengths)
            count, at = np.zeros(len(names), np.int64), np.full(len(names), -1)
            count[number], at[number] = c, place
            rare = np.flatnonzero((flat >= FREQUENT) & (flat < END))
            known = np.bincount(text[(flat < FREQUENT) | ((flat == END) & (ends > 0))], minlength=len(lengths)) + np.bincount(text[rare], count[which] > 0, len(lengths)).astype(np.int64)
            more = np.log10(count + 1.0)
            logs = np.bincount(text, log_count[flat], len(lengths)) + np.bincount(text[rare], more[which], len(lengths))
            # Words without emissions of their own have a word's never seen, times their count plus one.
            score = np.bincount(text[rare], np.where(at < 0, more, 0.0)[which], len(lengths))
            emitted = flat.copy()
            emitted[rare] = np.where(at[which] >= 0, END + 1 + at[which], flat[rare])
            edge = np.cumsum(lengths)
            score = score + forward(emissions.model, [emitted[b - n : b] for n, b in zip(lengths.tolist(), edge.tolist(), strict=True)], table) / np.log(10.0)
            out["k"] += [None if z else x for x, z in zip(keys.tolist(), null.tolist(), strict=True)]
            out["held"] += [held] * len(keys)
            for name, values in (("n", lengths), ("known", known), ("logs", logs), ("score", score)):
                out[name] += values.tolist()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    left, right = chunks.select("g", "held", "b").groupBy("g"), answers.groupBy("g")
    return left.cogroup(right).applyInArrow(lean_cogroup(work), "k long, held boolean, n long, known long, logs double, score double")


def _without(words: DataFrame, frequent: Frequent) -> DataFrame:
    """The table of words without the frequent ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~frequent.find(batch.column("h").to_numpy().view(np.uint64))[1]))

    return words.mapInArrow(lean(work), words.schema)


@dataclass
class Fitted:
    """A trained model with the chunks of all texts and the table of words that aren't frequent."""

    total: int
    vocabulary: int
    ends: int
    frequent: Frequent
    emissions: Emissions
    words: DataFrame
    chunks: DataFrame
    path: list[float]
    tasks: int


def fit(rows: DataFrame, settings: Settings, work: Workspace) -> Fitted:
    """Counts words and trains on rows (k, t, held) that aren't held out."""
    counts = work.save(_counts(rows), "counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where((F.col("c") >= LEAST) & (F.col("h") != int(_END_HASH))).orderBy(F.desc("c"), "h").limit(min(settings.frequent, FREQUENT)).toArrow()
    frequent = Frequent(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), top.column("kind").to_numpy())
    mass = _class_mass(counts, frequent)
    chunks = work.save(_chunks(rows, frequent), "chunks")
    work.release()
    tasks = max(shuffle_width(rows.sparkSession), -(-(total - int(frequent.counts.sum())) // TASK_WORDS))
    others = _without(counts.where(F.col("h") != int(_END_HASH)), frequent)
    own = Filter(others.where(F.col("c") >= LEAST))
    model, classes, sums, path = train(chunks, mass, settings, total, tasks, own, work)
    words = work.save(_words_table(sums, others, settings.states), "words")
    ends = counts.where(F.col("h") == int(_END_HASH)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    del sums, others, counts
    work.drop("round")
    work.drop("counts")
    work.release()
    return Fitted(total, vocabulary, ends, frequent, _emissions(words, model, mass, classes, settings), words, chunks, path, tasks)


def _hot(fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """(words that more chunks ask for than one task should hold, to how many tasks each goes); at most one for each TASK_WORDS tokens."""
    many = fitted.chunks.count()
    if many <= TASK_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    found = fitted.words.where(F.col("c") > TASK_WORDS).select("h", "c").toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), np.minimum(found.column("c").to_numpy(), many)
    order = np.argsort(h)
    return h[order], (-(-c[order] // TASK_WORDS)).astype(np.uint64)


def score_texts(df: DataFrame, held_out: Column, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens are the words of the whole text, A-Z in lower case, and one end. The
    model learns from rows that aren't held out. ``base_score`` is the log10
    probability under counts plus one, ``score`` that under the model. Null
    and empty texts have the end as their only token. A null ``held_out`` counts as false.
    Very long texts are learned from and scored whole. Rows that repeat are scored each, and
    rows that tie, equal texts, have equal scores; an empty table stays empty. Without
    training rows all words are unknown. Other columns aren't read, whatever
    their names. The key must be an integer.
    """
    settings = settings or Settings()
    work = Workspace(df.sparkSession, "hmm")
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))
    fitted = fit(rows, settings, work)
    answers = _answers(fitted.chunks, fitted.words, fitted.emissions, fitted.tasks, _hot(fitted))
    scored = _score(fitted.chunks, answers, fitted.emissions, fitted.frequent, fitted.ends)
    return scored.select(
        F.col("k").cast(df.schema[key].dataType).alias(key),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(fitted.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * float(np.log10(fitted.total + fitted.vocabulary + 1))).alias("base_score"),
        F.col("score").alias("score"),
    )
