"""Substring deduplication by prefix-partitioned suffix trees.

A suffix starts at every word that has at least ``size`` words from there to
the end of its text; its first ``size`` words are its window. Suffixes that no
other document can share are left out first: labels, hashes of windows, meet in
groups, and only suffixes whose label two documents have go on.

Those are dealt out by their prefixes, of 1, 2, 4, 8 or ``size`` words, to
groups that fit a task's memory: counts of the prefixes over the whole corpus
settle how long a suffix's prefix must be, the shortest one that isn't too
frequent. So frequent openings are split by longer prefixes, rare ones aren't.
Each group sorts its suffixes by their words, themselves and not hashes, and
reads the subtree's nodes off the common-prefix lengths. A node ``size`` words deep
is a repeat; every suffix below it that isn't in the node's least document has its
window removed. Longer repeats are runs of such nodes.

A window too frequent for a group can't be split by a prefix. Such windows are
known exactly, by a second count of their labels; their suffixes carry their
words to an aggregation that gives the least document of each window, and a join gives
it back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm import _blobs, _words
from taskloom.llm._memory import lean, lean_cogroup, lean_group
from taskloom.llm._store import Workspace, shuffle_width
from taskloom.llm.subtrees import Subtree

#: Labels that a task holds on average, suffixes of a group of subtrees, and bytes of text that are cut together.
GROUP_SUFFIXES, TREE_SUFFIXES, GROUP_BYTES = 1 << 19, 1 << 19, 16 << 20
#: Suffixes of one window beyond which it is resolved by aggregation; suffixes that a task holds before it sends them.
HEAVY, HELD = 1 << 22, 1 << 19
#: Slots of a table of prefix counts, at least and at most.
_SLOTS, _MOST_SLOTS = 1 << 16, 1 << 22
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _starts(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into a group's words, text, position in the text) of every suffix."""
    n = np.maximum(np.diff(edges) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    position = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return edges[:-1][text] + position, text, position


def _valid(batch: pa.RecordBatch, key: str, text: str) -> tuple[np.ndarray, pa.Array]:
    batch = batch.filter(pc.is_valid(batch.column(key)))
    return batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(text)


def _slots(expected: int) -> int:
    """Slots enough that few of them hold more than a heavy window's suffixes by chance; of bounded number."""
    return min(_MOST_SLOTS, max(_SLOTS, 1 << (8 * expected // HEAVY).bit_length()))


def _cap(expected: int, slots: int) -> int:
    """Suffixes of a prefix's slot beyond which the prefix is split: a part of a group, and well over what slots hold by chance."""
    return max(64, TREE_SUFFIXES // 4, 4 * expected // slots)


def _levels(size: int, expected: int, slots: int) -> list[int]:
    """Prefix lengths; where slots can't tell frequent prefixes from others, only the whole window."""
    return [*[p for p in (1, 2, 4, 8) if p < size and _cap(expected, slots) <= HEAVY], size]


def _prefix_counts(df: DataFrame, key: str, text: str, levels: list[int], slots: int) -> DataFrame:
    """(level, slot, n): suffixes by the hash slot of their prefix, for each prefix length."""
    size = levels[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(levels), slots), np.int64)
        for batch in batches:
            for group in _words.words_of(_valid(batch, key, text)[1], lower=False):
                at = _starts(group.edges, size)[0]
                for k, p in enumerate(levels):
                    slot = _words.windows(group.hashes, p)[at] % np.uint64(slots)
                    held[k] += np.bincount(slot.astype(np.int64), minlength=slots)
        for k in range(len(levels)):
            slot = np.flatnonzero(held[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), k, np.int64)), pa.array(slot), pa.array(held[k, slot])], names=["level", "slot", "n"])

    counted = df.select(key, text).mapInArrow(lean(count), "level long, slot long, n long")
    return counted.groupBy("level", "slot").agg(F.sum("n").alias("n"))


def _heavy_labels(df: DataFrame, key: str, text: str, size: int, slots: int, counts: DataFrame, last: int) -> np.ndarray:
    """The labels of more than HEAVY suffixes, counted exactly; at most one for each HEAVY suffixes of the corpus."""
    full = [r[0] for r in counts.where((F.col("level") == last) & (F.col("n") > HEAVY)).select("slot").collect()]
    if not full:
        return np.zeros(0, np.uint64)
    suspect = np.zeros(slots, bool)
    suspect[full] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size_ = 0

        def flush() -> pa.RecordBatch:
            label, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(label.view(np.int64)), pa.array(n)], names=["label", "n"])

        for batch in batches:
            for group in _words.words_of(_valid(batch, key, text)[1], lower=False):
                label = _words.windows(group.hashes, size)[_starts(group.edges, size)[0]]
                held.append(label[suspect[(label % np.uint64(slots)).astype(np.int64)]])
                size_ += len(held[-1])
                if size_ >= 4 * HELD:
                    yield flush()
                    held, size_ = [], 0
        yield flush()

    counted = df.select(key, text).mapInArrow(lean(count), "label long, n long").groupBy("label").agg(F.sum("n").alias("n"))
    found = np.array([r[0] for r in counted.where(F.col("n") > HEAVY).select("label").collect()], np.int64)
    return np.sort(found.view(np.uint64))


def _among(labels: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which labels are among some sorted ones."""
    if not len(some):
        return np.zeros(len(labels), bool)
    return some[np.minimum(np.searchsorted(some, labels), len(some) - 1)] == labels


class _Plan:
    """Which group of subtrees a suffix belongs to, by its shortest prefix that isn't split; of bounded size, whatever the input."""

    def __init__(self, levels: list[int], slots: int, split: list[tuple[int, int]], heavy: np.ndarray):
        self.levels, self.slots, self.heavy = levels, slots, heavy
        self.split = np.zeros((len(levels), slots), bool)
        for level, slot in split:
            self.split[level, slot] = True
        self.split[-1] = False

    def names(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for the prefix of each suffix; suffixes with the same window have the same one."""
        open_ = np.arange(len(at))
        name = np.zeros(len(at), np.uint64)
        for k, p in enumerate(self.levels):
            label = _words.windows(hashes, p)[at[open_]]
            name[open_] = _words.mix(label + np.uint64(k + 1))
            open_ = open_[self.split[k, (label % np.uint64(self.slots)).astype(np.int64)]]
            if not len(open_):
                break
        return name


def _in_order(doc: np.ndarray, position: np.ndarray) -> np.ndarray | None:
    """The order by document and position, or None if it is that already."""
    change = np.diff(doc)
    if (change < 0).any() or (np.diff(position)[change == 0] < 0).any():
        return np.lexsort((position, doc))
    return None


def _places(doc: np.ndarray, position: np.ndarray) -> list[np.ndarray]:
    """Columns for places in order: documents as runs, positions as steps, high bytes apart."""
    ids, counts = _blobs.runs(doc)
    step = np.diff(position, prepend=0)
    if len(position):
        first = np.cumsum(counts) - counts
        step[first] = position[first]
    return [ids[:1], _blobs.small(np.diff(ids)), _blobs.small(counts), (step & 255).astype(np.uint8), _blobs.small(step >> 8)]


def _unplaced(first: np.ndarray, gaps: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, positions)."""
    counts = counts.astype(np.int64)
    ids = np.cumsum(np.concatenate((first, gaps.astype(np.int64))))
    step = low.astype(np.int64) | high.astype(np.int64) << 8
    position = np.cumsum(step)
    begin = np.cumsum(counts) - counts
    return np.repeat(ids, counts), position - np.repeat(position[begin] - step[begin], counts)


def _send(groups: int, label: np.ndarray, doc: np.ndarray, position: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, packed labels and places): the high half of a label tells the group, the low half is kept."""
    order = _in_order(doc, position)
    if order is not None:
        label, doc, position = label[order], doc[order], position[order]
    order, parts = _blobs.by_bucket(((label >> np.uint64(32)) % np.uint64(groups)).astype(np.int64))
    for g, a, b in parts:
        own = order[a:b]
        yield g, _blobs.pack(label[own].astype(np.uint32), *_places(doc[own], position[own]))


def _table(rows: list[tuple[int, bytes]], names: tuple[str, str] = ("g", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=list(names))


def _labels(df: DataFrame, key: str, text: str, size: int, groups: int, heavy: np.ndarray) -> DataFrame:
    """(group, packed labels) of all suffixes but those of heavy windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            return _table(list(_send(groups, *[np.concatenate(c) for c in zip(*held, strict=True)])) if held else [])

        for batch in batches:
            docs, texts = _valid(batch, key, text)
            for group in _words.words_of(texts, lower=False):
                at, of, position = _starts(group.edges, size)
                label = _words.windows(group.hashes, size)[at]
                light = ~_among(label, heavy)
                if not light.any():
                    continue
                held.append((label[light], docs[group.first + of[light]], position[light]))
                count += len(held[-1][0])
                if count >= HELD:
                    yield flush()
                    held, count = [], 0
        yield flush()

    return df.select(key, text).mapInArrow(lean(emit), "g long, b binary")


def _by_document(doc: np.ndarray, position: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket of documents, packed places)."""
    order = _in_order(doc, position)
    if order is not None:
        doc, position = doc[order], position[order]
    order, ends = _blobs.by_bucket(np.mod(doc, buckets))
    return [(g, _blobs.pack(*_places(doc[order[a:b]], position[order[a:b]]))) for g, a, b in ends]


def _shared(parts: DataFrame, buckets: int) -> DataFrame:
    """(bucket of documents, packed places, how many) of suffixes whose label another document has as well."""

    def meet(table: pa.Table) -> pa.Table:
        blobs = [_blobs.unpack(b) for b in table.column("b").to_pylist()]
        label = np.concatenate([b[0] for b in blobs])
        places = [_unplaced(*b[1:]) for b in blobs]
        doc, position = (np.concatenate(c) for c in zip(*places, strict=True))
        order = np.argsort(label)
        sorted_, by = label[order], doc[order]
        run = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        several = np.minimum.reduceat(by, run) < np.maximum.reduceat(by, run)
        hit = order[np.repeat(several, np.diff(np.append(run, len(order))))]
        rows = _by_document(doc[hit], position[hit], buckets)
        return pa.table({"r": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([len(_blobs.unpack(r[1])[3]) for r in rows], pa.int64())})

    return parts.groupBy("g").applyInArrow(lean_group(meet), "r long, b binary, n long")


def _marks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(documents, positions) of packed places, in order of documents."""
    places = [_unplaced(*_blobs.unpack(b)) for b in table.column("b").to_pylist()]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, position = (np.concatenate(c) for c in zip(*places, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], position[order]


def _spelled(plan: _Plan, groups: int, spans: _words.Spans, at: np.ndarray, doc: np.ndarray, position: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, packed suffixes with their words): a group's own words once, and their numbers by suffix."""
    size = plan.levels[-1]
    used = np.zeros(len(spans.starts) + 1, np.int64)
    np.add.at(used, at, 1)
    np.add.at(used, at + size, -1)
    used = np.flatnonzero(np.cumsum(used[:-1]))
    first, which = _words.distinct(spans.raw, spans.starts[used], spans.ends[used])
    number = np.zeros(len(spans.starts), np.int32)
    number[used] = which
    spelling = _words.cut_out(spans.raw, spans.starts[used[first]], spans.ends[used[first]])
    order, parts = _blobs.by_bucket((plan.names(spans.hashes, at) % np.uint64(groups)).astype(np.int64))
    for g, a, b in parts:
        own = order[a:b]
        rows = number[at[own][:, None] + np.arange(size)]
        local, rows, times = np.unique(rows, return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which compress better.
        rank = np.argsort(-times, kind="stable")
        number_of = np.empty(len(rank), np.int64)
        number_of[rank] = np.arange(len(rank))
        local, rows = local[rank], number_of[rows]
        words = spelling.take(pa.array(local))
        raw, edges = _words.buffers(words)
        yield g, _blobs.squeeze(_blobs.pack(raw, _blobs.small(np.diff(edges)), _blobs.small(rows.ravel()), *_places(doc[own], position[own])), 3)


def _suffixes(shared: DataFrame, dealt: DataFrame, key: str, text: str, plan: _Plan, groups: int) -> DataFrame:
    """(group of subtrees, packed suffixes) of the places, with the texts of their documents."""
    size = plan.levels[-1]

    def spell(marks: pa.Table, rows: pa.Table) -> pa.Table:
        doc, position = _marks(marks)
        out: list[tuple[int, bytes]] = []
        rows = rows.filter(pc.is_in(rows.column(key).cast(pa.int64()), pa.array(np.unique(doc)))).combine_chunks()
        if len(rows):
            keys, texts = rows.column(key).to_numpy().astype(np.int64), rows.column(text).combine_chunks()
            for spans in _words.spans_of(texts, together=2 * GROUP_BYTES):
                at, own, place = [], [], []
                for i, (a, b) in enumerate(zip(spans.edges[:-1].tolist(), spans.edges[1:].tolist(), strict=True), spans.first):
                    x, y = np.searchsorted(doc, [keys[i], keys[i] + 1])
                    # A row of a key that repeats may be shorter than another one.
                    here = position[x:y]
                    here = np.sort(here[here + size <= b - a])
                    at.append(a + here)
                    own.append(np.full(len(here), keys[i]))
                    place.append(here)
                at, own, place = np.concatenate(at), np.concatenate(own), np.concatenate(place)
                order = _in_order(own, place)
                if order is not None:
                    at, own, place = at[order], own[order], place[order]
                if len(at):
                    out += _spelled(plan, groups, spans, at, own, place)
        return pa.Table.from_batches([_table(out)])

    return shared.groupBy("r").cogroup(dealt.groupBy("__r")).applyInArrow(lean_cogroup(spell), "g long, b binary")


def _numbered(blobs: list[list[np.ndarray]], size: int) -> np.ndarray:
    """Rows of word numbers of packed suffixes, over one list of the words of all."""
    words = []
    for raw, lengths, *_ in blobs:
        edges = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
        words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))]))
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
    base = np.cumsum([0, *[len(w) for w in words]])
    return np.concatenate([codes[base[i] + b[2].astype(np.int64)].reshape(-1, size) for i, b in enumerate(blobs)])


def _repeats(parts: DataFrame, size: int, buckets: int) -> DataFrame:
    """(bucket of documents, packed places) of suffixes whose window a smaller document has as well."""

    def tree(table: pa.Table) -> pa.Table:
        blobs = [_blobs.unpack(_blobs.unsqueeze(b)) for b in table.column("b").to_pylist()]
        doc, position = (np.concatenate(c) for c in zip(*[_unplaced(*b[3:]) for b in blobs], strict=True))
        grown = Subtree(_numbered(blobs, size))
        by = doc[grown.order]
        rows: list[tuple[int, bytes]] = []
        starts, ends = grown.deep(size)
        if len(starts):
            # Nodes that follow each other take turns with what lies between them.
            least = np.minimum.reduceat(by, np.stack((starts, np.minimum(ends, len(by) - 1)), axis=1).ravel())[::2]
            least = np.minimum(least, by[ends - 1])
            node = np.concatenate([np.zeros(0, np.int64), np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts)]) + np.arange(int((ends - starts).sum()))
            hit = node[by[node] > np.repeat(least, ends - starts)]
            hit = grown.order[hit]
            rows = _by_document(doc[hit], position[hit], buckets)
        return pa.Table.from_batches([_table(rows, ("r", "b"))])

    return parts.groupBy("g").applyInArrow(lean_group(tree), "r long, b binary")


def _heavy_repeats(df: DataFrame, key: str, text: str, size: int, heavy: np.ndarray, buckets: int) -> DataFrame:
    """As ``_repeats``, for heavy windows: the least document of each by an aggregation over its words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = _valid(batch, key, text)
            for spans in _words.spans_of(texts):
                at, of, position = _starts(spans.edges, size)
                hit = _among(_words.windows(spans.hashes, size)[at], heavy)
                at, of, position = at[hit], of[hit], position[hit]
                # The words one by one, each with a space behind it.
                each = (at[:, None] + np.arange(size)).ravel()
                words = _words.cut_out(spans.raw, spans.starts[each], spans.ends[each])
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.arange(0, len(each) + 1, size)), words), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([joined.cast(pa.binary()), pa.array(docs[spans.first + of]), pa.array(position)], names=["w", "doc", "position"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table(_by_document(batch.column("doc").to_numpy(), batch.column("position").to_numpy(), buckets), ("r", "b"))

    rows = df.select(key, text).mapInArrow(lean(emit), "w binary, doc long, position long")
    least = rows.groupBy("w").agg(F.min("doc").alias("least"))
    return rows.join(least, "w").where("doc > least").select("doc", "position").mapInArrow(lean(pack), "r long, b binary")


def _prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words a window of size words from one of the starts covers."""
    edge = np.zeros(n + 1, np.int32)
    starts = starts[starts + size <= n]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space after them."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    out, at, k = [], 0, 0
    while k < len(spans):
        if not gone[k]:
            k += 1
            continue
        end = k
        while end < len(spans) and gone[end]:
            end += 1
        out.append(raw[at : spans[k][0]])
        at = spans[end][0] if end < len(spans) else len(raw)
        k = end
    out.append(raw[at:])
    return b"".join(out)


def _repeated_places(df: DataFrame, dealt: DataFrame, size: int, key: str, text: str, bytes_: int, buckets: int, work: Workspace) -> DataFrame:
    """(bucket of documents, packed places) of all windows that a smaller document has as well."""
    width = shuffle_width(df.sparkSession)
    expected = bytes_ // 5
    slots = _slots(expected)
    levels, cap = _levels(size, expected, slots), _cap(expected, slots)
    counts = work.save(_prefix_counts(df, key, text, levels, slots), "prefixes")
    total = counts.where(F.col("level") == 0).agg(F.sum("n")).first()[0] or 0
    heavy = _heavy_labels(df, key, text, size, slots, counts, len(levels) - 1)
    split = [tuple(r) for r in counts.where((F.col("n") > cap) & (F.col("level") < len(levels) - 1)).select("level", "slot").collect()]
    plan = _Plan(levels, slots, split, heavy)
    groups = max(width, -(-total // GROUP_SUFFIXES))
    shared = work.save(_shared(_labels(df, key, text, size, groups, heavy), buckets), "shared")
    work.release()
    found = shared.agg(F.sum("n")).first()[0] or 0
    trees = max(width, -(-found // TREE_SUFFIXES))
    suffixes = _suffixes(shared.select("r", "b"), dealt, key, text, plan, trees)
    repeats = work.save(_repeats(suffixes, size, buckets), "repeats")
    del suffixes
    work.release()
    work.drop("shared")
    return repeats.union(work.save(_heavy_repeats(df, key, text, size, heavy, buckets), "heavy")) if len(heavy) else repeats


def dedupe_substrings(df: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text", digests: bool = False, names: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Removes every word covered by a window that also starts in a document with a smaller key.

    A window is ``size`` consecutive words; windows are judged on the input and
    compared word by word. Adds ``n_words`` and ``n_removed``, or what ``names`` calls
    them. The text loses the removed words
    with the white space after them and stays as it is where none is removed; with
    ``digests`` it is replaced by ``kept_sha256``, of the kept words joined by
    one space. Null texts have no words and stay null; empty texts have none and stay empty. Very long texts
    are read whole, by the task that holds them. Rows with a null key take no
    part and stay as they are. Rows that share a key are one document, so that ties between
    them remove nothing: a
    position that goes from one of them goes from all. An empty table stays
    empty. Other columns are kept; those named as an added one are replaced.
    The key must be an integer.
    """
    work = Workspace(df.sparkSession, "substrings")
    added = [*names, *(["kept_sha256"] if digests else [])]
    kept = [c for c in df.columns if c not in added]
    bytes_ = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    buckets = _prime(max(shuffle_width(df.sparkSession), -(-bytes_ // GROUP_BYTES)))
    own = F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(buckets)), F.lit(0).cast("long")).alias("__r")
    repeats = _repeated_places(df, df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, own), size, key, text, bytes_, buckets, work)
    types = {f.name: f for f in df.schema.fields}
    new = {names[0]: T.LongType(), names[1]: T.LongType(), "kept_sha256": T.StringType()}
    outputs = [*[c for c in kept if not (digests and c == text)], *added]
    schema = T.StructType([types[c] if c in kept else T.StructField(c, new[c]) for c in outputs])

    def strip(marks: pa.Table, rows: pa.Table) -> pa.Table:
        doc, position = _marks(marks)
        made: dict[str, list] = {c: [] for c in (*added, text)}
        for k, t in zip(rows.column(key).to_pylist(), rows.column(text).to_pylist(), strict=True):
            raw = (t or "").encode()
            words = _WORD.findall(raw)
            a, b = (0, 0) if k is None else np.searchsorted(doc, [k, k + 1])
            gone = _covered(len(words), position[a:b], size) if b > a else None
            removed = int(gone.sum()) if gone is not None else 0
            made[names[0]].append(len(words))
            made[names[1]].append(removed)
            if digests:
                words = [w for w, g in zip(words, gone, strict=True) if not g] if removed else words
                made["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                made[text].append(_cut(raw, gone).decode() if removed else t)
        columns = {c: pa.array(made[c]) if c in added else pa.array(made[c], pa.string()) if c == text else rows.column(c) for c in outputs}
        return pa.table(columns)

    dealt = df.select(*[F.col(f"`{c}`") for c in kept], own)
    return repeats.groupBy("r").cogroup(dealt.groupBy("__r")).applyInArrow(lean_cogroup(strip), schema)


def repeated_spans(df: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, n_words): the stretches of words of each document that windows of smaller documents cover.

    Each is as long as it can be: windows that touch or overlap are one stretch.
    Rows are treated as by ``dedupe_substrings``; documents without repeats have no row.
    """
    work = Workspace(df.sparkSession, "spans")
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    bytes_ = rows.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    buckets = _prime(max(shuffle_width(df.sparkSession), -(-bytes_ // GROUP_BYTES)))
    dealt = rows.select(key, text, F.pmod(F.col(key).cast("long"), F.lit(buckets)).alias("__r"))
    repeats = _repeated_places(rows, dealt, size, key, text, bytes_, buckets, work)

    def runs(table: pa.Table) -> pa.Table:
        doc, position = _marks(table)
        order = np.lexsort((position, doc))
        doc, position = doc[order], position[order]
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (position[1:] > position[:-1] + size)))) if len(doc) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(doc)) - 1
        return pa.table({"k": pa.array(doc[edge]), "start": pa.array(position[edge]), "n_words": pa.array(position[last] + size - position[edge])})

    found = repeats.groupBy("r").applyInArrow(lean_group(runs), "k long, start long, n_words long")
    return found.select(F.col("k").cast(df.schema[key].dataType).alias(key), "start", "n_words")
