"""N-gram Jaccard join: every link between documents whose shingle sets are alike enough, as components.

1. One scan gives each text its set's size, fingerprint and two min-hashes, and
   a fixed-size table of how often shingles occur. Equal sets are linked by
   fingerprint with partial aggregation.
2. Distinct sets that share a min-hash meet in blocks, where signature trees
   find links. That joins dense groups without listing their pairs. Blocks over
   a task's memory are split at random, differently for each of the two.
3. What that may have missed is found exactly: with shingles ordered from rare
   to frequent, two sets alike enough share one among the first n - ceil(t n)
   + 1 of each. Only shingles that two different components have there matter.
   Pairs that share one stay candidates if their parity bitmaps differ in no
   more bits than their sets may differ in shingles. Candidates that such
   pairs join form families; the sets of a family meet once, in signature
   trees that skip pairs of one component. Families over a task's memory are
   cut into chunks that meet pairwise, and so are the rows of a shingle that
   too many sets have in their prefixes.
4. Links are counted inside the components, which hold them all: the distinct sets of a component
   meet once, as exact bitmaps over the shingles that several of them have, and
   each keeps a count of the documents it links with. No pair leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm import _blobs, _words
from taskloom.llm._graph import components
from taskloom.llm._memory import lean, lean_group
from taskloom.llm._store import Workspace, shuffle_width
from taskloom.llm.signatures import SignatureTree, stars

#: Bytes of sets that meet in one task, prefix shingles of one, slots of the table of occurrences and, at most, of filters.
BLOCK_BYTES, TASK_BYTES, TASK_PREFIXES = 8 << 20, 16 << 20, 1 << 20
COUNT_SLOTS, FILTER_SLOTS, SEGMENTS = 1 << 21, 1 << 28, 64
#: Rows of one shingle, and candidate rows, that meet in one task; pairs that are held before they become stars.
TASK_ROWS, CANDIDATE_ROWS, PAIRS = 512, 1 << 16, 1 << 20
HELD = 1 << 19
_SALT = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))
_THIN = "kind int, k long, n long, a long, b long, m1 long, m2 long, parity binary, segment int, counts binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (_words.mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set."""
    return int(_words.mix(s ^ _SALT[0]).sum().view(np.int64)), int(np.bitwise_xor.reduce(_words.mix(s * _SALT[1])).view(np.int64))


def _least(s: np.ndarray) -> tuple[int, int]:
    """Two min-hashes of a set: of the hashes themselves and of another order."""
    return int(s[0].view(np.int64)), int(_words.mix(s ^ _SALT[1]).min().view(np.int64))


def _parity(s: np.ndarray) -> bytes:
    """A bitmap in which each shingle turns one bit over: two differ in no more bits than the sets in shingles."""
    bits = 1 << min(12, max(6, int(len(s) - 1).bit_length()))
    at = (_words.mix(s ^ _SALT[0]) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sets(batches: Iterator[pa.RecordBatch], size: int, keep: Callable[[np.ndarray], np.ndarray] | None = None):
    """(key, shingle set) of rows (k, t); rows with a null key only where nothing is filtered."""
    for batch in batches:
        if keep is not None:
            batch = batch.filter(pc.is_valid(batch.column("k")))
            batch = batch.filter(pa.array(keep(batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64))))
        keys = batch.column("k").to_pylist()
        for group in _words.words_of(batch.column("t")):
            yield from zip(keys[group.first : group.first + len(group)], _words.shingle_sets(group, size), strict=True)


def _scan(rows: DataFrame, size: int) -> DataFrame:
    """Thin rows (kind 0) and the parts' tables of occurrences (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNT_SLOTS, np.uint16)
        pending: list[np.ndarray] = []
        waiting = 0

        def count() -> None:
            if pending:
                slots = (np.concatenate(pending) % np.uint64(COUNT_SLOTS)).astype(np.int64)
                np.copyto(held, np.minimum(np.bincount(slots, minlength=COUNT_SLOTS) + held, 65535).astype(np.uint16))
                pending.clear()

        out: list[tuple] = []
        for key, s in _sets(batches, size):
            if len(s):
                out.append((key, len(s), *_prints(s), *_least(s), _parity(s)))
                pending.append(s)
                waiting += len(s)
            else:
                out.append((key, 0, None, None, None, None, None))
            if waiting >= HELD * 4:
                count()
                waiting = 0
            if len(out) >= 20_000:
                yield thin(out)
                out = []
        count()
        yield thin(out)
        parts = held.reshape(SEGMENTS, -1)
        n = SEGMENTS
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * n, pa.int32()), *[pa.nulls(n, pa.int64())] * 6, pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names
        )

    names = ["kind", "k", "n", "a", "b", "m1", "m2", "parity", "segment", "counts"]

    def thin(out: list[tuple]) -> pa.RecordBatch:
        n = len(out)
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(6)]
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), *columns, pa.array([r[6] for r in out], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

    return rows.mapInArrow(lean(work), _THIN)


def _levels(scanned: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are, on a log scale from twice the mean; of fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_SLOTS // SEGMENTS, np.uint64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(blob, np.uint16 if len(blob) == 2 * len(total) else np.uint64)
        return pa.table({"segment": table.column("segment")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "segment int, counts binary"
    parts = scanned.where("kind = 1").select("segment", "counts", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("part"))
    # Many tasks' tables are added in two steps, so that none has to hold all of a segment's.
    parts = parts.groupBy("segment", "part").applyInArrow(lean_group(add), schema)
    rows = parts.groupBy("segment").applyInArrow(lean_group(add), schema).collect()
    counts = np.zeros(COUNT_SLOTS)
    for r in rows:
        part = np.frombuffer(r["counts"], np.uint64)
        counts[r["segment"] * len(part) : (r["segment"] + 1) * len(part)] = part
    return np.clip(np.log2((counts + 1) / (2 * counts.mean() + 2)), 0, 15).astype(np.uint8)


def _filter(keys: DataFrame, most: int) -> np.ndarray:
    """A bitmap that has the slots of all keys, of which there are ``most`` at most; what it lets through besides does no harm.

    It has 32 slots or more for each of them, up to FILTER_SLOTS.
    """
    slots = min(FILTER_SLOTS, max(1 << 12, 1 << (32 * most).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column("k").to_numpy(zero_copy_only=False), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(slot & 63)], names=["w", "s"])

    bits = keys.mapInArrow(lean(work), "w long, s long").groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(s as int))")).alias("b"))
    found = bits.toArrow()
    words = np.zeros(slots // 64, np.int64)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return words.view(np.uint64)


def _passes(bitmap: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    def keep(keys: np.ndarray) -> np.ndarray:
        slot = _slot(keys, 64 * len(bitmap))
        return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1

    return keep


def _prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, one of which every set alike enough shares."""
    n = len(s)
    length = n - -(-percent * n // 100) + 1
    level = levels[(s % np.uint64(COUNT_SLOTS)).astype(np.int64)]
    if level.max() == 0:
        return s[:length]
    return s[np.argsort(level, kind="stable")[:length]]


def _block_links(parts: DataFrame, percent: int) -> DataFrame:
    """(u, v): what joins all that links found by the trees of the blocks of rows (task, packed sets) join."""

    def work(table: pa.Table) -> pa.Table:
        blocks: dict[int, dict[int, tuple[np.ndarray, int]]] = {}
        for blob in table.column("b").to_pylist():
            block, keys, labels, sizes, flat = _blobs.unpack(blob)
            ends = np.cumsum(sizes.astype(np.int64))
            for i, (x, k) in enumerate(zip(block.tolist(), keys.tolist(), strict=True)):
                blocks.setdefault(x, {})[k] = (flat[ends[i] - int(sizes[i]) : ends[i]], int(labels[i]))
        u, v = [], []
        for rows in blocks.values():
            if len(rows) < 2:
                continue
            keys = list(rows)
            sets, labels = [rows[k][0] for k in keys], np.array([rows[k][1] for k in keys])
            for i, j in SignatureTree(sets, percent, labels).links():
                u.append(keys[i])
                v.append(keys[j])
        u, v = stars(np.array(u, np.int64), np.array(v, np.int64))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return parts.groupBy("g").applyInArrow(lean_group(work), "u long, v long")


def _packed(rows: list[tuple[int, int, int, np.ndarray]], tasks: int) -> pa.RecordBatch:
    """Rows (block, key, label, set) by task."""
    by: dict[int, list] = {}
    for row in rows:
        by.setdefault(int(_words.mix(np.array([row[0]], np.int64).view(np.uint64))[0]) % tasks, []).append(row)
    out = []
    for g, own in by.items():
        columns = [np.array([r[i] for r in own], np.int64) for i in range(3)]
        out.append((g, _blobs.pack(*columns, np.array([len(r[3]) for r in own], np.uint32), np.concatenate([r[3] for r in own]))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["g", "b"])


def _split_table(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    m, parts = found.column("m").to_numpy(), found.column("p").to_numpy()
    order = np.argsort(m)
    return m[order], parts[order].astype(np.uint32)


def _parts_of(table: tuple[np.ndarray, np.ndarray], m: int) -> int:
    """Into how many parts a block is split."""
    at = int(np.searchsorted(table[0], m))
    return int(table[1][at]) if at < len(table[0]) and table[0][at] == m else 1


def _near_links(rows: DataFrame, reps: DataFrame, many: int, size: int, percent: int, width: int, work: Workspace) -> DataFrame | None:
    """Step 2: links between distinct sets that share a min-hash."""
    both = reps.select("k", "n", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("m")) for j in (1, 2)])).alias("x"))
    both = both.select("k", "n", "x.j", "x.m")
    blocks = both.groupBy("j", "m").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where("c > 1")
    blocks = work.save(blocks, "blocks")
    sums = blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not sums[1]:
        return None
    bytes_ = 8 * sums[0]
    # Twelve bytes for each block that is split: at most four million of them, one for each BLOCK_BYTES.
    limit = max(BLOCK_BYTES, bytes_ >> 22)
    found = blocks.where(F.col("n") * 8 > limit).select("j", "m", F.ceil(F.col("n") * 8 / limit).alias("p")).toArrow()
    split = {j: _split_table(found.filter(pc.equal(found.column("j"), j))) for j in (1, 2)}
    tasks = max(width, -(-bytes_ // TASK_BYTES))
    live = both.join(blocks.select("j", "m"), ["j", "m"], "left_semi").select("k").distinct()
    keep = _passes(_filter(live, many))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for key, s in _sets(batches, size, keep):
            if not len(s):
                continue
            for j, m in enumerate(_least(s), 1):
                parts = _parts_of(split[j], m)
                salt = int(_words.mix(np.array([key], np.int64).view(np.uint64) ^ _SALT[j - 1])[0]) % parts
                block = int(_words.mix(np.array([m], np.int64).view(np.uint64) + np.uint64(j + 8 * salt))[0].view(np.int64))
                held.append((block, key, key, s))
                count += len(s)
            if count >= HELD:
                yield _packed(held, tasks)
                held, count = [], 0
        yield _packed(held, tasks)

    return _block_links(rows.mapInArrow(lean(emit), "g long, b binary"), percent)


def _shared_prefixes(rows: DataFrame, reps: DataFrame, many: int, levels: np.ndarray, size: int, percent: int, width: int) -> DataFrame:
    """Step 3: (shingle, k) where two distinct sets have the shingle in their prefixes."""
    keep = _passes(_filter(reps.select("k"), many))
    # A prefix holds (100 - percent) % of a set and one more.
    total = (reps.agg(F.sum("n") * (100 - percent) / 100 + 2 * F.count(F.lit(1))).first()[0]) or 0
    tasks = max(width, -(-int(total) // TASK_PREFIXES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.uint64)
            n = np.array([len(h[2]) for h in held], np.int64)
            key = np.repeat(np.array([h[0] for h in held], np.int64), n)
            print_ = np.repeat(np.array([h[1] for h in held], np.int64), n)
            order, parts = _blobs.by_bucket((_words.mix(token + np.uint64(3)) % np.uint64(tasks)).astype(np.int64))
            out = []
            for g, a, b in parts:
                own = order[a:b]
                keys, runs = _blobs.runs(key[own])
                first = np.cumsum(runs) - runs
                out.append((g, _blobs.pack(token[own], keys, print_[own][first], _blobs.small(runs))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["g", "b"])

        for key, s in _sets(batches, size, keep):
            if not len(s):
                continue
            held.append((key, _prints(s)[0], _prefix(s, levels, percent)))
            count += len(held[-1][2])
            if count >= HELD:
                yield flush()
                held, count = [], 0
        yield flush()

    def shared(table: pa.Table) -> pa.Table:
        tokens, keys, prints = [], [], []
        for blob in table.column("b").to_pylist():
            t, k, p, n = _blobs.unpack(blob)
            n = n.astype(np.int64)
            tokens.append(t)
            keys.append(np.repeat(k, n))
            prints.append(np.repeat(p, n))
        token, key, print_ = np.concatenate(tokens), np.concatenate(keys), np.concatenate(prints)
        order = np.argsort(token)
        token, key, print_ = token[order], key[order], print_[order]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        several = np.minimum.reduceat(print_, at) != np.maximum.reduceat(print_, at)
        hit = np.repeat(several, np.diff(np.append(at, len(token))))
        return pa.table({"t": pa.array(token[hit].view(np.int64)), "k": pa.array(key[hit])})

    return rows.mapInArrow(lean(emit), "g long, b binary").groupBy("g").applyInArrow(lean_group(shared), "t long, k long")


def _candidates(meets: DataFrame, total: int, percent: int, width: int, whole: bool = False) -> DataFrame:
    """(u, v): what joins the pairs of two components in ``total`` rows (t, c, k, component, n, parity) that may link; with ``whole`` the pairs themselves.

    ``c``: how many rows the shingle t has.
    """

    def folded(blobs: list[bytes], bits: np.ndarray, to: int) -> np.ndarray:
        """Bitmaps of ``to`` or twice as many bits, at ``to`` bits."""
        out = np.zeros((len(blobs), to // 64), np.uint64)
        for b in (to, 2 * to):
            at = np.flatnonzero(bits == b)
            if len(at):
                own = np.frombuffer(b"".join([blobs[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
                out[at] = own if b == to else own[:, : to // 64] ^ own[:, to // 64 :]
        return out

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("n", "ascending")])
        t, k, component, n = (table.column(c).to_numpy() for c in ("t", "k", "component", "n"))
        blobs = table.column("parity").to_pylist()
        bits = np.array([8 * len(b) for b in blobs])
        maps = {int(b): folded(blobs, bits, int(b)) for b in np.unique(bits)}
        u, v, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([np.stack((u, v), axis=1), *held])
            return tuple(np.unique(pairs, axis=0).T) if whole else stars(pairs[:, 0], pairs[:, 1])

        gap, i, waiting = 0, np.arange(len(t)), 0
        while len(i):
            gap += 1
            i = i[i + gap < len(t)]
            # Sizes ascend, so a row whose partner is too large has none further on.
            i = i[(t[i] == t[i + gap]) & (100 * n[i] >= percent * n[i + gap])]
            ok = component[i] != component[i + gap]
            a, b = i[ok], i[ok] + gap
            least = np.minimum(bits[a], bits[b])
            for w in np.unique(least).tolist():
                x, y = a[least == w], b[least == w]
                for j in range(0, len(x), 1 << 16):
                    p, q = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
                    differ = np.bitwise_count(maps[w][p] ^ maps[w][q]).sum(axis=1, dtype=np.int64)
                    near = (100 + percent) * differ <= (100 - percent) * (n[p] + n[q])
                    held.append(np.stack((np.minimum(k[p], k[q])[near], np.maximum(k[p], k[q])[near]), axis=1))
                    waiting += int(near.sum())
            if waiting >= PAIRS:
                (u, v), held, waiting = fold(), [], 0
        u, v = fold()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    # A shingle of many sets is cut into chunks, and pairs of chunks meet in tasks of their own.
    cut = meets.withColumn("parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("c") / TASK_ROWS)))
    own = F.pmod(F.xxhash64("k"), F.col("parts"))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.xxhash64("t", F.least(own, j), F.greatest(own, j)))
    rows = cut.withColumn("block", F.explode(F.when(F.col("parts") == 1, F.array(F.xxhash64("t"))).otherwise(blocks)))
    tasks = max(4 * width, -(-total // CANDIDATE_ROWS))
    dealt = rows.withColumn("g", F.pmod("block", F.lit(tasks))).select("g", F.col("block").alias("t"), "k", "component", "n", "parity")
    return dealt.groupBy("g").applyInArrow(lean_group(work), "u long, v long").distinct()


def _family_links(rows: DataFrame, reps: DataFrame, many: int, members: DataFrame, size: int, percent: int, width: int) -> DataFrame:
    """Links between components of a family, from (k, component, family)."""
    sized = members.join(reps.select("k", "n"), "k")
    weights = sized.groupBy("family", "component").agg(F.sum("n").alias("cn"))
    totals = weights.groupBy("family").agg(F.sum("cn").alias("fn"))
    cell = sized.join(weights, ["family", "component"]).join(totals, "family")
    words = BLOCK_BYTES // 8
    parts = F.greatest(F.lit(1), F.ceil(F.col("fn") / words))
    own = F.pmod(F.xxhash64("k"), F.greatest(F.lit(1), F.ceil(F.col("cn") / words)))
    cell = cell.withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("component", own), F.col("parts")))
    # Chunks of a family meet pairwise: a row goes to each pair that has its chunk.
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.xxhash64("family", F.least("c", j), F.greatest("c", j)))
    placed = cell.select("k", "component", "n", F.explode(pairs).alias("block"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    tasks = max(width, -(-8 * total // TASK_BYTES))
    keep = _passes(_filter(members.select("k"), many))

    found = _whole_sets(rows, size, keep).join(placed, "k").select("block", "k", "component", "s")
    return _block_links(found.mapInArrow(lean(_packer(tasks)), "g long, b binary"), percent)


def _whole_sets(rows: DataFrame, size: int, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(k, a, b, n, s) of rows whose key passes the filter: fingerprints, size and the set itself."""
    names = ["k", "a", "b", "n", "s"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for k, s in _sets(batches, size, keep):
            if len(s):
                held.append((k, *_prints(s), len(s), s.tobytes()))
                count += len(s)
            if count >= HELD:
                yield batch_of(held)
                held, count = [], 0
        yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.binary() if i == 4 else pa.int64()) for i in range(5)], names=names)

    return rows.mapInArrow(lean(sets), "k long, a long, b long, n long, s binary")


def _packer(tasks: int) -> Callable:
    """Rows (block, k, component, s) packed by task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                c = batch.slice(i, 500)
                yield _packed([(x, k, l, np.frombuffer(s, np.uint64)) for x, k, l, s in zip(*[c.column(n).to_pylist() for n in ("block", "k", "component", "s")], strict=True)], tasks)

    return pack


def links_within(sets: list[np.ndarray], percent: int, weights: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the weights of those it links with, exactly; with ``side``, only of those on the other side."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, w = n[order], weights[order]
    flat = np.concatenate([sets[i] for i in order.tolist()])
    row = np.repeat(np.arange(len(order)), n)
    tokens, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    # A shingle that one set alone has is in no intersection; what all have is in every one.
    some = (times > 1) & (times < len(order))
    everywhere = int((times == len(order)).sum()) if len(order) > 1 else 0
    place = np.cumsum(some) - 1
    hit = some[which]
    bits = max(64, -(-int(some.sum()) // 64) * 64)
    maps = np.zeros((len(order), bits // 64), np.uint64)
    at = place[which[hit]]
    np.bitwise_or.at(maps, (row[hit], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    out = np.zeros(len(order), np.int64)
    end = np.searchsorted(n, 100 * n // percent, "right")
    turned = None if side is None else side[order]
    step = max(1, (1 << 21) // maps.shape[1])
    for i in range(len(order) - 1):
        for j in range(i + 1, int(end[i]), step):
            to = min(j + step, int(end[i]))
            shared = np.bitwise_count(maps[j:to] & maps[i]).sum(axis=1, dtype=np.int64) + everywhere
            link = 100 * shared >= percent * (n[i] + n[j:to] - shared)
            if turned is not None:
                link &= turned[j:to] != turned[i]
            out[i] += int(w[j:to][link].sum())
            out[j:to][link] += w[i]
    back = np.empty_like(out)
    back[order] = out
    return back


def _link_counts(rows: DataFrame, reps: DataFrame, copies: DataFrame, component: DataFrame, many: int, size: int, percent: int, width: int, work: Workspace) -> DataFrame:
    """(a, b, n, links): of each distinct set that has a partner, the documents with other sets that it links with.

    From sets (k, a, b, n), the documents that have them (a, b, n, c), and (node, component).
    """
    own = reps.select("k", "a", "b", "n").join(component.withColumnRenamed("node", "k"), "k").join(copies, ["a", "b", "n"])
    totals = own.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("cn")).where("m > 1").drop("m")
    placed = own.join(totals, "component").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("cn") / (BLOCK_BYTES // 8)))).withColumn("chunk", F.pmod(F.xxhash64("a", "b"), F.col("parts")))
    placed = work.save(placed, "placed")
    keep = _passes(_filter(placed.select("k"), many))
    total = placed.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    tasks = max(width, -(-8 * total // TASK_BYTES))
    # Chunks of a component meet pairwise, and each pair of sets is counted where their chunks meet.
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least("chunk", j).alias("x"), F.greatest("chunk", j).alias("y")))
    dealt = placed.select("k", "a", "b", "n", "c", "component", "chunk", F.explode(pairs).alias("p"))
    dealt = dealt.select("k", "a", "b", "n", "c", F.xxhash64("component", "p.x", "p.y").alias("block"), (F.col("chunk") == F.col("p.y")).alias("side"), (F.col("p.x") != F.col("p.y")).alias("cross"))
    met = _whole_sets(rows, size, keep).join(dealt, ["k", "a", "b", "n"])

    def count(table: pa.Table) -> pa.Table:
        # Rows that repeat bring a set twice.
        table = table.sort_by([(x, "ascending") for x in ("block", "a", "b", "n")])
        key = np.stack([table.column(x).to_numpy() for x in ("block", "a", "b", "n")], axis=1)
        table = table.filter(pa.array(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))[: len(key)]))
        block = table.column("block").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        links = np.zeros(len(block), np.int64)
        c, side, cross = (table.column(x).to_numpy() for x in ("c", "side", "cross"))
        blobs = table.column("s").to_pylist()
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if y - x > 1:
                links[x:y] = links_within([np.frombuffer(b, np.uint64) for b in blobs[x:y]], percent, c[x:y], side[x:y] if cross[x] else None)
        return pa.table({**{n: table.column(n) for n in ("a", "b", "n")}, "links": pa.array(links)})

    found = met.withColumn("g", F.pmod("block", F.lit(tasks))).groupBy("g").applyInArrow(lean_group(count), "a long, b long, n long, links long")
    return found.groupBy("a", "b", "n").agg(F.sum("links").alias("links"))


def _distinct_sets(rows: DataFrame, size: int, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scanned, thin rows, those that take part, distinct sets by their least key) of rows (k, t)."""
    scanned = work.save(_scan(rows, size), "scan")
    thin = scanned.where("kind = 0").select("k", "n", "a", "b", "m1", "m2", "parity")
    usable = thin.where("k is not null and n > 0")
    reps = usable.groupBy("a", "b", "n").agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("m1", "m2", "parity")])
    return scanned, thin, usable, work.save(reps, "sets")


def jaccard_links(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links as (u, v, shared), u < v, between the least keys of different sets, and (key, n_shingles, set_id, n_links) for every row.

    ``shared`` counts the shingles both have. ``set_id`` is the least key with
    the row's set, so that the links of any two documents are those of their
    sets, and documents of one set link too. ``n_links`` counts the other
    documents that a document links with, however alike they are to each
    other. Null keys, empty sets and repeated keys are as in
    ``jaccard_components``: the former two have no set and no links, and a key
    that repeats with different texts has a row, with its links, for each text, and
    counts as often for others. No pair is left out, so the links of a group of near copies grow
    with the square of its distinct sets; copies of one set add none.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = df.sparkSession
    work, width = Workspace(spark, "links"), shuffle_width(spark)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    scanned, thin, usable, reps = _distinct_sets(rows, size, work)
    # A key may be the least of several sets, so sets meet under a number of their own.
    numbered = work.save(reps.select("k", "n", "a", "b", "parity", F.xxhash64("a", "b", "n").alias("set")), "numbered")
    many = reps.count()
    shared = _shared_prefixes(rows, reps, many, _levels(scanned), size, percent, width)
    shared = work.save(shared, "shared")
    numbers = shared.join(numbered.select("k", "set"), "k").groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    meets = shared.join(numbered, "k").join(numbers, "t").select("t", "c", F.col("set").alias("k"), F.col("set").alias("component"), "n", "parity")
    total = numbers.agg(F.sum("c")).first()[0] or 0
    pairs = work.save(_candidates(meets, total, percent, width, whole=True), "pairs")
    work.release()
    keep = _passes(_filter(reps.select("k"), many))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).size for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            shared = np.array(both, np.int64)
            total = batch.column("n").to_numpy()
            link = 100 * shared >= percent * (total - shared)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(pa.array(link)) for c in ("u", "v")], pa.array(shared[link])], names=["u", "v", "shared"])

    whole = _whole_sets(rows, size, keep).join(numbered, ["k", "a", "b", "n"]).groupBy("set").agg(F.first("s").alias("s"), F.first("n").alias("n"))
    whole = work.save(whole, "whole")
    x, y = (whole.select(F.col("set").alias(e), F.col("s").alias(c), F.col("n").alias(f"n{c}")) for e, c in (("u", "x"), ("v", "y")))
    met = pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y", (F.col("nx") + F.col("ny")).alias("n"))
    links = work.save(met.mapInArrow(lean(verify), "u long, v long, shared long"), "links")
    work.drop("whole")
    # Documents of each set, and of the sets that link with it.
    members = usable.select("k", "a", "b", "n").distinct().join(numbered.select("a", "b", "n", "set", F.col("k").alias("set_id")), ["a", "b", "n"])
    members = work.save(members.select("k", "a", "b", "n", "set", "set_id"), "members")
    sizes = members.groupBy("set").agg(F.count(F.lit(1)).alias("c"))
    both = links.select("u", "v").union(links.select("v", "u"))
    near = both.join(sizes.withColumnRenamed("set", "v"), "v").groupBy(F.col("u").alias("set")).agg(F.sum("c").alias("near"))
    counts = sizes.join(near, "set", "left").select("set", (F.col("c") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    own = members.join(counts, "set").select("k", "a", "b", "n", "set_id", "n_links")
    kind = df.schema[key].dataType
    out = thin.select("k", "a", "b", "n").join(own, ["k", "a", "b", "n"], "left")
    out = out.select(F.col("k").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("set_id").cast(kind).alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    ids = numbered.select("set", "k")
    named = links.join(ids.select(F.col("set").alias("u"), F.col("k").alias("ku")), "u").join(ids.select(F.col("set").alias("v"), F.col("k").alias("kv")), "v")
    named = named.select(F.least("ku", "kv").cast(kind).alias("u"), F.greatest("ku", "kv").cast(kind).alias("v"), "shared")
    return named, out


def jaccard_components(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """(key, n_shingles, component_id) for every row, and n_links with ``counts``.

    A text's set has its distinct shingles of ``size`` words, A-Z in lower
    case; with fewer words, the whole sequence is the one shingle. Two rows link if 100 *
    intersection >= ``percent`` * union; the component is the smallest key that
    links lead to; n_links counts the other documents that the row's own text links with, copies of it
    included. Very long texts have all their shingles. Null texts and texts without words have the empty set and
    link with nothing. Rows with a null key take no part and get a null component. Rows that
    share a key are one document for links. An empty table stays empty. Other columns aren't read. The
    key must be an integer. Shingles are compared by 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = df.sparkSession
    work, width = Workspace(spark, "similar"), shuffle_width(spark)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    scanned, thin, usable, reps = _distinct_sets(rows, size, work)
    levels, many = _levels(scanned), reps.count()
    equal = usable.join(reps.select("a", "b", "n", F.col("k").alias("u")), ["a", "b", "n"]).where("k <> u").select("u", F.col("k").alias("v"))
    links = work.save(equal, "equal")
    near = _near_links(rows, reps, many, size, percent, width, work)
    if near is not None:
        links = links.union(work.save(near, "near"))
        del near
        work.release()
    shared = work.save(_shared_prefixes(rows, reps, many, levels, size, percent, width), "shared")
    work.release()
    labels = components(links, work, "first")
    known = shared.join(labels.withColumnRenamed("node", "k"), "k", "left").select("t", "k", F.coalesce("component", "k").alias("component"))
    known = work.save(known, "known")
    open_ = known.groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high").select("t", "c")
    total = open_.agg(F.sum("c")).first()[0] or 0
    meets = known.join(open_, "t").join(reps.select("k", "n", "parity"), "k")
    pairs = work.save(_candidates(meets, total, percent, width), "pairs")
    work.release()
    if pairs.limit(1).count():
        families = components(pairs, work, "families").withColumnsRenamed({"node": "k", "component": "family"})
        members = families.join(labels.withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("component", "k").alias("component"), "family")
        members = work.save(members, "members")
        more = work.save(_family_links(rows, reps, many, members, size, percent, width), "more")
        work.release()
        if more.limit(1).count():
            labels = components(links.union(more), work, "second")
    kind = df.schema[key].dataType
    columns = [F.col("k").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id")]
    out = thin.select("k", "a", "b", "n").join(labels.withColumnRenamed("node", "k"), "k", "left")
    if counts:
        # Rows of one key and one set are one document.
        copies = work.save(usable.select("a", "b", "n", "k").distinct().groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("c")), "copies")
        linked = _link_counts(rows, reps, copies, labels, many, size, percent, width, work)
        linked = work.save(copies.join(linked, ["a", "b", "n"], "left").select("a", "b", "n", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counts")
        work.release()
        out = out.join(linked, ["a", "b", "n"], "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.select(*columns)
