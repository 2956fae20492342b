"""Best-fit packing by bin completion branch-and-bound over the histogram of lengths.

1. ``pieces`` tokenises whole texts in a map pass (a word cache in front of the
   tokenizer), appends the end id, and cuts documents longer than a sequence into full
   pieces, the first of which may be shorter.
2. The lengths lie in 1..capacity, so their histogram has at most ``capacity`` rows at
   any scale.  ``search`` packs the histogram by bin completion: branch and bound over
   whole packings, each node branching over the undominated fillings of the largest length
   left.  Branches that cannot beat the incumbent are pruned by total waste and a lower bound;
   best-fit decreasing and the plan of least-waste fillings are the first incumbents.  It
   ends when a plan is proven optimal or after ``MAX_NODES`` nodes (the same ones in every run).
3. ``place`` ranks the pieces within each length (per hash bucket, so that a length held
   by a third of all pieces is many small sorts) and looks up sequence and offset of
   each rank in the plan, a table bounded by the number of applied fillings.

Edge cases: null and empty texts are the end id alone; repeated rows are packed as often
as they occur; equal lengths are ranked by bucket and doc_id; an empty table has no row;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import column

CAPACITY = 2048
END_ID = 0
CACHE_PIECES = 400_000   # entries of a worker's word cache; it is emptied when full
MAX_NODES = 20_000       # fillings and branches looked at in the search over whole packings
#: frames of the search that are kept open; older ones are drawn again when the search comes back to them
LIVE_FRAMES = 64
RANK_BUCKETS = 64        # hash buckets of a length


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    The pre-tokenizer never joins the two sides of a single blank between two visible
    characters (the blank opens the right side), so the parts are encoded on their own
    and remembered.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # byte-level alphabet of the vocabulary file: printable bytes stand for themselves, the rest follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        import public_tokenizers
        self.fast = tiktoken.Encoding("vocab", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.cache: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        return np.array(self.fast.encode_ordinary(part), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        # a part is safe to encode alone if it is not empty and has no white space at its ends
        out, cache, run = [], self.cache, parts[0]
        for part in parts[1:]:
            if run and part and not run[-1].isspace() and not part[0].isspace():
                got = cache.get(run)
                if got is None:
                    got = self._ids(run)
                    if len(run) < 64:
                        if len(cache) >= CACHE_PIECES:
                            cache.clear()
                        cache[run] = got
                out.append(got)
                run = " " + part
            else:
                run += " " + part
        out.append(self._ids(run) if run else b"")
        return b"".join(out)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of at most ``capacity`` tokens."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path or tokenizer_path())
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                ids = enc.encode(text or "") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                start, last = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, last - start, zlib.crc32(ids[4 * start:4 * last])))
                    start, last, piece = last, last + capacity, piece + 1
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _dominated(count: np.ndarray, filling: list[int], waste: int) -> bool:
    """Whether a piece, or two together, can give way to one larger piece that is left over and fits."""
    single = set(filling)
    spare = count.copy()
    for x in filling:
        spare[x] -= 1
    for x in single:
        if spare[x + 1:x + waste + 1].any():
            return True
    pairs = {x + y for x in single for y in single if x < y} | {2 * x for x in single if filling.count(x) > 1}
    return any(spare[s:s + waste + 1].any() for s in pairs) or bool(spare[1:waste + 1].any())


def fillings(count: np.ndarray, largest: int, capacity: int, slack: int, budget: list[int]) -> Iterator[list[int]]:
    """Undominated lengths to put beside one piece of ``largest``, by waste (at most ``slack``), large pieces first.

    ``reach[i]`` has bit s set when the i smallest lengths left can sum to s, so no branch of the enumeration is
    dead.  Every filling looked at takes one of ``budget[0]``; nothing is left out before the budget ends.
    """
    room = capacity - largest
    avail = count[:room + 1].copy()
    if largest <= room:
        avail[largest] -= 1
    lens = np.flatnonzero(avail).tolist()
    own = avail[lens].tolist()
    mask, reach = (1 << room + 1) - 1, [1]
    for x, n in zip(lens, own):
        got, rest, step = reach[-1], min(n, room // x), 1
        while rest:
            step = min(step, rest)
            got |= got << step * x & mask
            rest, step = rest - step, 2 * step
        reach.append(got)

    def exact(j: int, r: int) -> Iterator[list[int]]:
        if not r:
            yield []
            return
        for i in range(min(j, bisect.bisect_right(lens, r)) - 1, -1, -1):
            if not reach[i + 1] >> r & 1:
                return
            x = lens[i]
            for n in range(min(own[i], r // x), 0, -1):
                if reach[i] >> r - n * x & 1:
                    for rest in exact(i, r - n * x):
                        yield [x] * n + rest

    whole = count.copy()
    whole[largest] -= 1
    for waste in range(min(slack, room) + 1):
        if reach[-1] >> room - waste & 1:
            for filling in exact(len(lens), room - waste):
                budget[0] -= 1
                if budget[0] < 0:
                    return
                if not _dominated(whole, filling, waste):
                    yield filling


def _fill_counts(filling: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in filling:
        out[x] = out.get(x, 0) + 1
    return out


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Least number of sequences: the sum over the capacity, and for each threshold a the lengths of at least a that
    do not fit beside those above half (Martello and Toth)."""
    half, a = capacity // 2, np.arange(capacity // 2 + 1)
    n, s = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    beside = n[capacity - a] - n[half]
    rest = s[half] - np.where(a > 0, s[np.maximum(a - 1, 0)], 0) - (beside * capacity - (s[capacity - a] - s[half]))
    return int((n[-1] - n[half] + np.maximum(0, -(-rest // capacity))).max()) if n[-1] else 0


def _counts(hist: dict[int, int], capacity: int) -> np.ndarray:
    count = np.zeros(capacity + 1, np.int64)
    for k, v in hist.items():
        count[k] = v
    return count


def _most(count: np.ndarray, use: dict[int, int]) -> int:
    return min(int(count[x]) // n for x, n in use.items())


def completion_plan(hist: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, times)]: the filling of least waste around the largest length left, as often as it goes."""
    count, out = _counts(hist, capacity), []
    while count.any():
        largest = int(np.flatnonzero(count)[-1])
        # the first one looked at wastes least and is the lexicographically greatest of its sum, so nothing dominates it
        beside = next(fillings(count, largest, capacity, capacity, [1]))
        use = _fill_counts([largest, *beside])
        times = _most(count, use)
        for x, n in use.items():
            count[x] -= n * times
        out.append(([largest, *beside], times))
    return out


def decreasing_plan(hist: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on the histogram: the first incumbent of the whole packing."""
    count = np.zeros(capacity + 1, np.int64)
    for k, v in hist.items():
        count[k] = v
    out = []
    while count.any():
        left, filling, own = capacity, [], count.copy()
        while True:
            lens = np.flatnonzero(own[:left + 1])
            if not len(lens):
                break
            x = int(lens[-1])
            take = min(int(own[x]), left // x)
            filling += [x] * take
            own[x] -= take
            left -= take * x
        use = _fill_counts(filling)
        times = min(int(count[x]) // n for x, n in use.items())
        for x, n in use.items():
            count[x] -= n * times
        out.append((filling, times))
    return out


def search(hist: dict[int, int], capacity: int, max_nodes: int = MAX_NODES) -> tuple[list[tuple[list[int], int]], int, bool]:
    """(plan, lower bound, proven): branch and bound over whole packings.

    A node is the lengths left.  It branches over the undominated fillings of its largest length, each as often as
    the counts allow, then less often.  Once all branches of a filling are done, no better packing holds it beside
    that length, so later siblings leave it out.  A branch ends when the sequences so far and the bound of the rest
    reach the incumbent; a filling may waste no more than the incumbent leaves.  The first incumbents are best-fit
    decreasing and the completion plan.  The plan is proven optimal when it meets the bound or the tree was done
    within ``max_nodes`` fillings; the node budget, unlike a time limit, gives the same plan in every run.
    """
    count = _counts(hist, capacity)
    bound = lower_bound(count, capacity)

    def size(p: list[tuple[list[int], int]]) -> int:
        return sum(t for _, t in p)

    best = decreasing_plan(hist, capacity)
    if size(best) > bound:
        best = min(best, completion_plan(hist, capacity), key=size)
    total, budget = sum(k * v for k, v in hist.items()), [max_nodes]
    path: list[tuple[list[int], int]] = []
    used = 0

    def branches(out: set[tuple[int, ...]]) -> Iterator[tuple[list[int], int, set]]:
        largest = int(np.flatnonzero(count)[-1])
        left = int((count * np.arange(capacity + 1)).sum())
        slack = (size(best) - 1) * capacity - total - (used * capacity - (total - left))
        for beside in fillings(count.copy(), largest, capacity, slack, budget):
            key = (largest, *beside)
            if key in out:
                continue
            for times in range(_most(count, _fill_counts(list(key))), 0, -1):
                yield list(key), times, {k for k in out if k[0] == largest} | {key}
            out.add(key)

    def move(filling: list[int], times: int) -> None:
        for x, n in _fill_counts(filling).items():
            count[x] -= n * times

    def reopened(out: frozenset, done: int) -> Iterator[tuple[list[int], int, set]]:
        """The branches behind the first ``done``, which are drawn again without charge."""
        spent, budget[0] = budget[0], 1 << 60
        again = branches(set(out))
        for _ in itertools.islice(again, done):
            pass
        budget[0] = spent
        return again

    # a frame is [open branches or None, sets left out when it was made, branches taken]; only the last LIVE_FRAMES
    # stay open, as an open one holds its table of reachable sums
    frames: list[list] = [[branches(set()), frozenset(), 0]] if size(best) > bound else []
    while frames and size(best) > bound:
        if len(path) == len(frames):  # back from a branch
            filling, times = path.pop()
            move(filling, -times)
            used -= times
        if budget[0] >= 0 and frames[-1][0] is None:
            frames[-1][0] = reopened(*frames[-1][1:])
        got = next(frames[-1][0], None) if budget[0] >= 0 else None
        budget[0] -= 1
        if budget[0] < 0:
            break
        if got is None:
            frames.pop()
            continue
        frames[-1][2] += 1
        filling, times, out = got
        path.append((filling, times))
        move(filling, times)
        used += times
        if not count.any():
            if used < size(best):
                best = list(path)
        elif used + lower_bound(count, capacity) < size(best):
            frames.append([branches(out), frozenset(out), 0])
            if len(frames) > LIVE_FRAMES:
                frames[-LIVE_FRAMES - 1][0] = None
    return best, bound, size(best) <= bound or budget[0] >= 0


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    return search(hist, capacity)[0]


def _blocks(entries: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of one length: sequence of the first rank (then consecutive) and offset."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for filling, times in entries:
        offset = 0
        for x in filling:
            rows.append((x, rank.get(x, 0), seq, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": cols[:, 0] << 44 | cols[:, 1], "rank": cols[:, 1], "seq": cols[:, 2], "offset": cols[:, 3]}


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (read three times: materialise it) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    salted = cut_pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int"))
    sizes = salted.groupBy("length", "_b").count().collect()  # at most capacity * RANK_BUCKETS rows
    hist: dict[int, int] = {}
    base: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: (r["length"], r["_b"])):
        base[r["length"] << 16 | r["_b"]] = hist.get(r["length"], 0)
        hist[r["length"]] = hist.get(r["length"], 0) + r["count"]
    blocks = _blocks(plan(hist, capacity))
    base_key = np.array(sorted(base), np.int64)
    shared = spark.sparkContext.broadcast((blocks, base_key, np.array([base[k] for k in base_key.tolist()], np.int64)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, first = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, b, rn = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_b", "_rn"))
            rank = first[np.searchsorted(keys, length << 16 | b)] + rn - 1
            at = np.searchsorted(table["key"], length << 44 | rank, "right") - 1
            out = pa.RecordBatch.from_arrays(
                [column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(table["seq"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
            yield out

    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("_rn", F.row_number().over(order).cast("long"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return place(cut(pieces(docs, capacity, path)), capacity)
