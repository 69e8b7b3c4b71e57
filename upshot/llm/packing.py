"""Packing token sequences by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so a corpus is a histogram of at
most ``capacity`` counts, whatever its size. The plan is made on that histogram:

1. Lengths above a share of the capacity are large. In falling order they are cut
   into some groups of equal numbers, and each is rounded up to the largest of its
   group. Share and number of groups are the best of ``SETTINGS``.
2. For these few sizes, the best numbers of each configuration (sizes that fit
   together) come from the linear program over all configurations, solved by
   column generation, rounded down.
3. Actual lengths take the places of the rounded ones, group by group; this only
   frees space.
4. What is left, large ones over from the rounding first, goes in falling order
   to the sequence with the least space that takes it, for many equal sequences
   at once. Sequences that still have room are taken apart and best-fitted again.

The plan's tables grow with the number of different lengths and configurations,
not with the documents. Each piece then finds its place by its length and its
number among the pieces of that length.

Defined cases: a null text is empty, so a document of the single id 0; every row
is packed, repeated ones and null ids too; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INT, LONG, documents, gapless_rank, lean, materialise, schema, ship_package

CAPACITY = 2048
SETTINGS = ((32, 1 / 4), (32, 1 / 3), (64, 1 / 3), (32, 1 / 2))  # (groups, share of the capacity up to which lengths are small)
_ENCODERS: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def bytes_of_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabulary files use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def is_panic(e: BaseException) -> bool:
    """A panic of a tokenizer's native code: no ``Exception``, and raised for one text alone."""
    return type(e).__name__ == "PanicException"


def encoder(path: str):
    """``texts -> lists of ids`` for a byte-level vocabulary file. Its ids are in
    the order of its merges, so the byte-pair routine of tiktoken gives the same
    ids on the same vocabulary, at twice the speed; a text that has one of the
    file's added tokens, or a run of white space too long for the routine's pattern, is
    left to the tokenizers library."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = bytes_of_letters()
        special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole: list[Tokenizer] = []  # loaded for the first text that needs it

        def by_library(text: str) -> list[int]:
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return whole[0].encode(text, add_special_tokens=False).ids

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return by_library(text)
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:
                if not is_panic(e):
                    raise
                return by_library(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
             path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``
    and, if wanted, ``ids``."""
    path = path or tokenizer_path()
    out = schema(id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG)
    if keep_ids:
        out = out.add("ids", T.ArrayType(LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array(encode(text.as_py() or "") + [0], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start:start + length]
                    rows.append((i, k, start, length, zlib.crc32(part.tobytes()), part.tolist() if keep_ids else None))
            yield pa.RecordBatch.from_pydict({
                f.name: pa.array([r[k] for r in rows],
                                 pa.int32() if f.name == "piece" else pa.list_(pa.int64()) if f.name == "ids" else pa.int64())
                for k, f in enumerate(out.fields)})

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(lean(run), out)


def best_configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number, multiplicity of each size) from the linear program, rounded down."""
    m = len(sizes)
    s = np.array(sizes)
    columns = [np.eye(m, dtype=int)[i] * (capacity // sizes[i]) for i in range(m)]
    basis = np.array(columns, dtype=float).T
    cost = np.ones(m)
    amount = np.linalg.solve(basis, np.array(wanted, dtype=float))
    for _ in range(60 * m):
        price = np.linalg.solve(basis.T, cost)
        worst = int(np.argmin(price))
        if price[worst] < -1e-9:  # more than wanted of a size costs nothing
            new, new_cost = -np.eye(m, dtype=int)[worst], 0.0
        else:
            value = np.zeros(capacity + 1)
            take = np.full(capacity + 1, -1)
            for c in range(min(sizes), capacity + 1):
                fits = np.flatnonzero(s <= c)
                gain = value[c - s[fits]] + price[fits]
                k = int(np.argmax(gain))
                value[c], take[c] = gain[k], fits[k]
                if value[c - 1] >= value[c]:
                    value[c], take[c] = value[c - 1], -2
            if value[capacity] <= 1 + 1e-9:
                break
            new, c = np.zeros(m, dtype=int), capacity
            while c >= 0 and take[c] != -1:
                if take[c] == -2:
                    c -= 1
                else:
                    new[take[c]] += 1
                    c -= sizes[take[c]]
            new_cost = 1.0
        step = np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out], cost[out], columns[out] = new, new_cost, new
    return [(int(x + 1e-7), [int(v) for v in col]) for x, col, c in zip(amount, columns, cost, strict=True)
            if c and x >= 1 - 1e-7]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of sequences, their lengths in order) for ``{length: pieces}``: the
    scheme with the setting of ``SETTINGS`` that needs the fewest sequences."""
    plans = [linear_grouping(histogram, capacity, groups, small) for groups, small in SETTINGS]
    return min(plans, key=lambda p: sum(n for n, _ in p))


def linear_grouping(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[int, list[int]]]:
    done: list[tuple[int, list[int]]] = []
    left = dict(sorted(((k, v) for k, v in histogram.items() if v), reverse=True))
    if left.get(capacity):
        done.append((left.pop(capacity), [capacity]))
    large = [(k, v) for k, v in left.items() if k > small * capacity]
    total = sum(v for _, v in large)
    stacks: list[list[list[int]]] = []  # of each group: [length, number], the shortest last
    if total:
        share = -(-total // min(groups, total))
        room = 0
        for k, v in large:
            while v:
                if not room:
                    stacks.append([])
                    room = share
                n = min(v, room)
                stacks[-1].append([k, n])
                v, room = v - n, room - n
        sizes = [g[0][0] for g in stacks]
        wanted = [sum(n for _, n in g) for g in stacks]
        by_size: dict[int, list[int]] = {}
        for i, size in enumerate(sizes):
            by_size.setdefault(size, []).append(i)
        merged = [[run for i in by_size[size] for run in stacks[i]] for size in by_size]
        found = best_configurations(list(by_size), [sum(wanted[i] for i in v) for v in by_size.values()], capacity)
        for number, times in found:
            slots = [g for g, n in enumerate(times) for _ in range(n)]
            heads = [(g, i) for i, g in enumerate(slots)]
            while number and any(merged[g] for g, _ in heads):
                need: dict[int, int] = {}
                for g in slots:
                    need[g] = need.get(g, 0) + 1
                # as many equal sequences as the first lengths of the groups allow
                step = number
                for g, n in need.items():
                    if merged[g]:
                        step = min(step, max(merged[g][0][1] // n, 1))
                lengths = []
                for g, n in need.items():
                    for _ in range(n):
                        if merged[g]:
                            head = merged[g][0]
                            if head[1] < step:
                                step = 1
                            lengths.append((g, head[0]))
                            head[1] -= step
                            if not head[1]:
                                merged[g].pop(0)
                done.append((step, [k for _, k in lengths]))
                number -= step
        left = {k: v for k, v in left.items() if k <= small * capacity}
        for g in merged:
            for k, v in g:
                left[k] = left.get(k, 0) + v
    return _refit(_best_fit(done, left, capacity), capacity)


def _refit(patterns: list[tuple[int, list[int]]], capacity: int) -> list[tuple[int, list[int]]]:
    """Sequences with more than a few tokens free are taken apart and best-fitted
    again, as long as that saves some."""
    for share in (256, 128, 64, 32, 16):
        good = [(n, k) for n, k in patterns if capacity - sum(k) <= capacity // share]
        loose: dict[int, int] = {}
        for n, lengths in patterns:
            if capacity - sum(lengths) > capacity // share:
                for k in lengths:
                    loose[k] = loose.get(k, 0) + n
        again = _best_fit(good, loose, capacity)
        if sum(n for n, _ in again) < sum(n for n, _ in patterns):
            patterns = again
    return patterns


def _best_fit(done: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    spaces: dict[int, list[tuple[int, list[int]]]] = {}
    order: list[int] = []

    def put(number: int, lengths: list[int]) -> None:
        space = capacity - sum(lengths)
        if space not in spaces:
            spaces[space] = []
            insort(order, space)
        spaces[space].append((number, lengths))

    for number, lengths in done:
        put(number, lengths)
    for k in sorted(left, reverse=True):
        v = left[k]
        while v:
            at = bisect_left(order, k)
            if at == len(order):
                put(-(-v // (capacity // k)), [])
                at = len(order) - 1
            space = order[at]
            number, lengths = spaces[space].pop()
            if not spaces[space]:
                del spaces[space]
                order.pop(at)
            each = min(space // k, v)
            full = min(number, v // each)
            put(full, lengths + [k] * each)
            v -= full * each
            if number > full:
                rest = number - full
                if v:
                    put(1, lengths + [k] * v)
                    v, rest = 0, rest - 1
                if rest:
                    put(rest, lengths)
    return [p for space in order for p in spaces[space] if p[1]]


def places(patterns: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For pieces numbered within their length: the runs that lie in like places,
    by ``key = length * 2**48 + first number``."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for number, lengths in patterns:
        offset = 0
        for k in lengths:
            rows.append(((k << 48) + used.get(k, 0), sequence, offset))
            used[k] = used.get(k, 0) + number
            offset += k
        sequence += number
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of :func:`tokenize` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    ship_package(spark)
    pieces, _ = materialise(tokenize(docs, id_col, text_col, capacity, path, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(histogram, capacity), capacity)
    names = pieces.columns
    ranked = gapless_rank(pieces, "length", ["id", "piece", "ids_crc32"], "rank", rows=sum(histogram.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b.column("length").to_numpy() << 48) + b.column("rank").to_numpy()
            at = np.searchsorted(table["key"], key, side="right") - 1
            number = key - table["key"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(table["sequence"][at] + number), pa.array(table["offset"][at])],
                [*names, "sequence_id", "offset"])

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", LONG), T.StructField("offset", LONG)])
    return ranked.select(*names, "rank").mapInArrow(lean(run), out).withColumnRenamed("id", id_col)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, one row per piece."""
    return pack(documents(spark, sf_dir))
