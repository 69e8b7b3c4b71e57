"""Substring deduplication with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Each word covered by a window whose
word sequence also starts in a document with a smaller id is removed.

Method. With a difference cover ``COVER`` of the residues modulo ``PERIOD``, any
two positions have a shift below ``PERIOD`` that puts both on the cover. So two
equal windows hold an equal *anchor*, ``ANCHOR = WINDOW - PERIOD + 1`` words that
start at a cover position in both. Only these anchors, a fifth of all positions,
are hashed and compared over the corpus. Windows around an anchor that another
document has are then hashed whole (extension) and compared exactly, by 96 bits.

Distribution. Documents are dealt into chunks of bounded bytes. A chunk sends
each hash once, whatever the number of its documents that hold it, as packed
arrays per hash range. A range's task thus gets at most one entry per chunk and
hash: copies and common passages are combined before the shuffle, no key is hot,
and no pairs are formed. Answers go back to the chunks. Intermediate tables lie
in the shared checkpoint folder.

Defined cases: a null or empty text has no words; documents shorter than the
window and rows with a null id lose nothing and remove nothing; rows that repeat
an id aren't smaller than each other; an empty table gives an empty result; all
input columns come back, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import BINARY, INT, LONG, STRING, documents, drop_scratch, lean, lean_group, materialise, schema, shuffle_partitions

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set: each shift occurs once
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096

_ON_COVER = np.zeros(PERIOD, dtype=bool)
_ON_COVER[list(COVER)] = True


def _squeeze(x: np.ndarray | bytes) -> bytes:
    return pa.compress(pa.py_buffer(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()),
                       codec="zstd", asbytes=True)


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    return _squeeze(x), x.nbytes


def _unsqueeze(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _by_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the hash range of each hash."""
    return ((h >> W.U(32)) * W.U(ranges) >> W.U(32)).astype(np.int64)


def _anchors(w: W.Words, h: np.ndarray, named: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the anchor that starts at each word, and which of them count."""
    x, whole = w.windows(h, window - PERIOD + 1)
    return x, whole & _ON_COVER[w.position() % PERIOD] & np.repeat((w.counts >= window) & named, w.counts)


def _candidates(w: W.Words, h: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Which windows hold one of the anchors ``hit``."""
    near = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(near, np.maximum(at - (PERIOD - 1), 0), 1)
    np.add.at(near, at + 1, -1)
    last = np.repeat(w.first[1:], w.counts)
    of_text = np.repeat(w.first[:-1], w.counts)
    reach = np.zeros(len(h), dtype=np.int64)  # first word of the text of the next hit
    reach[:] = len(h)
    reach[at] = of_text[at]
    reach = np.minimum.accumulate(reach[::-1])[::-1]
    return (np.cumsum(near[:-1]) > 0) & (np.arange(len(h)) >= reach) & (np.arange(len(h)) + window <= last)


_RANGE = schema(part=LONG, chunk=LONG, size=LONG, data=BINARY)


def _deal(row_type: T.StructType, ranges: int, window: int):
    """Rows of kind 0: the documents, with their chunk; kind 1: each chunk's
    anchor hashes by range, twice if several of its documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0
        schema_out = None
        for batch in batches:
            for big in W.chunks(batch, "text", CHUNK_BYTES):
                for at in range(0, big.num_rows, CHUNK_ROWS):
                    part = big.slice(at, CHUNK_ROWS)
                    chunk = (task << 32) | number
                    number += 1
                    ids = part.column("id")
                    named = ids.is_valid().to_numpy(zero_copy_only=False)
                    found = []
                    done = 0
                    for c in W.chunks(part, "text"):
                        w = W.split(c.column("text"))
                        h = w.hashes()
                        x, ok = _anchors(w, h, named[done:done + c.num_rows], window)
                        found.append(np.stack([x[ok], w.owner()[ok].astype(W.U) + W.U(done)]))
                        done += c.num_rows
                    x, own = np.concatenate(found, axis=1)
                    number_of = ids.fill_null(0).to_numpy(zero_copy_only=False)
                    order = np.lexsort((number_of[own.astype(np.int64)], x))
                    x, own = x[order], number_of[own[order].astype(np.int64)]
                    new = np.ones(len(x), dtype=bool)
                    new[1:] = x[1:] != x[:-1]
                    other = np.zeros(len(x), dtype=bool)  # the first occurrence in a second document
                    other[1:] = ~new[1:] & (own[1:] != own[:-1])
                    x = x[new | other]
                    cut = np.searchsorted(_by_range(x, ranges), np.arange(ranges + 1))
                    full = np.flatnonzero(np.diff(cut))
                    blobs = [x[cut[i]:cut[i + 1]].tobytes() for i in full]
                    n, m = part.num_rows, len(blobs)
                    text = part.column("text").cast(pa.large_binary())
                    cells = [None if v is None else _squeeze(v) for v in text.to_pylist()]
                    sizes = [None if v is None else len(v) for v in text.to_pylist()]
                    row = part.column("row")
                    kind = pa.array([0] * n + [1] * m, pa.int32())
                    cols = {"kind": kind, "chunk": pa.array([chunk] * (n + m), pa.int64()),
                            "part": pa.array([0] * n + full.tolist(), pa.int64()),
                            "size": pa.array(sizes + [len(b) for b in blobs], pa.int64()),
                            "data": pa.array(cells + blobs, pa.binary()),
                            "id": pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
                            "row": pa.concat_arrays([row, pa.nulls(m, row.type)])}
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one hash range: the hashes that two documents hold, for each chunk that sent them."""
    sent = [np.frombuffer(b, dtype=W.U) for b in table.column("data").to_pylist()]
    chunk = table.column("chunk").to_numpy()
    at = np.repeat(np.arange(len(sent)), [len(s) for s in sent])
    h = np.concatenate(sent)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(h)))
    keep = np.repeat(count > 1, count)
    h, at = h[keep], at[keep]
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    cut = np.searchsorted(at, np.arange(len(sent) + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.table({"chunk": pa.array(chunk[full], pa.int64()),
                     "data": pa.array([h[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary())})


def _texts(docs: pa.Table) -> pa.Array:
    return pa.array([None if b is None else _unsqueeze(b, n) for b, n in
                     zip(docs.column("data").to_pylist(), docs.column("size").to_pylist(), strict=True)],
                    pa.large_binary()).cast(pa.large_string())


def _in_order(docs: pa.Table) -> pa.Table:
    """By id, nulls last, so that the first to hold a window is the smallest."""
    return docs.sort_by([("id", "ascending"), ("size", "ascending")]).combine_chunks()


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _windows(docs: pa.Table, texts: pa.Array, window: int, pick) -> tuple:
    """Over the documents in order: windows picked by ``pick(w, h, first row)``:
    their two hashes, row and position."""
    out = [], [], [], []
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    done = 0
    for c in W.chunks(batch, "text"):
        w = W.split(c.column("text"))
        h = w.hashes()
        mask = pick(w, h, done)
        if mask.any():
            x, _ = w.windows(h, window)
            y, _ = w.windows(w.hashes(1), window, 1)
            for a, v in zip(out, (x[mask], (y[mask] >> W.U(32)).astype(np.uint32), w.owner()[mask] + done,
                                  w.position()[mask]), strict=True):
                a.append(v)
        done += c.num_rows
    kinds = W.U, np.uint32, np.int64, np.int64
    return tuple(np.concatenate(a) if a else np.zeros(0, k) for a, k in zip(out, kinds, strict=True))


def _firsts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each different window, ascending, and for every
    window its place among these."""
    order = np.lexsort((np.arange(len(x)), y, x))
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    group = np.cumsum(new) - 1
    first = order[new]
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    place = np.empty(len(x), dtype=np.int64)
    place[order] = rank[group]
    return np.sort(first), place


def _extend(ranges: int, window: int, keep_text: bool):
    """Rows of kind 0: documents with candidate windows, and the windows' runs; kind
    1: each chunk's candidate windows by range, once, with their smallest id; kind
    2: the other documents, which lose nothing, with their digests."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        known = (np.unique(np.concatenate([np.frombuffer(b, dtype=W.U) for b in shared.column("data").to_pylist()]))
                 if shared.num_rows else np.zeros(0, W.U))
        n = docs.num_rows
        named = docs.column("id").is_valid().to_numpy() if n else np.zeros(0, bool)
        starts, ends = [None] * n, [None] * n
        x = y = own = np.zeros(0, W.U)
        if len(known):
            def pick(w, h, done):
                a, ok = _anchors(w, h, named[done:done + len(w.counts)], window)
                ok[ok] = np.isin(a[ok], known)
                return _candidates(w, h, ok, window)

            x, y, own, pos = _windows(docs, _texts(docs), window, pick)
            cut = np.searchsorted(own, np.arange(n + 1))
            for i in np.flatnonzero(np.diff(cut)):
                p = pos[cut[i]:cut[i + 1]]
                gap = np.flatnonzero(np.diff(p) != 1)
                starts[i] = p[np.append(0, gap + 1)].tolist()
                ends[i] = (p[np.append(gap, len(p) - 1)] + 1).tolist()
        blobs, sizes, parts = [], [], []
        if len(x):
            first, _ = _firsts(x, y)
            x, y, own = x[first], y[first], docs.column("id").to_numpy()[own[first]].astype(np.int64)
            where = _by_range(x, ranges)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            for i in np.flatnonzero(np.diff(cut)):
                pick_ = order[cut[i]:cut[i + 1]]
                raw = x[pick_].tobytes() + y[pick_].tobytes() + np.diff(own[pick_], prepend=0).tobytes()
                blobs.append(_squeeze(raw))
                sizes.append(len(raw))
                parts.append(int(i))
        m = len(blobs)
        runs = pa.list_(pa.int64())
        clean = [s is None for s in starts]
        n_words, digest = [None] * n, [None] * n
        if any(clean):
            for i, text in enumerate(_texts(docs)):
                if clean[i]:
                    one = W.split(pa.array([text.as_py()], pa.large_string()))
                    n_words[i], digest[i] = len(one.start), hashlib.sha256(_joined(one)).hexdigest()
        cells = [c if keep_text or not q else None for c, q in zip(docs.column("data").to_pylist(), clean, strict=True)]
        chunk = docs.column("chunk")[0].as_py() if n else 0
        row = docs.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        ids = docs.column("id").to_pylist()
        return pa.table({
            "kind": pa.array([2 if q else 0 for q in clean] + [1] * m, pa.int32()), "chunk": pa.array([chunk] * (n + m), pa.int64()),
            "part": pa.array([0] * n + parts, pa.int64()),
            "size": pa.array(docs.column("size").to_pylist() + sizes, pa.int64()),
            "data": pa.array(cells + blobs, pa.binary()),
            "id": pa.array(ids + [None] * m, pa.int64()),
            "row": pa.concat_arrays([row, pa.nulls(m, row.type)]),
            "starts": pa.array(starts + [None] * m, runs), "ends": pa.array(ends + [None] * m, runs),
            "n_words": pa.array(n_words + [None] * m, pa.int64()), "kept_sha256": pa.array(digest + [None] * m, pa.string())})

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """Of one hash range: for each chunk, which of its windows a smaller document of another chunk holds."""
    xs, ys, ids = [], [], []
    for b, n in zip(table.column("data").to_pylist(), table.column("size").to_pylist(), strict=True):
        raw = _unsqueeze(b, n)
        m = n // 20
        xs.append(np.frombuffer(raw, W.U, m))
        ys.append(np.frombuffer(raw, np.uint32, m, 8 * m))
        ids.append(np.cumsum(np.frombuffer(raw, np.int64, m, 12 * m)))
    x, y, d = np.concatenate(xs), np.concatenate(ys), np.concatenate(ids)
    order = np.lexsort((d, y, x))
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    least = d[order][new][np.cumsum(new) - 1]
    late = np.empty(len(x), dtype=bool)
    late[order] = d[order] > least
    cut = np.cumsum([0] + [len(a) for a in xs])
    full = [i for i in range(len(xs)) if late[cut[i]:cut[i + 1]].any()]
    return pa.table({"chunk": pa.array([table.column("chunk")[i].as_py() for i in full], pa.int64()),
                     "part": pa.array([table.column("part")[i].as_py() for i in full], pa.int64()),
                     "size": pa.array([int(cut[i + 1] - cut[i]) for i in full], pa.int64()),
                     "data": pa.array([_squeeze(np.packbits(late[cut[i]:cut[i + 1]])) for i in full], pa.binary())})


def _remove(ranges: int, window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        texts = _texts(docs)
        n = docs.num_rows
        starts, ends = docs.column("starts").to_pylist(), docs.column("ends").to_pylist()

        def pick(w, h, done):
            mask = np.zeros(len(h), dtype=bool)
            for i in range(len(w.counts)):
                for a, b in zip(starts[done + i] or (), ends[done + i] or (), strict=True):
                    mask[w.first[i] + a:w.first[i] + b] = True
            return mask

        x, y, own, pos = _windows(docs, texts, window, pick)
        late = np.zeros(0, dtype=bool)
        if len(x):
            first, place = _firsts(x, y)
            where = _by_range(x[first], ranges)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            flag = np.zeros(len(first), dtype=bool)
            for p, m, b in zip(*(answers.column(c).to_pylist() for c in ("part", "size", "data")), strict=True):
                bits = np.frombuffer(_unsqueeze(b, -(-m // 8)), np.uint8)
                flag[order[cut[p]:cut[p + 1]]] = np.unpackbits(bits, count=m).astype(bool)
            ids = docs.column("id").to_numpy().astype(np.int64)
            late = flag[place] | (ids[own] > ids[own[first]][place])
        own, pos = own[late], pos[late]
        cut = np.searchsorted(own, np.arange(n + 1))
        kept, n_words, n_removed, digest = [], [], [], []
        for i, text in enumerate(texts.to_pylist()):
            if text is None:
                kept.append(None)
                n_words.append(0)
                n_removed.append(0)
                digest.append(hashlib.sha256(b"").hexdigest())
                continue
            one = W.split(pa.array([text], pa.large_string()))
            total = len(one.start)
            gone = 0
            body = text
            if cut[i] < cut[i + 1]:
                p = pos[cut[i]:cut[i + 1]]
                cover = np.zeros(total + 1, dtype=np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + window, -1)
                cover = np.cumsum(cover[:-1]) > 0
                gone = int(cover.sum())
                raw = one.data.tobytes()
                body = b" ".join(raw[a:b] for a, b in zip(one.start[~cover], one.end[~cover], strict=True))
                digest.append(hashlib.sha256(body).hexdigest())
                body = body.decode()
            else:
                digest.append(hashlib.sha256(_joined(one)).hexdigest())
            kept.append(body)
            n_words.append(total)
            n_removed.append(gone)
        row = docs.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        return pa.table({"row": row, "kept": pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_pydict({
            "row": b.column("row"), "kept": _texts(pa.Table.from_batches([b])).cast(pa.string()), "n_words": b.column("n_words"),
            "n_removed": pa.array(np.zeros(n, np.int64)), "kept_sha256": b.column("kept_sha256")})


def _joined(w: W.Words) -> bytes:
    """The words with one space between."""
    if not len(w.start):
        return b""
    keep = np.zeros(len(w.data), dtype=bool)
    edge = np.zeros(len(w.data) + 1, dtype=np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    keep = np.cumsum(edge[:-1]) > 0
    keep[w.end[:-1]] = True  # the separator after a word
    out = w.data.copy()
    out[w.end[:-1]] = 0x20
    return out[keep].tobytes()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with their columns in the struct ``row``, and ``kept``
    (the text as it was, or the kept words joined by one space if any were
    removed), ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words
    joined by one space. Without ``keep_text``, ``kept`` is null where nothing was
    removed."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be at least {PERIOD + 1} words")
    spark = docs.sparkSession
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    given = docs.select(F.struct(*rest).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    # anchors take about a quarter of the texts, and a partition of the scan has a bounded part of these
    ranges = max(16, shuffle_partitions(spark), given.rdd.getNumPartitions())
    row_type = given.schema["row"].dataType
    dealt_type = T.StructType([T.StructField("kind", INT), T.StructField("chunk", LONG), T.StructField("part", LONG),
                               T.StructField("size", LONG), T.StructField("data", BINARY), T.StructField("id", LONG),
                               T.StructField("row", row_type)])
    runs = T.ArrayType(LONG)
    extended_type = T.StructType([*dealt_type.fields, T.StructField("starts", runs), T.StructField("ends", runs), T.StructField("n_words", LONG),
                                  T.StructField("kept_sha256", STRING)])
    removed_type = T.StructType([T.StructField("row", row_type), T.StructField("kept", STRING),
                                 *schema(n_words=LONG, n_removed=LONG, kept_sha256=STRING).fields])

    dealt, dealt_path = materialise(given.mapInArrow(lean(_deal(row_type, ranges, window)), dealt_type), "dealt", "kind")
    shared = (dealt.where("kind = 1").select("part", "chunk", "data").groupBy("part")
              .applyInArrow(lean_group(_shared_anchors), schema(chunk=LONG, data=BINARY)))
    extended, _ = materialise(
        dealt.where("kind = 0").groupBy("chunk").cogroup(shared.groupBy("chunk"))
        .applyInArrow(lean_group(_extend(ranges, window, keep_text)), extended_type), "extended", "kind")
    drop_scratch(spark, dealt_path)
    earlier = (extended.where("kind = 1").select("part", "chunk", "size", "data").groupBy("part")
               .applyInArrow(lean_group(_earlier), schema(chunk=LONG, part=LONG, size=LONG, data=BINARY)))
    removed = (extended.where("kind = 0").drop("n_words", "kept_sha256").groupBy("chunk").cogroup(earlier.groupBy("chunk"))
               .applyInArrow(lean_group(_remove(ranges, window)), removed_type))
    clean = extended.where("kind = 2")
    if keep_text:
        clean = clean.select("row", "data", "size", "n_words", "kept_sha256").mapInArrow(lean(_unpack), removed_type)
    else:
        clean = clean.select("row", F.lit(None).cast("string").alias("kept"), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return removed.union(clean)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents: words, removed words and the digest of the kept ones."""
    out = dedup_substrings(documents(spark, sf_dir), keep_text=False)
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM w WHERE len(words) >= 50),
windows AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY md5(array_to_string(words[p:p + 49], ' '))) AS least FROM starts),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS places FROM windows WHERE least < doc_id GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w.words) AS n_words,
         list_filter(range(1, len(w.words) + 1), lambda i: g.places IS NULL OR NOT list_contains(g.places, i)) AS stay, w.words
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(stay) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(stay, lambda i: words[i]), ' ')) AS kept_sha256
FROM kept
"""
