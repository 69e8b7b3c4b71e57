"""Alignment of two tokenizers over the bytes of whole texts.

A text behind one space is encoded by a byte-level vocabulary (A) and, without the
space, which it adds itself, by a piece vocabulary (B). Two tokens of the different
vocabularies are linked if their byte ranges overlap; the components of these links are the
groups between the byte offsets where tokens of both end.

Components by pointer jumping: tokens are numbered by their end, A before B, and each
points to its farthest-right overlapping token; for an A token that is the B
token over its last byte, for a B token the A token over its last byte, or itself if that
ends there too. All pointers are replaced by their successors' pointers at once, again and
again, until none moves: each then names the terminal token of its component.

A's pattern ends a token before white space, and no piece of B goes on with a space after
another character; so tokens of both end before a space that follows another character
than white space, and a text falls into segments there. Tokens, groups and links are found once per distinct
segment, for many segments at a time. Where B has such pieces, a text is one segment.

An id pair's count, over all links of the corpus, comes in two passes. The first writes
a row per document with its segments, and for each block of about ``BLOCK_BYTES`` of
texts the distinct segments, their links and how often the block has each id pair. Pairs are summed,
the highest count of each B id is found, and the counts return to the blocks that
have the pair: a pair has one row a block at most, however frequent it is. In the second
pass each block adds up its documents' links. Nothing but the highest counts, one
row for each id of B's vocabulary, is broadcast. A task holds a block and the
segments of some blocks, at least those of one text.

Defined cases: texts that are null or empty, or whose tokens' bytes are not the space and the
text's bytes, have zeros and '' as groups; repeated rows and ids are rows of their own, a
null id too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BINARY, LONG, STRING, documents, materialise, schema, ship_package
from .packing import bytes_of_letters, is_panic
from .words import chunks

BLOCK_BYTES = 4 << 20
SEGMENTS_HELD = 200_000  # where a block begins; it adds its own
#: characters of the property White_Space, but for the space
OTHER_WHITE = "\t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = " " + OTHER_WHITE
#: parts of a text; each but the first begins with a space behind a character that is no white space
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{OTHER_WHITE}][{WHITE}]*[^{WHITE}]*)*|[{WHITE}]+")


def align(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """For tokens with ascending ends over the same bytes: the group of each A and B
    token, the B token over the last byte of each A token, the A token over that of
    each B token, and whether that one ends with it."""
    over_a, over_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    at_a = np.arange(len(end_a)) + over_a
    at_b = np.arange(len(end_b)) + np.searchsorted(end_a, end_b, side="right")
    meets = end_a[over_b] == end_b
    to = np.empty(len(end_a) + len(end_b), dtype=np.int64)
    to[at_a] = at_b[over_a]
    to[at_b] = np.where(meets, at_b, at_a[over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    group = (np.cumsum(to == np.arange(len(to))) - 1)[to]
    return group[at_a], group[at_b], over_a, over_b, meets


class Vocabularies:
    """Both encoders, the bytes of their tokens, and the tokens' numbers as text."""

    def __init__(self, byte_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = bytes_of_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.one_piece = self.fast._core_bpe.encode_single_piece
        self.whole = Tokenizer.from_file(byte_path)
        self.whole.encode_special_tokens = True
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.bytes_a[i] = word
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.piece.id_to_piece(i) for i in range(self.piece.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        falls = re.compile("▁*[^▁]*")
        self.segmented = all(falls.fullmatch(p) for i, p in enumerate(pieces) if not self.piece.is_control(i) and not self.piece.is_unknown(i))
        self.before = self.piece.encode("a")
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        texts = [b"%d%s" % (i, mark) for n, marks in ((self.size_a, (b",", b"|")), (self.size_b, (b",", b";"))) for i in range(n) for mark in marks]
        self.text = np.empty(len(texts), dtype=object)
        self.text[:] = texts
        self.text_length = np.array([len(x) for x in texts], dtype=np.int64)

    def segments(self, text: str) -> list[str]:
        """The parts of the space and the text that are encoded by themselves."""
        return SEGMENT.findall(" " + text) if self.segmented else [" " + text]

    def encode_a(self, segment: str) -> list[int]:
        if segment[0] == " " and segment[1:].isalpha():
            return self.one_piece(segment.encode())
        try:
            return self.fast.encode_ordinary(segment)
        except BaseException as e:  # a run of white space too long for the routine's pattern
            if not is_panic(e):
                raise
            return self.whole.encode(segment, add_special_tokens=False).ids

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        if not self.segmented:
            return self.piece.encode([s[1:] for s in segments], num_threads=1)
        n = len(self.before)  # of the word put before, so that a segment's white space is not the first
        return [ids[n:] if ids[:n] == self.before else [] for ids in self.piece.encode(["a" + s for s in segments], num_threads=1)]


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    if (byte_path, piece_path) not in _LOADED:
        _LOADED[byte_path, piece_path] = Vocabularies(byte_path, piece_path)
    return _LOADED[byte_path, piece_path]


def _at(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])


def _take(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs ``which`` of a flat table with bounds ``at``, and their lengths."""
    n = at[which + 1] - at[which]
    return np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


@dataclass
class Segments:
    """Distinct segments seen by a task, with their tokens aligned."""

    known: Vocabularies
    number: dict[str, int] = field(default_factory=dict)
    groups: list[bytes] = field(default_factory=list)  # as text, with ';' behind each group
    counts: list[np.ndarray] = field(default_factory=list)  # rows (n_a, n_b, n_groups, n_links, sound)
    pairs: list[np.ndarray] = field(default_factory=list)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The segments of each text; new ones are encoded and aligned together."""
        number, fresh = self.number, []
        out, first = [], len(number)
        for text in texts:
            row = []
            for s in self.known.segments(text):
                n = number.get(s)
                if n is None:
                    n = number[s] = first + len(fresh)
                    fresh.append(s)
                row.append(n)
            out.append(np.array(row, dtype=np.int64))
        if fresh:
            self._add(fresh)
        return out

    def _add(self, fresh: list[str]) -> None:
        k = self.known
        ids_a, ids_b = [k.encode_a(s) for s in fresh], k.encode_b(fresh)
        want = [s.encode() for s in fresh]
        sound = np.array([b"".join([k.bytes_a[i] for i in a]) == s and b"".join([k.bytes_b[i] for i in b]) == s
                          for a, b, s in zip(ids_a, ids_b, want, strict=True)], dtype=np.int64)
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) * sound for ids in (ids_a, ids_b))
        a, b = (np.array([i for x, good in zip(ids, sound, strict=True) if good for i in x], dtype=np.int64) for ids in (ids_a, ids_b))
        own_a, own_b = np.repeat(np.arange(len(fresh)), n_a), np.repeat(np.arange(len(fresh)), n_b)
        of_a, of_b, over_a, over_b, meets = align(np.cumsum(k.length_a[a]), np.cumsum(k.length_b[b]))
        n_groups = np.bincount(own_b[meets], minlength=len(fresh))
        # links: each A token with the B token over its last byte, each B token that ends alone with the A token over its last
        pair = np.concatenate([a * k.size_b + b[over_a], (a[over_b] * k.size_b + b)[~meets]])
        own = np.concatenate([own_a, own_b[~meets]])
        self.pairs.append(pair[np.argsort(own, kind="stable")])
        n_links = np.bincount(own, minlength=len(fresh))
        # text of the groups: A's tokens of a group, then B's
        row = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (of_a, of_b))
        row[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = 2 * a + last_a
        row[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = 2 * (k.size_a + b) + last_b
        whole = b"".join(k.text[row].tolist())
        ends = _at(k.text_length[row])[np.cumsum(n_a + n_b)].tolist()
        self.groups.extend(whole[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True))
        self.counts.append(np.stack([n_a, n_b, n_groups, n_links, sound], axis=1))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all segments, and their id pairs end to end."""
        if len(self.counts) > 1:
            self.counts, self.pairs = [np.concatenate(self.counts)], [np.concatenate(self.pairs)]
        return (self.counts[0], self.pairs[0]) if self.counts else (np.zeros((0, 5), np.int64), np.zeros(0, np.int64))


def varint(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes of seven bits, the lowest first, with a mark on all but the last of each."""
    n = np.ones(len(values), dtype=np.int64)
    for k in range(7, 63, 7):
        n += values >> k > 0
    out = np.zeros(n.sum(), dtype=np.uint8)
    at, left = np.cumsum(n) - n, values.astype(np.int64)
    while len(at):
        more = left > 127
        out[at] = (left & 127) | (more << 7)
        at, left = at[more] + 1, left[more] >> 7
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([np.zeros(1, np.int64), last[:-1] + 1]) if len(last) else last
    out, k = np.zeros(len(last), dtype=np.int64), 0
    live = np.arange(len(last))
    while len(live):
        out[live] |= (raw[first[live] + k].astype(np.int64) & 127) << (7 * k)
        k += 1
        live = live[first[live] + k <= last[live]]
    return out


class Block:
    """Documents of one block: their rows, and in the end the block's own row."""

    def __init__(self, held: Segments):
        self.held, self.name = held, uuid.uuid4().int & (1 << 63) - 1
        self.ids, self.rows, self.digests, self.bytes = [], [], [], 0

    def add(self, ids: list, texts: list[bytes | None]) -> None:
        """Rows of segment numbers; a text that is no UTF-8 is not sound."""
        plain = []
        for t in texts:
            try:
                plain.append((t or b"").decode())
            except UnicodeDecodeError:
                plain.append("")
        none = np.zeros(0, dtype=np.int64)
        full = iter(self.held.numbers([t for t in plain if t]))
        rows = [next(full) if t else none for t in plain]
        counts, _ = self.held.tables()
        groups = self.held.groups
        for row in rows:
            good = len(row) and counts[row, 4].all()
            self.rows.append(row if good else none)
            self.digests.append(hashlib.sha256(b"".join([groups[i] for i in row.tolist()])[:-1]).hexdigest() if good else "")
        self.ids.extend(ids)
        self.bytes += sum(len(t or b"") for t in texts)

    def finish(self) -> tuple[list[dict], dict]:
        """The documents' rows and the block's: its distinct id pairs with their numbers, and
        for each distinct segment, in order, the number and places of its pairs."""
        counts, pairs = self.held.tables()
        n = np.array([len(r) for r in self.rows], dtype=np.int64)
        at = _at(n)
        flat = np.concatenate(self.rows) if self.rows else np.zeros(0, np.int64)
        used, times = np.unique(flat, return_counts=True)
        local = np.searchsorted(used, flat)
        place, n_links = _take(_at(counts[:, 3]), used)
        distinct, which = np.unique(pairs[place], return_inverse=True)
        links = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(links, which, np.repeat(times, n_links))
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[flat, :4], axis=0)])
        sums = total[at[1:]] - total[at[:-1]]
        # of each document its distinct segments in order: gaps, and how often
        own = np.repeat(np.arange(len(n)), n)
        key, often = np.unique(own * np.int64(max(len(used), 1)) + local, return_counts=True)
        own, segment = np.divmod(key, max(len(used), 1))
        gap = np.diff(segment, prepend=0)
        new = np.diff(own, prepend=-1) > 0
        gap[new] = segment[new]
        ends = np.searchsorted(own, np.arange(len(n) + 1)).tolist()
        docs = [{"block": self.name, "doc_id": i, "n_a": s[0], "n_b": s[1], "n_groups": s[2], "n_links": s[3], "groups_sha256": d,
                 "gaps": varint(gap[x:y]), "often": varint(often[x:y])}
                for i, s, d, x, y in zip(self.ids, sums.tolist(), self.digests, ends[:-1], ends[1:], strict=True)]
        return docs, {"block": self.name, "gaps": varint(n_links), "often": varint(which), "pairs": distinct, "links": links}


_DOC = {"block": LONG, "doc_id": LONG, "n_a": LONG, "n_b": LONG, "n_groups": LONG, "n_links": LONG, "groups_sha256": STRING, "gaps": BINARY, "often": BINARY}


def first_pass(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of kind 0, one per document, and of kind 1, one per block."""
    out = schema(kind=LONG, **_DOC, pairs=T.ArrayType(LONG), links=T.ArrayType(LONG))
    kinds = {LONG: pa.int64(), STRING: pa.string(), BINARY: pa.binary()}

    def batch_of(rows: list[dict], kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([kind] * len(rows)), *(pa.array([r.get(f) for r in rows], kinds[t]) for f, t in _DOC.items()),
            *(pa.array([r.get(f) for r in rows], pa.list_(pa.int64())) for f in ("pairs", "links"))], out.names)

    def give(block: Block) -> Iterator[pa.RecordBatch]:
        rows, own = block.finish()
        for k in range(0, len(rows), 2000):
            yield batch_of(rows[k:k + 2000], 0)
        yield batch_of([own], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(byte_path, piece_path)
        held = Segments(known)
        block = Block(held)
        for batch in batches:
            for c in chunks(batch, "text"):
                block.add(c.column("id").to_pylist(), c.column("text").to_pylist())
                if block.bytes >= block_bytes:
                    yield from give(block)
                    held = held if len(held.number) <= SEGMENTS_HELD else Segments(known)
                    block = Block(held)
        if block.ids:
            yield from give(block)

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, out)


def _second_pass(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with the counts of their links added up."""
    kind = left.column("kind").to_numpy()
    own = left.filter(pa.array(kind == 1))
    docs = left.filter(pa.array(kind == 0))
    right = right.sort_by("pair")
    # the block's pairs are distinct and ascending, as are the rows that came back
    count, best = right.column("total").to_numpy(), right.column("best").to_numpy()
    n_links, place = unvarint(own.column("gaps")[0].as_py()), unvarint(own.column("often")[0].as_py())
    sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x[place])]) for x in (best, count)]
    at = _at(n_links)
    per_segment = [s[at[1:]] - s[at[:-1]] for s in sums]
    gaps, often = docs.column("gaps").to_pylist(), docs.column("often").to_pylist()
    out = []
    for g, o in zip(gaps, often, strict=True):
        segment, times = np.cumsum(unvarint(g)), unvarint(o)
        out.append([int((x[segment] * times).sum()) for x in per_segment] if len(segment) else [0, 0])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.Table.from_arrays(
        [*(docs.column(c) for c in names), *(pa.array([r[k] for r in out], pa.int64()) for k in range(2)), docs.column("groups_sha256")],
        [*names, "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None,
                     piece_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """A row per document (``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``), and the table of linked ids (``a``, ``b``, ``total``, ``best``): an embedding of a B
    id can be begun from its best A ids."""
    import public_tokenizers
    byte_path = byte_path or public_tokenizers.path("byte_bpe_50k.json")
    piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    ship_package(docs.sparkSession)
    import sentencepiece
    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    parts, _ = materialise(first_pass(docs, id_col, text_col, byte_path, piece_path, block_bytes), "aligned", "kind")
    pairs = parts.where("kind = 1").select("block", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
    totals, _ = materialise(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    b = F.col("pair") % size_b
    # one row for each id of the vocabulary at most
    most = F.broadcast(totals.groupBy(b.alias("_b")).agg(F.max("total").alias("_most")))
    counted = totals.join(most, b == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_most")).cast("long").alias("best"))
    back = pairs.select("block", "pair").join(counted, "pair").select(F.col("block").alias("to"), "pair", "total", "best")
    out = schema(doc_id=LONG, n_a=LONG, n_b=LONG, n_groups=LONG, n_links=LONG, n_best=LONG, count_sum=LONG, groups_sha256=STRING)
    left = parts.select("kind", *_DOC)
    rows = left.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_second_pass, out)
    links = counted.select(((F.col("pair") - b) / size_b).cast("long").alias("a"), b.alias("b"), "total", "best")
    return rows.withColumnRenamed("doc_id", id_col), links


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both public vocabularies aligned over all documents."""
    return align_tokenizers(documents(spark, sf_dir))[0]
