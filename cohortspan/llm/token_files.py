"""Token ids in compressed files: an adaptive context-mixing range coder over independent blocks.

A file is Parquet whose rows are records: whole documents, their ids cut into blocks of at most ``BLOCK``. A block
is coded by itself from reset state and carries a checksum, so damage stays in it and any record can be read alone.

The coder predicts each id in three ways: the id that last followed the two ids before it (order 2), the one that
last followed the id before it (order 1), and how ids spread over classes of like rank (order 0, a table in the
block's head). How often orders 2 and 1 were right, at each degree of confidence, is learned while coding;
their shares of the probability are mixed from that, and order 0 gets the rest. The mix drives a 64-bit range coder
that emits 32-bit words. All arithmetic is on integers, so every machine decodes alike.

Blocks of a task are coded in lockstep: each step codes one id of every block with NumPy. Spark deals documents
into ranges of doc_id, so that files hold them in ascending order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import Numbered, ordered_cells, partitions
from cohortspan.sources.staging import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: Ids of a block; ids from which a record is closed; ids a task codes at once.
BLOCK, RECORD, AT_ONCE = 1024, 1 << 16, 1 << 22
#: Words a task remembers the ids of.
REMEMBERED = 900_000
MAGIC = b"CMR1"

# --- order-0 classes: ids of like rank, of 2 ** bits ids each, four to each doubling ---


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, bits, at = [], [], 0
    while at < 1 << 16:
        width = max(0, (at + 4).bit_length() - 3)
        first.append(at)
        bits.append(width)
        at += 1 << width
    of = np.zeros(1 << 16, np.uint8)
    for i, start in enumerate(first):
        of[start : start + (1 << bits[i])] = i
    return np.array(first, np.int32), np.array(bits, np.int32), of


FIRST, BITS, CLASS_OF = _classes()
CLASSES = len(FIRST)
SCALE, SHARE = 16, 12  # bits of the whole probability, and of the order-0 table
LEVELS = 8  # degrees of confidence
MOST, LEAST_ORDER0 = 60_000, (1 << SCALE) - (1 << SHARE) - 16  # what order 2 gets at most; what is left for order 0
LEARN = 4  # the mix is learned from each fourth id
SLOTS = 10  # bits of a context's slot


def _tables(counts: np.ndarray) -> np.ndarray:
    """Cumulated order-0 shares of each block (one row) from counts of 0 to 255 for each class; all classes get some."""
    weights = counts.astype(np.int64) * 16 + 1
    reached = np.cumsum(weights, axis=1)
    cumulated = reached * ((1 << SHARE) - CLASSES) // reached[:, -1:] + np.arange(1, CLASSES + 1)
    return np.concatenate((np.zeros((len(counts), 1), np.int64), cumulated), axis=1)


class _Model:
    """What all blocks have learned so far, and the mix for their next id."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int32)
        self.follow1 = np.zeros(lanes << SLOTS, np.int32)  # id << 3 | confidence
        self.follow2 = np.zeros(lanes << SLOTS, np.int32)
        start = np.tile(np.linspace(2000, 30000, LEVELS).astype(np.int32), lanes)
        self.right1, self.right2 = start.copy(), start.copy()
        self.last = self.before = np.zeros(lanes, np.int32)
        self.base, self.level = self.lane << SLOTS, self.lane * LEVELS

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predicted ids of order 2 and 1, and their shares of 2 ** SCALE."""
        mask = (1 << SLOTS) - 1
        mixed = self.last * 40503
        self.at1 = self.base + (mixed >> 5 & mask)
        self.at2 = self.base + ((mixed ^ self.before * 28411) >> 4 & mask)
        s1, s2 = self.follow1.take(self.at1), self.follow2.take(self.at2)
        self.c1, self.c2 = s1 & 7, s2 & 7
        self.i1, self.i2 = s1 >> 3, s2 >> 3
        self.r1, self.r2 = self.level + self.c1, self.level + self.c2
        self.p1, self.p2 = self.right1.take(self.r1), self.right2.take(self.r2)
        f2 = self.p2 + 1
        f1 = ((LEAST_ORDER0 - f2) * (self.p1 >> 4) >> 12) + 1
        f1[self.i1 == self.i2] = 1
        return self.i2, self.i1, f2, f1

    def update(self, ids: np.ndarray, step: int, hit1: np.ndarray, hit2: np.ndarray) -> None:
        for follow, at, c, i, right, r, p, hit in (
            (self.follow1, self.at1, self.c1, self.i1, self.right1, self.r1, self.p1, hit1),
            (self.follow2, self.at2, self.c2, self.i2, self.right2, self.r2, self.p2, hit2),
        ):
            if step % LEARN == 0:
                right[r] = p + ((hit * np.int32(MOST) - p) >> 3)
            kept = np.where(hit | (c > 1), i, ids)
            follow[at] = kept << 3 | np.where(hit, np.minimum(c + 1, LEVELS - 1), c >> 1)
        self.before, self.last = self.last, ids

    def keep(self, n: int) -> None:
        """Only the first ``n`` blocks go on."""
        self.last, self.before, self.base, self.level = self.last[:n], self.before[:n], self.base[:n], self.level[:n]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of 1 to ``BLOCK`` ids below 65,536 as bytes: head, order-0 table and coded words."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    lanes, steps = len(blocks), int(sizes[0])
    ids = np.zeros((steps, lanes), np.int32)
    for lane, i in enumerate(order):
        ids[: sizes[lane], lane] = blocks[i]
    counts = np.zeros((lanes, CLASSES), np.int64)
    for lane, i in enumerate(order):
        counts[lane] = np.bincount(CLASS_OF[blocks[i]], minlength=CLASSES)
    counts = (counts * 255 // counts.max(axis=1, keepdims=True)).astype(np.uint8)
    shares = _tables(counts)
    flat, width = shares.ravel().astype(np.int32), shares.shape[1]
    words = np.zeros((lanes, steps + 4), np.uint32)
    place = np.zeros(lanes, np.int64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    model, lane = _Model(lanes), np.arange(lanes, dtype=np.int32)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")
    for step in range(steps):
        n = live[step]
        if n < len(model.last):
            model.keep(n)
        here, x = lane[:n], ids[step, :n]
        i2, i1, f2, f1 = model.predict()
        kind = CLASS_OF.take(x)
        f0 = (1 << SCALE) - f2 - f1
        at = here * width + kind
        begin, end = flat.take(at) * f0 >> SHARE, flat.take(at + 1) * f0 >> SHARE
        cum, freq = f2 + f1 + begin, end - begin
        hit1, hit2 = x == i1, x == i2
        miss = ~(hit1 | hit2)
        cum, freq = np.where(hit1, f2, cum), np.where(hit1, f1, freq)
        cum, freq = np.where(hit2, 0, cum), np.where(hit2, f2, freq)
        rest = BITS.take(kind) * miss
        offset = (x - FIRST.take(kind)) * miss
        old = low[:n]
        r = rng[:n] >> np.uint64(SCALE)
        new = old + r * cum.astype(np.uint64)
        r = r * freq.astype(np.uint64) >> rest.astype(np.uint64)
        new2 = new + r * offset.astype(np.uint64)
        for i in np.flatnonzero(new2 < old):
            at = place[i] - 1
            while words[i, at] == 0xFFFFFFFF:
                words[i, at] = 0
                at -= 1
            words[i, at] += 1
        out = np.flatnonzero(r < np.uint64(1 << 32))
        words[out, place[out]] = (new2[out] >> np.uint64(32)).astype(np.uint32)
        place[out] += 1
        new2[out] <<= np.uint64(32)
        r[out] <<= np.uint64(32)
        low[:n], rng[:n] = new2, r
        model.update(x, step, hit1, hit2)
    coded: list[bytes] = [b""] * lanes
    for k, i in enumerate(order):
        tail = np.array([low[k] >> np.uint64(32), low[k] & np.uint64(0xFFFFFFFF)], np.uint32)
        body = counts[k].tobytes() + words[k, : place[k]].astype("<u4").tobytes() + tail.astype("<u4").tobytes()
        head = struct.pack("<III", len(blocks[i]), len(body), zlib.crc32(blocks[i].astype("<u4").tobytes()))
        coded[i] = head + body
    return coded


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ``ValueError`` if a block's ids do not have its checksum."""
    if not coded:
        return []
    heads = [struct.unpack_from("<III", c) for c in coded]
    order = sorted(range(len(coded)), key=lambda i: -heads[i][0])
    sizes = np.array([heads[i][0] for i in order])
    lanes, steps = len(coded), int(sizes[0])
    counts = np.array([np.frombuffer(coded[i], np.uint8, CLASSES, 12) for i in order])
    shares = _tables(counts)
    flat, width = shares.ravel().astype(np.int32), shares.shape[1]
    classes = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), lanes), np.diff(shares, axis=1).ravel())
    bodies = [np.frombuffer(coded[i][12 + CLASSES :], "<u4") for i in order]
    words = np.zeros((lanes, max(map(len, bodies)) + 2), np.uint64)
    for k, body in enumerate(bodies):
        words[k, : len(body)] = body
    place = np.full(lanes, 2, np.int64)
    code, rng = words[:, 0] << np.uint64(32) | words[:, 1], np.full(lanes, (1 << 64) - 1, np.uint64)
    ids = np.zeros((steps, lanes), np.int32)
    model, lane = _Model(lanes), np.arange(lanes, dtype=np.int32)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")
    last_word = words.shape[1] - 1
    for step in range(steps):
        n = live[step]
        if n < len(model.last):
            model.keep(n)
        here = lane[:n]
        i2, i1, f2, f1 = model.predict()
        f0 = (1 << SCALE) - f2 - f1
        r, d = rng[:n] >> np.uint64(SCALE), code[:n]
        v = np.minimum(d // r, np.uint64((1 << SCALE) - 1)).astype(np.int32)
        hit2, hit1 = v < f2, v < f2 + f1
        below = np.maximum(v - f2 - f1, 0)
        share = np.minimum((((below + 1) << SHARE) - 1) // f0, (1 << SHARE) - 1)
        kind = classes.take((here << SHARE) + share)
        at = here * width + kind
        begin, end = flat.take(at) * f0 >> SHARE, flat.take(at + 1) * f0 >> SHARE
        cum, freq = np.where(hit1, f2, f2 + f1 + begin), np.where(hit1, f1, end - begin)
        cum, freq = np.where(hit2, 0, cum), np.where(hit2, f2, freq)
        rest = BITS.take(kind) * ~hit1
        d = d - r * cum.astype(np.uint64)
        r = r * freq.astype(np.uint64) >> rest.astype(np.uint64)
        offset = np.minimum(d // np.maximum(r, np.uint64(1)), ((1 << rest) - 1).astype(np.uint64)).astype(np.int32)
        d = d - r * offset.astype(np.uint64)
        x = np.where(hit2, i2, np.where(hit1, i1, np.minimum(FIRST.take(kind) + offset, (1 << 16) - 1)))
        more = np.flatnonzero(r < np.uint64(1 << 32))
        d[more] = d[more] << np.uint64(32) | words[more, np.minimum(place[more], last_word)]
        r[more] <<= np.uint64(32)
        place[more] += 1
        code[:n], rng[:n] = d, r
        ids[step, :n] = x
        model.update(x, step, x == i1, x == i2)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for k, i in enumerate(order):
        out[i] = ids[: sizes[k], k].copy()
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][2]:
            raise ValueError("a block does not have the ids it was written with")
    return out


# --- records ---


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]


def pack_records(records: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Records of (doc_ids, ids per document, all ids) as bytes, their blocks coded together."""
    blocks = [_blocks(ids) for _, _, ids in records]
    coded = iter(encode_blocks([b for part in blocks for b in part]) if any(blocks) else [])
    out = []
    for (docs, sizes, _), part in zip(records, blocks):
        directory = docs.astype("<i8").tobytes() + sizes.astype("<u4").tobytes()
        head = MAGIC + struct.pack("<III", len(docs), len(part), zlib.crc32(directory))
        out.append(b"".join([head, directory, *(next(coded) for _ in part)]))
    return out


def unpack_records(records: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    opened, coded = [], []
    for record in records:
        docs, blocks, crc = struct.unpack_from("<III", record, 4)
        directory, at = record[16 : 16 + 12 * docs], 16 + 12 * docs
        if record[:4] != MAGIC or zlib.crc32(directory) != crc:
            raise ValueError("not a record, or its directory is damaged")
        for _ in range(blocks):
            size = 12 + struct.unpack_from("<III", record, at)[1]
            coded.append(record[at : at + size])
            at += size
        opened.append((np.frombuffer(directory, "<i8", docs), np.frombuffer(directory, "<u4", docs, 8 * docs).astype(np.int64), blocks))
    ids = iter(decode_blocks(coded))
    return [(docs, sizes, np.concatenate([np.zeros(0, np.int64), *(next(ids) for _ in range(n))])) for docs, sizes, n in opened]


# --- texts to ids ---

# The signs by which byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(sorted({*range(0x100)} - {*_PRINTABLE}))}
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each different word.

    The tokenizer starts a new piece at each single space between words and on both sides of a single line end, so
    the ids of a text are those of its words, each with the space before it, one after the other. Runs of white
    space and other white space stay within a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(self.tokenizer.to_str())
        if kind["normalizer"] or kind["post_processor"] or kind["pre_tokenizer"]["type"] != "ByteLevel" or kind["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level tokenizers start anew at each word")
        # A special string in a text is found before anything else, so such a text is encoded as a whole.
        self.path, self.whole = path, None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stops = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,"}
        self.known = Numbered()
        self.starts = self.sizes = self.flat = np.zeros(0, np.int64)

    @staticmethod
    def _words(text: str) -> list[str]:
        """Keys of a text's words: two spaces before a text's first, one before those with odd white space."""
        words = text.replace("\n", " ").split(" ")
        if words == text.split():
            words = text.replace("\n", " \n").split(" ")
            words[0] = "  " + words[0]
            return words
        parts = _SINGLE_SPACE.split(text)
        return ["  " + parts[0], *(" " + p for p in parts[1:])]

    @staticmethod
    def _spelled(key: str) -> str:
        return key[2:] if key.startswith("  ") else key if key[:1] in (" ", "\n") else " " + key

    def _learn(self, new: list[str]) -> None:
        """Ids of words that ``known`` has numbered but that have none yet. A last stop or comma is a piece of its own."""
        done, learned = len(self.starts), self.known
        bare = {k: k[:-1] for k in new if k[-1] in ".," and k[:-1].isalpha()}
        asked = {k for k in new if k not in bare} | {b for b in bare.values() if learned.get(b, done) >= done}
        asked = list(asked)
        # A run of letters is one piece for the merges, spelled in the tokenizer's signs for bytes.
        merge, signs = self.tokenizer.model.tokenize, _BYTE_SIGNS
        found = {k: [t.id for t in merge((" " + k).encode().decode("latin-1").translate(signs))] for k in asked if k.isalpha()}
        others = [k for k in asked if not k.isalpha()]
        pieces = self.tokenizer.encode_batch_fast([self._spelled(k) for k in others], add_special_tokens=False)
        found.update(zip(others, (e.ids for e in pieces)))
        flat, sizes = [], []
        for k in new:
            b = bare.get(k, k)
            ids = found.get(b)
            if ids is None:
                at = learned[b]
                ids = self.flat[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()
            flat += ids
            if k in bare:
                flat.append(self.stops[k[-1]])
            sizes.append(len(ids) + (k in bare))
        sizes = np.array(sizes, np.int64)
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.starts, self.sizes = np.concatenate((self.starts, begin)), np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.array(flat, np.int64)))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, special strings being what the library takes them for by default."""
        if texts and self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return [np.array(e.ids, np.int64) for e in self.whole.encode_batch(texts, add_special_tokens=False)] if texts else []

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special = [i for i, t in enumerate(texts) if t and any(s in t for s in self.special)]
        found = dict(zip(special, self._encoded([texts[i] for i in special])))
        split = [self._words(t) if t and i not in found else [] for i, t in enumerate(texts)]
        if len(self.known) > REMEMBERED:
            # What this batch uses again stays, and with it the common words.
            kept = list({w for words in split for w in words if w in self.known})
            at = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
            self.known = Numbered(zip(kept, range(len(kept))))
            sizes, ends = self.sizes[at], np.cumsum(self.sizes[at])
            self.flat = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
            self.starts, self.sizes = ends - sizes, sizes
        places = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in split]
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        out = []
        for i, at in enumerate(places):
            if i in found:
                out.append(found[i])
                continue
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.starts[at] - ends + sizes, sizes)
            out.append(self.flat[shift + np.arange(len(shift))])
        return out


_encoders: dict[str, WordEncoder] = {}
_NO_ID = -(2**63)


def write_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, cells: int | None = None) -> str:
    """Write the ids of all documents, each followed by ``end``, and return the folder of the files.

    Files go to the shared folder. Columns: cell and seq give the order of records, tokens their number of ids.
    A null text has no ids but the end. Equal doc_ids follow each other by their text; a null doc_id comes first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    celled, _ = ordered_cells(rows, "doc_id", cells or 4 * partitions(docs))
    dealt = celled.repartition(partitions(docs), "cell").sortWithinPartitions("cell", F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        held: list[tuple[int, int, list, list]] = []  # cell, seq, doc_ids, ids of each document
        size, tokens = 0, 0

        def records() -> pd.DataFrame:
            raw = [(np.array(d, np.int64), np.array([len(x) for x in ids], np.int64), np.concatenate(ids)) for _, _, d, ids in held]
            frame = pd.DataFrame(
                {"cell": [h[0] for h in held], "seq": [h[1] for h in held], "tokens": [len(r[2]) for r in raw], "record": pack_records(raw)}
            )
            held.clear()
            return frame

        cell, seq = None, 0
        for batch in batches:
            at = 0
            texts, places = batch["text"].tolist(), batch["cell"].tolist()
            doc_ids = [_NO_ID if pd.isna(d) else int(d) for d in batch["doc_id"]]
            while at < len(texts):
                # About a million characters at a time bound what the words and ids take.
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= 1 << 20):
                    chars += len(texts[to])
                    to += 1
                for k, ids in enumerate(encoder(texts[at:to]), start=at):
                    ids = np.append(ids, end)
                    if places[k] != cell:
                        cell, seq, size = places[k], 0, 0
                        fresh = True
                    else:
                        fresh = size >= RECORD
                    if fresh:
                        if tokens >= AT_ONCE:
                            yield records()
                            tokens = 0
                        held.append((cell, seq, [], []))
                        seq, size = seq + 1, 0
                    held[-1][2].append(doc_ids[k])
                    held[-1][3].append(ids)
                    size += len(ids)
                    tokens += len(ids)
                at = to
        if held:
            yield records()

    path = f"{shared_dir(docs.sparkSession)}/{docs.sparkSession.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    coded = dealt.select("doc_id", "text", "cell").mapInPandas(encode, "cell int, seq int, tokens long, record binary")
    coded.write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files, with its ids if asked for."""
    files = spark.read.parquet(path)
    per_cell = files.groupBy("cell").agg(F.sum("tokens").alias("n"))
    before = "coalesce(sum({}) OVER ({} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    # One row a range of ids, of which there are a few for each partition.
    cells = per_cell.selectExpr("cell", before.format("n", "", "cell") + " AS cell_start")
    starts = files.selectExpr("cell", "seq", before.format("tokens", "PARTITION BY cell", "seq") + " AS within").join(cells, "cell")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, tokens = 0, batch["tokens"].tolist()
            while at < len(batch):
                to, size = at, 0
                while to < len(batch) and (to == at or size + tokens[to] <= AT_ONCE):
                    size += tokens[to]
                    to += 1
                rows = []
                for k, (docs, sizes, ids) in enumerate(unpack_records(batch["record"].iloc[at:to].tolist()), start=at):
                    ends = np.cumsum(sizes)
                    for d, n, e in zip(docs.tolist(), sizes.tolist(), ends.tolist()):
                        own = ids[e - n : e]
                        row = (batch["cell"].iloc[k], batch["seq"].iloc[k], None if d == _NO_ID else d, e - n, n, zlib.crc32(own.astype("<u4").tobytes()))
                        rows.append((*row, own.astype("int32")) if with_ids else row)
                names = ["cell", "seq", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                at = to

    schema = "cell int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decoded = files.mapInPandas(decode, schema)
    placed = decoded.join(starts, ["cell", "seq"])
    columns = ["doc_id", (F.col("cell_start") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return placed.select(*columns, *["ids"] * with_ids)
