"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units, a run of letters and digits or of other characters with the space before it. Each
different unit is segmented once: its substrings of bounded length are exploded and equi-joined to the piece
table, the matches are grouped by unit, and a higher-order aggregate folds them from left to right into the
best path (Viterbi). What a segmentation is worth is the sum of its pieces' scores.

A unit longer than usual is cut where no piece can lie across the cut, which leaves its best path as it is; what is still
longer then, such as a rule of thousands of equal signs, is folded where it lies.

Documents do not move by word. A cell is a run of documents that lie together; it sends each different unit to
the lattice once, gets its ids back, and is put together again with its compressed texts. As every space begins a
unit, what lies between two spaces is looked at once for as long as a task remembers it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import partitions
from cohortspan.llm.languages import batched

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Characters of a unit that goes through the lattice at most, once cut where no piece lies. Characters of the texts of a cell, about.
LONGEST, CELL = 64, 40_000_000
#: Units that a task passes on at once, and long paths it remembers.
ROWS, LONG_PATHS = 20_000, 1_000
#: Characters of text that are compressed together, units of a cell that a task remembers having sent, and words.
PACKED, SENT, WORDS = 1_000_000, 600_000, 300_000
#: Units that a task deals out to cells at once, counted once for each cell.
DEALT = 300_000
#: Partitions of units for each one of the session's: a unit makes some fifty rows.
FINER = 8
#: A piece's score is its own less this: of two segmentations the one of fewer pieces is better, then the one of
#: better pieces. This is how merging mostly ends; sums of bare merge ranks would avoid long pieces.
PER_PIECE = 1_000_000.0
#: Bytes that stand for a character without a piece cost this much more each.
PER_BYTE = 10_000_000.0

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGESTED = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_pieces", "ids_crc32", "text_crc32")])
_UNIT = re.compile(rf"{SPACE}?[^\W_]+|{SPACE}?(?:[^\w{SPACE}]|_)+|{SPACE}")


class LongUnits:
    """What is done with units of more than ``LONGEST`` characters, by all occurrences of pieces in them."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton, self.byte_zero = ahocorasick.Automaton(), first_byte(path)
        for piece, i, score in _pieces(model):
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.paths: dict[str, bytes] = {}

    def cut(self, unit: str) -> list[str]:
        """The unit cut at every place that no piece lies across."""
        spanned = np.zeros(len(unit) + 1, np.int64)
        for end, (size, _, _) in self.automaton.iter(unit):
            spanned[end - size + 2] += 1
            spanned[end + 1] -= 1
        places = np.flatnonzero(np.cumsum(spanned)[1 : len(unit)] == 0) + 1
        return [unit[a:b] for a, b in zip([0, *places], [*places, len(unit)])]

    def ids(self, unit: str) -> bytes:
        """Ids of the best path, folded as the lattice is."""
        if unit not in self.paths:
            if len(self.paths) >= LONG_PATHS:
                self.paths.clear()
            ending: dict[int, list] = {}
            for end, (size, i, score) in self.automaton.iter(unit):
                ending.setdefault(end + 1, []).append((end + 1 - size, i, score))
            reached: list[tuple[float, int, int | None]] = [(0.0, 0, None)]
            for node in range(1, len(unit) + 1):
                edges = ending.get(node, [])
                if not any(start == node - 1 for start, _, _ in edges):
                    edges = [*edges, (node - 1, None, -PER_BYTE * len(unit[node - 1].encode()))]
                reached.append(max((reached[start][0] + score, start, i) for start, i, score in edges))
            out, at = [], len(unit)
            while at:
                _, start, i = reached[at]
                spelled = [self.byte_zero + b for b in unit[start:at].encode()] if i is None else [i]
                out += spelled[::-1]
                at = start
            self.paths[unit] = np.array(out[::-1], "<i4").tobytes()
        return self.paths[unit]


_long_units: dict[str, LongUnits] = {}


def long_units(path: str) -> LongUnits:
    if path not in _long_units:
        _long_units[path] = LongUnits(path)
    return _long_units[path]


def _words(text: str) -> list[str]:
    """What lies between the spaces of a text, whose units are those of these words."""
    return text.replace(SPACE, " ").split(" ")


def _units(words: Iterable[str], path: str) -> list[str]:
    """The units of words, each of which has a space before it."""
    units = _UNIT.findall("".join([SPACE + w for w in words]))
    if max(map(len, units), default=0) <= LONGEST:
        return units
    return [part for u in units for part in (long_units(path).cut(u) if len(u) > LONGEST else [u])]


def units_of(text: str | None, path: str = MODEL) -> list[str]:
    """The units of a text, which joined give it back, spaces marked and one put before it."""
    return _units(_words(text), path) if text else []


def _pieces(model: sentencepiece.SentencePieceProcessor) -> list[tuple[str, int, float]]:
    return [
        (model.id_to_piece(i), i, model.get_score(i) - PER_PIECE)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]


def piece_table(spark: SparkSession, path: str = MODEL) -> DataFrame:
    """(piece, id, score) of the pieces that text can have. Its size is that of the vocabulary file."""
    rows = _pieces(sentencepiece.SentencePieceProcessor(model_file=path))
    return spark.createDataFrame(rows, "piece string, id int, score double")


def first_byte(path: str = MODEL) -> int:
    """Id of byte 0; the other bytes follow."""
    return sentencepiece.SentencePieceProcessor(model_file=path).piece_to_id("<0x00>")


def segment(units: DataFrame, pieces: DataFrame, byte_zero: int, most: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``units`` (unit, and columns ``also``) with ``ids``, the best path's.

    Of equal paths to a place the one whose last piece is shorter wins. Pieces have at most ``most`` characters.
    A character without a piece of its own can be spelled in bytes.
    """
    # Rows of a unit are told apart by a number, which is compared before the unit is.
    keys = ["number", "unit", *also]
    units = units.select(F.monotonically_increasing_id().alias("number"), "unit", *also)
    starts = units.select(*keys, F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(most), F.length("unit") - F.col("start") + 1))
    spans = starts.select(*keys, "start", F.explode(lengths).alias("size"))
    spans = spans.select(*keys, "start", "size", F.substring("unit", F.col("start"), F.col("size")).alias("piece"))
    # The vocabulary is fixed, some ten thousand short strings, so it is sent everywhere.
    edges = (
        spans.join(F.broadcast(pieces), "piece", "left")
        .where("id IS NOT NULL OR size = 1")
        .selectExpr(
            "number",
            "unit",
            # On one row of each unit, that of its first character.
            *[f"if(start = 1 AND size = 1, {c}, NULL) AS {c}" for c in also],
            "start - 1 AS start",
            "start + size - 1 AS end",
            "id",
            f"coalesce(score, -{PER_BYTE}D * octet_length(piece)) AS score",
        )
    )
    carried = [F.first(c, ignorenulls=True).alias(c) for c in also]
    lattice = edges.groupBy("number", "unit").agg(F.collect_list(F.struct("end", "start", "id", "score")).alias("edges"), *carried)
    keys = ["unit", *also]
    # For each place from left to right the best way to it, and where that comes from; then back from the end. Edges are
    # in the order of their ends, and each place has one, that of the character before it.
    way = "named_struct('score', reached[e.start].score + e.score, 'start', e.start, 'id', e.id)"
    reached = f"""
        aggregate(
            sort_array(edges),
            array(named_struct('score', 0D, 'start', 0, 'id', cast(NULL AS int))),
            (reached, e) -> CASE
                WHEN size(reached) = e.end THEN concat(reached, array({way}))
                WHEN reached[e.start].score + e.score >= reached[e.end].score AND {way} > reached[e.end] THEN concat(slice(reached, 1, e.end), array({way}))
                ELSE reached
            END
        )"""
    spelled = "hex(encode(substring(unit, way.at, 1), 'UTF-8'))"
    spelled = f"transform(sequence(1, length({spelled}), 2), i -> int(conv(substring({spelled}, i, 2), 16, 10)) + {byte_zero})"
    path = f"""
        aggregate(
            sequence(1, length(unit)),
            named_struct('at', length(unit), 'ids', cast(array() AS array<int>)),
            (way, step) -> if(way.at = 0, way, named_struct(
                'at', reached[way.at].start,
                'ids', concat(if(reached[way.at].id IS NULL, {spelled}, array(reached[way.at].id)), way.ids)
            )),
            way -> way.ids
        )"""
    return lattice.select(*keys, F.expr(reached).alias("reached")).select(*keys, F.expr(path).alias("ids"))


def _cell(docs: DataFrame) -> DataFrame:
    """doc_id, text and cell: documents of one split of a file, dealt by doc_id among cells of bounded size."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"),
    )
    sizes = rows.groupBy("split").agg(F.sum(F.length("text")).alias("chars"))
    sizes = sizes.agg(F.max("chars").alias("most")).first()
    ways = 1 + (sizes["most"] or 0) // CELL
    return rows.select("doc_id", "text", F.xxhash64("split", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ways))).alias("cell"))


def _units_by_cell(path: str):
    """The different units of each cell, whose rows come together; one at a time is remembered."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, words = None, set(), set()
        cells, units = [], []
        for batch in batches:
            for cell, text in zip(batch["cell"], batch["text"]):
                if cell != at:
                    at, known, words = cell, set(), set()
                new = set(_words(text)).difference(words) if text else set()
                if len(words) > WORDS:
                    words.clear()
                words.update(w for w in new if len(w) <= LONGEST)
                fresh = set(_units(new, path)).difference(known)
                known |= fresh
                short = [u for u in fresh if len(u) <= LONGEST]
                cells += [cell] * len(short)
                units += short
                if len(units) > ROWS:
                    yield pd.DataFrame({"cell": cells, "unit": units})
                    cells, units = [], []
                    if len(known) > SENT:
                        known.clear()  # some units are then sent twice
        if units:
            yield pd.DataFrame({"cell": cells, "unit": units})

    return work


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of documents of one cell, their ids and compressed texts in a row."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for cell, rows in batch.groupby("cell", sort=False):
            at = 0
            for part in batched(rows["text"].tolist(), PACKED):
                own = rows["doc_id"].iloc[at : at + len(part)]
                ids = [None if pd.isna(d) else int(d) for d in own]
                yield pd.DataFrame({"cell": [cell], "doc_ids": [ids], "texts": [pack.compress(json.dumps(part).encode())]})
                at += len(part)


class CellIds:
    """Ids of the texts of a cell from those of its units, which are held as arrays and found by their hashes.

    A unit that is looked up is one of the cell's, so hashes need only tell these apart.
    """

    def __init__(self, rows: Iterable[tuple[bytes, bytes]], path: str):
        """``rows`` are units and their ids as ``_by_cell`` packs them."""
        self.path, self.spelled = path, {}
        rows, unpack = list(rows), zstandard.ZstdDecompressor().decompress
        for self.salt in count():
            hashes, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for names, found in rows:
                names, ids = zip(*_unfold(json.loads(unpack(names)), unpack(found)))
                hashes.append(self._hashes(names))
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
                flat.append(b"".join(ids))
            hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break
        self.starts, self.sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        self.flat = np.frombuffer(b"".join(flat), "<i4")

    def _hashes(self, units: Sequence[str]) -> np.ndarray:
        units = [(self.salt, u) for u in units] if self.salt else units
        return np.fromiter(map(hash, units), np.int64, len(units))

    def _of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units of usual length, and where each unit's end."""
        at = np.searchsorted(self.hashes, self._hashes(units))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))], ends

    def _learn(self, words: list[str]) -> None:
        """Spell words shorter than ``LONGEST``. A unit that begins with a space begins a word."""
        units = _units(words, self.path)
        ids, ends = self._of_units(units)
        last = np.array([u[0] == SPACE for u in units[1:]] + [True])
        data, ends = ids.tobytes(), (4 * ends[last]).tolist()
        self.spelled.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends)]))

    def _long(self, word: str) -> bytes:
        parts = [long_units(self.path).ids(u) if len(u) > LONGEST else self._of_units([u])[0].tobytes() for u in _units([word], self.path)]
        return b"".join(parts)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [_words(t) if t else [] for t in texts]
        if len(self.spelled) > WORDS:
            # What these texts use again stays, and with it the common words.
            self.spelled = {w: self.spelled[w] for w in set().union(*split) & self.spelled.keys()}
        new = set().union(*split).difference(self.spelled)
        if short := [w for w in new if len(w) < LONGEST]:
            self._learn(short)
        long = {w: self._long(w) for w in new if len(w) >= LONGEST}
        known = self.spelled | long if long else self.spelled
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _assemble(path: str, digested: bool):
    def work(docs: pa.Table, units: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        ids_of = CellIds(zip(units["units"].to_pylist(), units["ids"].to_pylist()), path)
        made = digester(path) if digested else lambda batch: batch
        parts = []
        for own, packed in zip(docs["doc_ids"], docs["texts"]):
            ids = ids_of(json.loads(unpack(packed.as_py())))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            parts.append(made(pa.record_batch([own.values, lists], schema=_ENCODED)))
        return pa.Table.from_batches(parts, _DIGESTED if digested else _ENCODED)

    return work


def encode(docs: DataFrame, path: str = MODEL, digested: bool = False) -> DataFrame:
    """doc_id and ids of every row. A null or empty text has no ids. Repeated rows are encoded each.

    If ``digested``, what ``digests`` makes of these rows, made where they are: ids are then not passed on.

    A space before the text is added, as SentencePiece does; a U+2581 in a text is taken for a space.
    """
    spark = docs.sparkSession
    pieces = piece_table(spark, path)
    most = pieces.agg(F.max(F.length("piece"))).first()[0]
    celled = _cell(docs)
    sent = celled.sortWithinPartitions("cell").mapInPandas(_units_by_cell(path), "cell long, unit string")
    # As many cells at most as hold a unit; a common unit is in each once.
    units = sent.repartition(FINER * partitions(docs), "unit").groupBy("unit").agg(F.collect_set("cell").alias("cells"))
    found = segment(units, pieces, first_byte(path), most, ("cells",))
    found = found.select("unit", "cells", "ids").mapInPandas(_by_cell, "cell long, units binary, ids binary")
    packed = celled.mapInPandas(_packed, "cell long, doc_ids array<long>, texts binary")
    columns = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long" if digested else "doc_id long, ids array<int>"
    return packed.groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(_assemble(path, digested), columns)


def _by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segmented units dealt out to their cells: for each cell a row of many units, compressed, with their ids."""
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        held: dict[int, list[int]] = {}
        names, ids, n = batch["unit"].tolist(), [np.asarray(x, "<i4").tobytes() for x in batch["ids"]], 0

        def rows() -> pd.DataFrame:
            packed = [(json.dumps([names[i] for i in own]), _fold([ids[i] for i in own])) for own in held.values()]
            out = pd.DataFrame(
                {"cell": list(held), "units": [pack.compress(u.encode()) for u, _ in packed], "ids": [pack.compress(x) for _, x in packed]}
            )
            held.clear()
            return out

        for i, cells in enumerate(batch["cells"]):
            for cell in cells.tolist():
                held.setdefault(cell, []).append(i)
            n += len(cells)
            if n > DEALT:
                yield rows()
                n = 0
        if held:
            yield rows()


def _fold(parts: list[bytes]) -> bytes:
    """The sizes of byte strings, then the strings."""
    return np.fromiter(map(len, parts), "<u4", len(parts)).tobytes() + b"".join(parts)


def _unfold(names: list[str], folded: bytes) -> Iterator[tuple[str, bytes]]:
    ends = np.cumsum(np.frombuffer(folded, "<u4", len(names)), dtype=np.int64) + 4 * len(names)
    begins = [4 * len(names), *ends[:-1].tolist()]
    return ((name, folded[a:b]) for name, a, b in zip(names, begins, ends.tolist()))


def decoder(path: str = MODEL):
    """A function from ids to text: pieces joined, byte pieces put together, marks spaces, the first one dropped."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else piece.replace(SPACE, " ").encode())

    def decode(ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text

    return decode


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids; no ids are an empty text, null ids a null one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_text = decoder(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if x is None else to_text(x) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(work, "doc_id long, text string")


def digester(path: str = MODEL):
    """A function from batches of doc_id and ids to those of ``digests``."""
    to_text = decoder(path)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        # Rows are cut out of the batch one at a time, as the ids of a batch are many.
        ends, flat = batch.column("ids").offsets.to_numpy(), batch.column("ids").values.to_numpy()
        sums, texts = [], []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            sums.append(zlib.crc32(flat[a:b].astype("<u4").tobytes()))
            texts.append(zlib.crc32(to_text(flat[a:b]).encode("utf-8", "surrogatepass")))
        columns = [batch.column("doc_id"), np.diff(ends).astype(np.int64), np.array(sums, np.int64), np.array(texts, np.int64)]
        return pa.record_batch(columns, schema=_DIGESTED)

    return digest


def digests(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 of the ids as little-endian unsigned 32-bit integers, and text_crc32 of the decoded text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = digester(path)
        for batch in batches:
            yield digest(batch)

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long")
