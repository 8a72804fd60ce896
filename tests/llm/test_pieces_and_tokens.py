import json
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from tokenizers import Tokenizer

from cohortspan.llm import sentence_pieces, token_files
from tests.conftest import TESTDATA
from tests.llm.conftest import documents


def best_path(unit, pieces, byte_zero, most):
    """By trying all paths from the left; of equal ones the one whose last piece is shorter."""
    reached = [(0.0, 0, [])]
    for end in range(1, len(unit) + 1):
        ways = []
        for start in range(max(0, end - most), end):
            part = unit[start:end]
            if part in pieces:
                i, score = pieces[part]
                ways.append((reached[start][0] + score, start, reached[start][2] + [i]))
            elif end - start == 1:
                data = part.encode()
                ways.append((reached[start][0] - sentence_pieces.PER_BYTE * len(data), start, reached[start][2] + [byte_zero + b for b in data]))
        reached.append(max(ways))
    return reached[-1][2]


def test_segments_are_best_paths(spark):
    rng = random.Random(1)
    table = sentence_pieces.piece_table(spark)
    pieces = {r.piece: (r.id, r.score) for r in table.collect()}
    most = max(map(len, pieces))
    byte_zero = sentence_pieces.first_byte()
    texts = [r.text for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect() if r.text]
    units = sorted({u for t in texts for u in sentence_pieces.units_of(t)})
    units = rng.sample(units, 300) + ["▁", "日本\U0001f600", "▁naïve", "zzzzzz"]
    frame = spark.createDataFrame([(u,) for u in units], "unit string")
    found = {r.unit: r.ids for r in sentence_pieces.segment(frame, table, byte_zero, most).collect()}
    assert found == {u: best_path(u, pieces, byte_zero, most) for u in units}


def long_unit_texts():
    rng = random.Random(3)
    pieces = [p for p, _, _ in sentence_pieces._pieces(sentence_pieces.sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL))]
    letters = [p for p in pieces if p.isalpha() and p.isascii()]
    joined = ["".join(rng.choices(letters, k=60))[:n] for n in (65, 130, 200, 400)]
    return [*joined, "=" * 200, "日本" * 100, "ab日" * 70, "é" * 65, "x" * 300]


def test_long_units_have_the_best_path_of_the_whole(spark):
    """Against a Viterbi over the uncut unit: cutting where no piece lies, and folding the rest, change nothing."""
    pieces = {p: (i, score) for p, i, score in sentence_pieces._pieces(sentence_pieces.sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL))}
    most, byte_zero = max(map(len, pieces)), sentence_pieces.first_byte()
    texts = long_unit_texts()
    found = {r.doc_id: list(r.ids) for r in sentence_pieces.encode(documents(spark, texts)).collect()}
    cut = 0
    for i, text in enumerate(texts):
        (unit,) = sentence_pieces._UNIT.findall("▁" + text)
        assert len(unit) > sentence_pieces.LONGEST
        cut += len(sentence_pieces.units_of(text)) > 1
        assert found[i] == best_path(unit, pieces, byte_zero, most), text
    assert cut


def test_round_trip(spark, odd, none):
    encoded = sentence_pieces.encode(odd)
    decoded = sentence_pieces.decode(encoded).collect()
    assert sorted((r.doc_id or 0, r.text) for r in decoded) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert sentence_pieces.encode(none).count() == 0
    spaces = ["  a  b ", "a▁b", "\n\n\ttab", "_under_score_", "é" * 200, "a.b,c!?"]
    decoded = sentence_pieces.decode(sentence_pieces.encode(documents(spark, spaces))).collect()
    assert {r.doc_id: r.text for r in decoded} == dict(enumerate(t.replace("▁", " ") for t in spaces))


def test_cells_do_not_matter(spark, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").where("doc_id < 40")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    whole = {r.doc_id: r.ids for r in sentence_pieces.encode(docs).collect()}
    monkeypatch.setattr(sentence_pieces, "CELL", 5_000)
    assert {r.doc_id: r.ids for r in sentence_pieces.encode(docs).collect()} == whole


def test_units_are_sent_once_a_cell_and_come_back_packed(monkeypatch):
    """However many cells a task sees and however much it has sent, and in fewer rows than there are units."""
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    frames = [pd.DataFrame({"cell": [c] * 4, "text": [" ".join(words)] * 4}) for c in range(5)]
    monkeypatch.setattr(sentence_pieces, "ROWS", 50)
    monkeypatch.setattr(sentence_pieces, "SENT", 150)
    sent = pd.concat(sentence_pieces._units_by_cell(sentence_pieces.MODEL)(iter(frames)))
    assert len(sent) == 500 and not sent.duplicated().any()
    rows = pd.DataFrame({"unit": ["a", "\n", "é日", "b"], "cells": [np.array(c) for c in ([1, 2], [2], [1], [3])], "ids": [np.array(x) for x in ([5], [6, 70000], [7, 8, 9], [])]})
    for dealt in (100, 2):
        monkeypatch.setattr(sentence_pieces, "DEALT", dealt)
        found = pd.concat(sentence_pieces._by_cell(iter([rows])))
        unpack = zstandard.ZstdDecompressor().decompress
        back = {(c, u, tuple(np.frombuffer(x, "<i4").tolist())) for c, n, i in zip(found["cell"], found["units"], found["ids"]) for u, x in sentence_pieces._unfold(json.loads(unpack(n)), unpack(i))}
        assert back == {(1, "a", (5,)), (2, "a", (5,)), (2, "\n", (6, 70000)), (1, "é日", (7, 8, 9)), (3, "b", ())}
    assert len(found) <= 5


def test_words_are_spelled_as_their_units(monkeypatch):
    """Whatever is remembered of a cell's words, whatever its hashes do, and with long units among the words."""
    texts = ["a b", None, "", " ", "  a  b ", "a▁b", "c.d, e\n\n f", "é" * 64 + " a", "=" * 200, "x" * 63, *["w%d, v%d" % (i, i % 7) for i in range(40)]]
    known = {u: np.arange(1 + i % 3) + 10 * i for i, u in enumerate(sorted({u for t in texts for u in sentence_pieces.units_of(t)}))}
    short = [u for u in known if len(u) <= sentence_pieces.LONGEST]
    rows = pd.DataFrame({"unit": short, "cells": [np.array([1])] * len(short), "ids": [known[u] for u in short]})
    packed = pd.concat(sentence_pieces._by_cell(iter([rows])))
    longer = sentence_pieces.long_units(sentence_pieces.MODEL)
    ids = {u: longer.ids(u) if len(u) > sentence_pieces.LONGEST else x.astype("<i4").tobytes() for u, x in known.items()}
    expected = [b"".join(ids[u] for u in sentence_pieces.units_of(t)) for t in texts]
    for words in (3, 10_000):
        monkeypatch.setattr(sentence_pieces, "WORDS", words)
        cell = sentence_pieces.CellIds(zip(packed["units"], packed["ids"]), sentence_pieces.MODEL)
        assert [x for t in texts for x in cell([t])] == expected and cell(texts) == expected
    hashes = sentence_pieces.CellIds._hashes
    monkeypatch.setattr(sentence_pieces.CellIds, "_hashes", lambda self, units: hashes(self, units) if self.salt > 1 else np.zeros(len(units), np.int64))
    cell = sentence_pieces.CellIds(zip(packed["units"], packed["ids"]), sentence_pieces.MODEL)
    assert cell.salt == 2 and cell(texts) == expected


def test_digests_are_made_where_the_ids_are(spark, odd):
    """Equal to those of the encoded rows, and without a second pass of Python over them."""
    digested = sentence_pieces.encode(odd, digested=True)
    assert sorted(map(str, digested.collect())) == sorted(map(str, sentence_pieces.digests(sentence_pieces.encode(odd)).collect()))
    assert digested._jdf.queryExecution().optimizedPlan().nodeName() == "FlatMapCoGroupsInArrow"
    ids = (1 << 53) + 1
    assert [r.doc_id for r in sentence_pieces.encode(documents(spark, {ids: "a"}).union(documents(spark, {2: "b"})), digested=True).orderBy("doc_id").collect()] == [2, ids]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    sizes = [1, 2, 17, token_files.BLOCK, token_files.BLOCK, int(rng.integers(1, token_files.BLOCK))]
    blocks = [rng.zipf(1.2, n) % 50257 for n in sizes] + [np.full(token_files.BLOCK, 65535), np.arange(700) % 5, rng.integers(0, 65536, 900)]
    coded = token_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded)))
    # Each block stands alone.
    assert (token_files.decode_blocks(coded[3:4])[0] == blocks[3]).all()
    assert len(coded[7]) < 250


def test_damage_is_found():
    blocks = [np.arange(500) * 7 % 50257, np.arange(300)]
    coded = token_files.encode_blocks(blocks)
    for at in (20, 100, len(coded[0]) - 10):
        broken = bytearray(coded[0])
        broken[at] ^= 5
        with pytest.raises(ValueError):
            token_files.decode_blocks([bytes(broken), coded[1]])
    record = bytearray(token_files.pack_records([(np.array([4]), np.array([500]), blocks[0])])[0])
    record[18] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_records([bytes(record)])


TEXTS = ["", " ", "a", "  a  b\n\nc ", "x\ty \n z", "<|endoftext|> hi", "it's we'll", "a. b, c.d,e ,", "\x01 \x1c\u2028 \xa0", "\r\n line", "é. ü, 日本."]


def test_words_encode_like_texts(spark, monkeypatch):
    texts = TEXTS + [r.text or "" for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()]
    plain = Tokenizer.from_file(token_files.TOKENIZER)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = token_files.WordEncoder(token_files.TOKENIZER)
    assert [x.tolist() for x in encoder(texts)] == expected
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder = token_files.WordEncoder(token_files.TOKENIZER)
    assert [encoder([t])[0].tolist() for t in texts] == expected


@pytest.mark.parametrize("cells, record", [(1, 1 << 16), (5, 40)])
def test_files(spark, odd, none, monkeypatch, cells, record):
    monkeypatch.setattr(token_files, "RECORD", record)
    found = token_files.read_tokens(spark, token_files.write_tokens(odd, cells=cells), with_ids=True).collect()
    plain = Tokenizer.from_file(token_files.TOKENIZER)
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, expected = 0, []
    for doc_id, text in rows:
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert token_files.read_tokens(spark, token_files.write_tokens(none, cells=cells)).count() == 0
