import math
import struct

import duckdb
import numpy as np
import pytest
import sentencepiece

from duelframe.llm import language_id, sentencepiece_codec as codec
from duelframe.llm.common import settle
from duelframe.llm.pieces import Pieces

from ..conftest import SF

HARD = ["", " ", "  a  b ", "日本語テスト 😀é\n\n\tx", "▁x ▁▁ y", "ab" * 50, "\x00\x7f", "a" * 9000, "The and attion to thanedble the, anea."]


@pytest.fixture(scope="module")
def pieces():
    return codec.load()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


@pytest.fixture(scope="module")
def library(pieces):
    """The public library with the same pieces and scores, as a Unigram model."""
    model = sentencepiece.SentencePieceProcessor(model_file=codec.public_tokenizers.path(codec.MODEL))
    out = b""
    for i, surface in enumerate(pieces.surfaces):
        kind = 2 if model.is_unknown(i) else 3 if model.is_control(i) else 6 if model.is_byte(i) else 1
        out += field(1, field(1, surface.encode()) + varint(2 << 3 | 5) + struct.pack("<f", pieces.scores[i]) + varint(3 << 3) + varint(kind))
    out += field(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
    out += field(3, field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def short_texts():
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    return HARD[:7] + [line for t in texts for line in t.split("\n")[:3] if len(line) < 1500]


def test_same_pieces_as_the_library(pieces, library):
    texts = short_texts()
    found = codec.Encoder(pieces).encode(texts)
    assert len(texts) > 200 and [list(ids) for ids, _ in found] == [library.encode(t) for t in texts]


def test_round_trip(pieces):
    for (ids, _), text in zip(codec.Encoder(pieces).encode(HARD), HARD):
        assert codec.decode(pieces, ids) == text.replace("▁", " ")


def test_common_chunks_are_solved_once_however_small_the_cache(pieces):
    texts = [f"every row has the same common words and row{k} alone" for k in range(40)]
    small, solved = codec.Encoder(pieces, limit=12), []
    learn = small._learn
    small._learn = lambda new: (solved.extend(new), learn(new))
    found = [small.encode([t])[0] for t in texts]
    assert found == codec.Encoder(pieces).encode(texts)
    assert len(solved) == len(set(solved)) and len(small.known) + len(small.older[0]) < 40


def tiny(surfaces, byte=True):
    names = ["<unk>"] + surfaces + ([f"<0x{b:02X}>" for b in range(256)] if byte else [])
    usable = np.array([0 < i <= len(surfaces) for i in range(len(names))])
    scores = -np.log(np.arange(len(names)) + 2.0)
    return Pieces(names, scores, usable, {b: 1 + len(surfaces) + b for b in range(256)} if byte else {}, 0)


def segmentations(p, text):
    """All segmentations into (piece, score) with the fallback of single characters."""
    if not text:
        yield []
        return
    index = {s: i for i, s in enumerate(p.surfaces) if 0 < i and not s.startswith("<0x")}
    for k in range(1, len(text) + 1):
        if text[:k] in index:
            yield from ([index[text[:k]], *rest] for rest in segmentations(p, text[k:]))
        elif k == 1:
            yield from ([-ord(text[0]), *rest] for rest in segmentations(p, text[1:]))


@pytest.mark.parametrize("byte", [True, False])
def test_best_path_and_sum_against_all_segmentations(byte):
    p = tiny(["a", "b", "ab", "ba", "aab", "▁", "▁a", "▁ab"], byte)
    chunks = ["▁aabab", "abba", "bbaab", "▁zé", "zazb", "a"]
    ids, offsets, scores = p.lattice(chunks).best()
    probabilities = np.stack([np.linspace(1, 2, len(p.surfaces)), np.linspace(3, 1, len(p.surfaces))], 1)
    probabilities /= probabilities.sum(0)
    log, of_byte = language_id._log(p, probabilities)
    sums = language_id.forward(p, chunks, log, of_byte)
    uses = language_id.expected(p, chunks, np.ones((len(chunks), 2)), log, of_byte)
    wanted = np.zeros_like(uses)
    for k, chunk in enumerate(chunks):
        paths = list(segmentations(p, chunk))
        value = [sum(p.scores[i] if i > 0 else p.unknown_score for i in path) for path in paths]
        assert scores[k] == pytest.approx(max(value))
        spelled = [i for j in paths[value.index(max(value))] for i in ([j] if j > 0 else [p.byte_ids.get(b, 0) for b in chr(-j).encode()] if byte else [0])]
        assert ids[offsets[k]:offsets[k + 1]].tolist() == spelled
        for language in range(2):
            like = [sum(log[i, language] if i > 0 else sum(of_byte[b, language] for b in chr(-i).encode()) for i in path) for path in paths]
            total = math.log(sum(map(math.exp, like)))
            assert sums[k, language] == pytest.approx(total)
            for path, one in zip(paths, like):
                for i in path:
                    if i > 0:
                        wanted[i, language] += math.exp(one - total)
    assert np.allclose(uses, wanted)


def test_pieces_that_cross_spaces_keep_texts_whole():
    p = tiny(["a", "b", "▁", "a▁b"])
    assert [p.surfaces[i] for i in codec.Encoder(p).encode(["a b"])[0][0]] == ["▁", "a▁b"]


def test_encode_table(spark, pieces):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "x"), (3, "", "x"), (4, "w " * 50_000, "x")]
    docs = settle(spark).createDataFrame(rows, "doc_id long, text string, ids string")
    coded = codec.encode(docs, pieces)
    found = {(r.doc_id, r.n_tokens > 0, r.round_trip) for r in coded.collect()}
    assert found == {(1, False, True), (None, True, True), (3, False, True), (4, True, True)} and coded.count() == 5
    texts = codec.decode_column(coded, pieces).collect()
    assert sorted(r.text for r in texts) == sorted((t or "") for _, t, _ in rows)
    assert codec.encode(docs.limit(0), pieces).count() == 0


def test_language_held_out(spark, pieces):
    docs = settle(spark).read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify(docs, pieces).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 200 and len(held) > 30 and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_edge_cases(spark, pieces):
    english, french = "the and of with this that for are was " * 20, "le la les des une que pour dans est " * 20
    rows = [(k, (english, french)[k % 2], ("en", "fr")[k % 2], "a") for k in range(40)]
    rows += [(None, english, "xx", "a"), (100, None, "yy", "a"), (101, "12 -- 34", None, "a"), (102, "", None, "a"), (103, "que les des", None, "a"), (103, "que les des", None, "a")]
    docs = settle(spark).createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = sorted(((r.doc_id if r.doc_id is not None else -1, r.held_out, r.lang_pred) for r in language_id.identify(docs, pieces, rounds=1).collect()))
    assert [x for x in found if x[0] < 0 or x[0] > 99] == [(-1, False, "en"), (100, found[-5][1], "und"), (101, found[-4][1], "und"), (102, found[-3][1], "und"), (103, found[-1][1], "fr"), (103, found[-1][1], "fr")]
    kept = language_id.keep_identified(docs, pieces, rounds=1)
    assert kept.columns == docs.columns and kept.count() == 43
    unlabelled = docs.select("doc_id", "text", docs["lang"].substr(1, 0).alias("lang")).filter("doc_id > 100").replace("", None, ["lang"])
    assert {(r.lang_pred, r.score) for r in language_id.identify(unlabelled, pieces).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), pieces).count() == 0


def test_letters_are_letters():
    assert [language_id.has_letter(t) for t in ("½ ² ①", "Ⅷ", "12_3 !", "", "é", "½a", "中", "ª")] == [False, False, False, False, True, True, True, True]
