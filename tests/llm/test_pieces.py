import hashlib

import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from hedra.llm.piece_encoding import PieceModel, encode_pieces
from hedra.llm.queries import piece_model
from tests.llm.texts import corpus, edge_rows, edges, empty

TEXTS = ["Hello  world", "  two  spaces ", "tab\tand\nline\n\nend", "日本語テキスト", "\U0001f600\U0001f600 é è ﬁ ½", "▁mark▁", "a\x00b", "x" * 500, "Ünïcödé " * 50, "​﻿", " ", "1,234.56", "<s></s><unk>", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_proto=piece_model())


def test_same_as_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *(t for _, t in corpus())])]
    got = encode_pieces(spark.createDataFrame(rows, "doc_id bigint, text string"), piece_model(), slice_bytes=3000).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]][1]
        ids = library.encode(text)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids), text
        raw = text.encode()
        spans = list(zip(r["begins"], r["ends"], strict=True))
        assert all(0 <= a <= b <= len(raw) for a, b in spans) and all(x[1] <= y[1] for x, y in zip(spans, spans[1:], strict=False))
        assert not spans or spans[-1][1] == len(raw)


def test_alignment_of_normalised_text():
    model = PieceModel(piece_model())
    for text in TEXTS:
        normal, where = model.normalise(text)
        assert len(where) == len(normal.encode()) + 1 and (where[1:] >= where[:-1]).all()


def test_a_character_map_and_squeezed_blanks(spark):
    """The same model with the map and the rules for blanks of the library's own normaliser: ids, text and spans."""
    rule = SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=True, add_dummy_prefix=True, escape_whitespaces=True).serialized_model_proto()
    data = piece_model() + rule
    model, own = PieceModel(data), SentencePieceProcessor(model_proto=data)
    assert model.chars.units and model.squeeze
    more = ["ﬁne ½ ＡＢＣ　全角 ①", "  a   b  ", "e\u0301 가 ｶﾞ", "\u00a0x\u2003y\t\nz", "Ⅷ ㎏ ™ ﷺ", "\u200bzero\ufeff", "   "]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *more])]
    got = encode_pieces(spark.createDataFrame(rows, "doc_id bigint, text string"), data, slice_bytes=200).collect()
    for r in got:
        text = rows[r["doc_id"]][1]
        assert r["ids"] == own.encode(text) and r["decoded"] == own.decode(r["ids"]), text
        raw = text.encode()
        for a, b in zip(r["begins"], r["ends"], strict=True):
            assert 0 <= a <= b <= len(raw)
    normal, where = model.normalise("ﬁ x")
    assert normal == "▁fi▁x" and where.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 5]


def test_edges(spark, library):
    got = encode_pieces(edges(spark), piece_model()).collect()
    want = sorted(hashlib.sha256(",".join(map(str, library.encode(t[1] or ""))).encode()).hexdigest() for t in edge_rows())
    assert sorted(hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in got) == want
    assert encode_pieces(empty(spark), piece_model()).collect() == []
