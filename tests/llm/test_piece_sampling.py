from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mycelia.llm import piece_sampling as S
from mycelia.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"


def own():
    return S.sampler(tokenizer_path(MODEL), 1.0, 0)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_lossless(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    s = own()
    for t, x in zip(texts, s.encode(texts, list(range(len(texts)))), strict=True):
        assert s.pieces.decode(ids(x)) == t


def test_model_agrees():
    """The pieces are the model's own: its decoder gives the text back too."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    for text in ("Hello there, world", "  two  spaces", "line\nbreak é 中"):
        assert model.decode(ids(own().encode([text], [3])[0])) == text


def test_distribution():
    """Draws of kept units and of long ones follow the weights of all paths."""
    s, unit = own(), " things"
    arcs = s.pieces.arcs(unit)

    def paths(j):
        return [((), 1.0)] if j == 0 else [(p + x, v * w) for i, x, w in arcs[j] for p, v in paths(i)]

    every = dict(paths(len(unit)))
    total = sum(every.values())
    drawn = Counter(tuple(ids(x)) for x in s.encode(["things"] * 20_000, list(range(20_000))))
    long = Counter(tuple(s._long(unit, k, 0)) for k in range(4000))
    assert set(drawn) | set(long) <= set(every)
    assert max(abs(drawn[p] / 20_000 - w / total) for p, w in every.items()) < 0.015
    assert max(abs(long[p] / 4000 - w / total) for p, w in every.items()) < 0.03


def test_same_in_any_batch():
    texts = ["some words and others", "x" * 60 + " tail", "", "some words and others"]
    s, t = S.Sampler(S.Pieces(tokenizer_path(MODEL))), own()
    apart = [s.encode([x], [k])[0] for k, x in list(enumerate(texts))[::-1]][::-1]
    assert apart == t.encode(texts, [0, 1, 2, 3])
    assert t.encode([texts[0]] * 2, [7, 7])[0] == t.encode([texts[0]], [7])[0]
    assert len({bytes(x) for x in t.encode([texts[0]] * 30, list(range(30)))}) > 1


def test_odd(odd, none):
    rows = S.decode(S.encode(odd)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in rows) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert all(r["n_pieces"] == len(r["ids"]) for r in rows)
    assert S.decode(S.encode(none)).count() == 0


def test_long_unit_in_stretches(monkeypatch):
    """A draw for a long unit doesn't depend on its stretches, and follows the weights of all paths."""
    s = own()
    unit = "internationalisationsverfahrensbeschleunigung" * 3
    want = s._long(unit, 5, 2)
    for stretch in (1, 7, 16, 50):
        monkeypatch.setattr(S, "STRETCH", stretch)
        assert s._long(unit, 5, 2) == want
    assert b"".join(s.pieces.bytes[k] for k in want).decode() == unit
    arcs = s.pieces.arcs("abcab")

    def paths(j):
        return [((), 1.0)] if j == 0 else [(p + x, v * w) for i, x, w in arcs[j] for p, v in paths(i)]

    every = dict(paths(5))
    drawn = Counter(tuple(s._long("abcab", k, 0)) for k in range(6000))
    assert max(abs(drawn[p] / 6000 - w / sum(every.values())) for p, w in every.items()) < 0.03


def test_cuts_cross_no_piece():
    s = own()
    for unit in ("数据获取一个文字列表" * 5, "x" * 40, "中" * 100, " ünïcödé🙂🙂²½²." * 4, "a1b2" * 20):
        parts = s.cut(unit)
        assert "".join(parts) == unit
        edges = {sum(map(len, parts[:k])) for k in range(1, len(parts))}
        crossed = {m for j, own_ in enumerate(s.pieces.arcs(unit)) for i, _, _ in own_ for m in range(i + 1, j)}
        assert edges == set(range(1, len(unit))) - crossed
    assert max(map(len, s.cut("文字列表中数据" * 100))) <= 4


def test_long_texts_in_parts(monkeypatch):
    """Parts of a text get the ids that the whole gets."""
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["word", "andere", "数据获取一个🙂", "x" * 70, "12.5²", "don't", "é\n"], 800))
    want = own().encode([text, "short"], [9, 1])
    monkeypatch.setattr(S, "DRAW", 50)
    got = S.Sampler(S.Pieces(tokenizer_path(MODEL))).encode([text, "short"], [9, 1])
    assert got == want and own().pieces.decode(ids(got[0])) == text


def test_every_piece_is_in_the_lattice():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    normal = [k for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    assert sorted(own().pieces.ids.values()) == normal
