import struct
from collections import defaultdict

import pytest
from llm.cases import SCHEMA, awkward_documents, with_clashing

from credsieve.llm import packing

pytest.importorskip("public_tokenizers")


def encode(text):
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        tokenizer = _tokenizer
    except NameError:
        tokenizer = _tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_words_give_the_ids_of_the_text():
    ids = packing.WordIds(packing.default_tokenizer())
    for text in ["", " ", "Don't STOP-me 123 né é <|endoftext|>a\tb c", "ΑΣ ΑΣ.\r\nx\x1cy  z'll"]:
        assert list(struct.unpack(f"<{len(ids.of(text)) // 4}I", ids.of(text))) == encode(text)[:-1]


def test_forgotten_words_are_looked_up_again(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    ids = packing.WordIds(packing.default_tokenizer())
    for text in ["a b c d e", "a b", "e f g a"]:
        assert list(struct.unpack(f"<{len(ids.of(text)) // 4}I", ids.of(text))) == encode(text)[:-1]


def test_pieces_are_an_exact_round_trip(spark):
    rows = awkward_documents()
    docs = with_clashing(spark, rows).repartition(5)
    pieces = packing.pack(docs, sequence=256).collect()
    sequences = defaultdict(list)
    texts = defaultdict(list)
    for p in pieces:
        ids = list(struct.unpack(f"<{p.length}I", bytes(p.ids)))
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[str(p.doc_id), p.doc_tokens, (p.sequence_id * 256 + p.offset) - p.start].append((p.start, ids))
    got = sorted((d, [i for _, part in sorted(parts) for i in part]) for (d, _, _), parts in texts.items())
    assert got == sorted((str(r[0]), encode(r[1])) for r in rows)
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1))
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or number == last


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
