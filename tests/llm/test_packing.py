import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from colloquy.llm import packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EDGE = ["", None, "a", " a", "a   b", "é è", "x  y", "it's we'll don't 's a", "tab\t x\n\ny \n z\n", "\n", "a  b 　c", "日本 語", "a.b c,d' e'f", "<|endoftext|> a", "×a ÷ ñ", "a\x0bb\x1cc d", "\x85 a \x85b", "ΑΣ ΟΔΟΣ.", "!!! a!! ''s 'S", "́a", "ab " * 3000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_tokenizers(path):
    enc = tokens.encoder(path)
    ids, bounds = enc(pa.array(EDGE), 7)
    for i, text in enumerate(EDGE):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [7]


def test_first_fit_matches_a_plain_scan():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    tree, free = packing.Tournament(len(sizes), 64), [64] * len(sizes)
    for s in sizes:
        want = next(i for i, f in enumerate(free) if f >= s)
        free[want] -= s
        assert tree.first_fit(s) == want


def test_groups_cover_every_token_once():
    rng = random.Random(2)
    lengths = [rng.choice([1, 5, 64, 65, 200, rng.randint(1, 90)]) for _ in range(400)]
    pieces = packing.pack_group(lengths, 64, 4)
    for doc, n in enumerate(lengths):
        at = 0
        for _, start, size, _, _ in sorted(p for p in pieces if p[0] == doc):
            assert start == at
            at += size
        assert at == n
    used = len({p[3] for p in pieces})
    assert used * 64 - sum(lengths) < 4 * used + 64


def test_pack(spark):
    rows = [(i, t, "src") for i, t in enumerate(EDGE)] + [(3, " a", "src"), (None, "null id", "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = packing.pack(docs, BYTE, emit_ids=True).collect()
    enc = tokens.encoder(BYTE)
    want = {i: enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows if i != 3}
    for i, ids in want.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) for r in mine)
    assert sum(r.doc_id == 3 for r in got) == 2
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), BYTE).count() == 0
