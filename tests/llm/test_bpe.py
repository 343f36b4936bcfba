import json
import os
import random

import numpy as np
import pytest

from lexiflow.llm import bpe as B
from lexiflow.llm.bpe import DEFAULT_FILE, Encoder, encode, token_counts

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_FILE), reason="no tokenizer file")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(DEFAULT_FILE)
    t.encode_special_tokens = True
    return t


SPECIAL = ["", None, " ", "\n", "  ", "it's 'tis we'll  \n\n x 's'd !'s \n's   ", "aaaaaaaaa'll'llama'lls", "<|endoftext|> x", "\t\t x\r\n", "\U0010ffff a\U0010ffffb", "don't'rec 'vex'ves'S", "=" * 5000, "7" * 3000, "ab" * 40_000]


def test_like_the_public_library(public):
    rng = random.Random(0)
    alphabet = "a's t'rell ve\n\t  !1é中٣\U0001f600‍  　'\u0085"
    texts = SPECIAL + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(1, 0x3000)]
    ids, counts = Encoder().batch(texts)
    at = 0
    for t, n, want in zip(texts, counts, public.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == want.ids, t
        at += n


def test_rows_round_trip(spark, public):
    rows = list(enumerate(SPECIAL)) + [(3, "\n"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS tokens").repartition(3)
    got = encode(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["ids"] for r in got}
    assert by_id[0] == by_id[1] == []
    for i, t in enumerate(SPECIAL):
        assert public.decode(by_id[i], skip_special_tokens=False) == (t or "")
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df, "doc_id", "text").collect()} == {k: len(v) for k, v in by_id.items()}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_small_caches_change_nothing(monkeypatch):
    from lexiflow.llm import bpe

    texts = [f"word{i} and more {i * 7}" for i in range(400)]
    want = Encoder().batch(texts)[0].tolist()
    monkeypatch.setattr(bpe, "KNOWN", 20)
    monkeypatch.setattr(bpe, "PIECE", 64)
    assert Encoder().batch(texts)[0].tolist() == want


def test_the_file_is_a_parameter(tmp_path):
    with open(DEFAULT_FILE, encoding="utf-8") as f:
        data = json.load(f)
    data["model"]["merges"] = []
    (tmp_path / "bytes.json").write_text(json.dumps(data), encoding="utf-8")
    assert Encoder(str(tmp_path / "bytes.json")).batch(["abc é"])[1].tolist() == [6]


def test_equal_hashes_of_different_characters(monkeypatch):
    """With a first hash that tells nothing but the length apart, the second one does."""
    texts = ["The old book held a note, and the new one didn't.", "cat act tca, god dog", "ab ba ab", "naïve café 1234 4321"]
    want = [B.Encoder().batch([t])[0].tolist() for t in texts]
    real = B._mixed
    monkeypatch.setattr(B, "_mixed", lambda which: real(1) if which else np.zeros(0x110000, dtype=np.uint64))
    own = B.Encoder()
    for _ in range(2):
        ids, counts = own.batch(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
