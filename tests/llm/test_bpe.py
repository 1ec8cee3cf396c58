import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeferry.llm.bpe import ByteBPE, codec, decoded, digest, encoded

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "\n\n  x", "it's we'll 1234 ab12", "naïve Übermaß ñandú", "\x00\x1c\x85　  z", "🙂🙂 👩‍👩‍👧", "a" * 5000, "!?" * 900, "<|endoftext|>", "▁_▁ Ġ"]


def test_equals_tiktoken():
    own = codec(DATA, public_tokenizers.PATTERN)
    for text in ODD:
        assert own.encode(text) == TIKTOKEN.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_each_token_of_the_vocabulary():
    own = codec(DATA, public_tokenizers.PATTERN)
    for token, rank in RANKS.items():
        assert own.bytes_of[rank] == token
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert own.encode(text) == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_round_trip(text):
    own = codec(DATA, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_frames(spark):
    bpe = ByteBPE(spark, PATH, public_tokenizers.PATTERN)
    rows = [(k, t, "x") for k, t in enumerate([*ODD, "again", "again", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = {r.doc_id: r for r in digest(df, bpe).collect()}
    for k, t, _ in rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = decoded(encoded(df, bpe), bpe)
    assert back.columns == [*df.columns, "ids", "decoded"] and back.count() == len(rows)
    assert digest(df.where("doc_id < 0"), bpe).count() == 0
