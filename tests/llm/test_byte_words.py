"""Plain words are merged without the pattern where that is safe, and ids stay those of the library."""

import json
import random

from array import array

from sparkloom.llm import byte_tokens, queries


def texts(seed):
    draw = random.Random(seed)
    part = ["the", "Été", "straße", "ǅeta", "don't", "'st", "x", "AB", ".", ",!", "?;:", "7", "a1", "$$$", " ", "中", "\t", "é", "<|endoftext|>", "ı", "×"]
    return ["".join(draw.choice(part) + draw.choice(["", "", " ", " ", " ", "\n", ". ", "  ", "\n\n"]) for _ in range(draw.randrange(30))) for _ in range(400)]


def same(encoder):
    some = [*texts(1), None, "", "\n", " ", "the the", "the\nthe"]
    want = [array("H", e.ids).tobytes() for e in encoder.library.encode_batch([t or "" for t in some], add_special_tokens=False)]
    assert list(encoder.encode(some)) == want and list(encoder.encode([])) == []


def test_plain_words_need_no_pattern():
    encoder = byte_tokens.ByteTokens(queries.BYTE_BPE)
    assert encoder.bare is not None
    same(encoder)
    same(byte_tokens.ByteTokens(queries.BYTE_BPE, special_as_text=True))


def test_a_vocabulary_that_crosses_keeps_the_pattern(tmp_path):
    own = json.load(open(queries.BYTE_BPE, encoding="utf-8"))
    last = max(own["model"]["vocab"].values())
    first = own["model"]["merges"][0]
    own["model"]["vocab"]["e."] = last + 1
    own["model"]["merges"].insert(0, ["e", "."] if isinstance(first, list) else "e .")
    path = tmp_path / "crossing.json"
    path.write_text(json.dumps(own), encoding="utf-8")
    encoder = byte_tokens.ByteTokens(str(path))
    assert encoder.bare is None
    same(encoder)
