"""The fast way to tokens: same ids as the plain one, whatever the white space, without a look-ahead."""

import random
import re

import public_tokenizers as p
from framelake.llm import packing


def encoders():
    file, ranks = p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")
    return packing.encoder(file, ranks, p.PATTERN), packing.encoder(file, None, None)


def test_white_space_and_marks_in_any_order():
    fast, whole = encoders()
    assert packing._PATTERN == p.PATTERN
    rnd = random.Random(8)
    parts = [" ", "  ", "\n", "\n\n", "\r\n", "\t", " \n", "word", "Été", "ß", "12", "½", "'s", "'", "ll", "'re", "!", "...", "«", "¬", "_", "x'd", "ǅ"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert fast(text).tolist() == whole(text).tolist(), text


def test_plain_texts_are_told_as_before():
    told = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]|<\|endoftext\|>|[^ \n]{400}|\s{400}")
    rnd = random.Random(9)
    for n in [399, 400, 401, 799, 1200]:
        for run in ["a" * n, " " * n, "\n" * n, "\t" * n, "\t " * (n // 2), "a\t" * (n // 2)]:
            for before in ["", "b ", "b", "\n", " " * rnd.randrange(40) + "c"]:
                for after in ["", " d", "d", "\t", "\n d" * 300]:
                    assert packing.plain(before + run + after) != bool(told.search(before + run + after))
    for text in ["", "a<|endoftext|>b", "\x0b", "日", " ", "\x7f", "ɐ"]:
        assert packing.plain(text) != bool(told.search(text))


def test_known_pattern_runs_without_look_ahead(monkeypatch):
    import tiktoken

    seen, made = [], tiktoken.Encoding
    monkeypatch.setattr(tiktoken, "Encoding", lambda *a, **k: seen.append(k["pat_str"]) or made(*a, **k))
    monkeypatch.setattr(packing, "_LOADED", {})
    assert encoders()[0]("a  b").tolist() == packing.encoder(p.path("byte_bpe_50k.json"), None, None)("a  b").tolist()
    assert seen and "(?!" not in seen[0]
