import random

import numpy as np
import public_tokenizers
import regex

from panelweave.llm import pretokens

ODD = [*" \n\t\r   aabstmdrevell''''ABéèß漢字🎉129.,!?_-²ª\0\x1c\x85\xa0\u2003\u3000\u180e\ufdd0", "'s", "'re", "'ll", " '", "\u3000\u3000"]


def both(texts):
    raws = [text.encode() for text in texts]
    sizes = np.array([len(raw) for raw in raws])
    buffer = b"\n".join(raws)
    starts, ends = pretokens.borders(np.frombuffer(buffer, dtype=np.uint8), np.cumsum(sizes + 1) - sizes - 1)
    found = [buffer[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
    return found, [token for text in texts for token in regex.findall(public_tokenizers.PATTERN, text)]


def test_pattern_is_the_vocabulary_s():
    assert pretokens.PATTERN == public_tokenizers.PATTERN


def test_edges_of_texts():
    for texts in ([""], ["", ""], [" "], ["'"], ["'r", "e"], ["a ", "b"], [" \n", " a", "", "a  ", "'", "s"], ["\u3000", "a"]):
        found, wanted = both(texts)
        assert found == wanted, texts


def test_borders_of_random_texts():
    rng = random.Random(4)
    for _ in range(60):
        found, wanted = both(["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(40)])
        assert found == wanted


def test_every_character():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    random.Random(5).shuffle(points)
    texts = ["".join(points[i : i + 5000]) for i in range(0, len(points), 5000)]
    found, wanted = both(texts)
    assert found == wanted
