"""Windows of many texts at once."""

import random

from epochwise.llm import decontaminate

WORDS = "3 4 + - * = Bob Alice. the of runs 5kg km $3.50 twelve ( ) (+) Paris. Rome! and x y z -- ...".split()


def listed(texts):
    h, text, at, kind, words = decontaminate.windows_of(texts)
    sizes = [min(decontaminate.WINDOW, int(n)) for n in words.count]
    return sorted(
        (i, hash_, a - int(words.begin[i]), k, words.values(a, sizes[i], k))
        for hash_, i, a, k in zip(h.tolist(), text.tolist(), at.tolist(), kind.tolist())
    )


def test_no_window_reaches_into_another_text():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30]))) for _ in range(400)]
    apart = []
    for i, text in enumerate(texts):
        apart += [(i, *row[1:]) for row in listed([text])]
    assert listed(texts) == apart
    assert listed([]) == [] and listed(["", " "]) == []


def test_portions_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(decontaminate, "PORTION", 10)
    texts = ["a" * n for n in (0, 4, 6, 1, 25, 3, 0, 12)]
    ranges = list(decontaminate._portions(texts))
    assert [i for a, z in ranges for i in range(a, z)] == list(range(8))
    assert all(z - a == 1 or sum(map(len, texts[a:z])) <= 10 for a, z in ranges)
    assert list(decontaminate._portions([])) == []
