"""The index of test items against brute force."""

import random

from shelfweek.llm import decontaminate
from shelfweek.llm.decontaminate import Index


def _items(n, words=12):
    return [(i, " ".join(f"w{i}x{j}" for j in range(words))) for i in range(n)]


def _index(items):
    frequency = {}
    for _, text in items:
        for w in set(text.split()):
            frequency[w.encode()] = frequency.get(w.encode(), 0) + 1
    return Index(items, len(items), frequency)


def test_halves_of_two_neighbouring_items_are_not_searched_for(monkeypatch):
    index, asked = _index(_items(200)), []
    search = Index.search
    monkeypatch.setattr(Index, "search", lambda self, terms, *more: asked.append(terms) or search(self, terms, *more))
    words = [f"w{i}x{j}".encode() for i in (0, 1, 2) for j in range(4)]
    assert index.leaks(words) == {} and not asked
    words = [f"w1x{j}".encode() for j in range(12)] + [b"w7x0", b"w90x3"]
    assert set(index.leaks(words)) == {1} and asked == [{f"w1x{j}".encode() for j in range(12)}]


def test_groups_and_portions_do_not_change_what_is_found(monkeypatch):
    draw = random.Random(3)
    vocabulary = [f"t{k}" for k in range(80)]
    items = [(i, " ".join(draw.choices(vocabulary, k=14))) for i in range(150)]
    text = " ".join(" ".join(draw.choices(vocabulary, k=30)) + " " + items[draw.randrange(150)][1] for _ in range(60))
    words = [w.encode() for w in text.split()]
    fine = _index(items).leaks(words)
    monkeypatch.setattr(decontaminate, "BOUNDS", 1)  # the fewest groups, a half at a time
    index = _index(items)
    assert index.groups.shape[1] == decontaminate.GROUPS
    assert fine == index.leaks(words) and len(fine) > 20
