"""Deciding while reading gives the same spans as one decision over the whole text."""

import random

from scholargraph.llm import pii


def test_any_window_gives_the_same():
    rnd = random.Random(9)
    for n in (0, 1, 50, 3_000):
        at, cluster = 0, []
        for _ in range(n):
            at += rnd.choice((0, 0, 1, 2, 9))
            cluster.append((max(0, at - rnd.randint(1, 40)), at, rnd.choice((0.5, 1.0, rnd.random() * 3)), rnd.randrange(4)))
        cluster = [c for c in cluster if c[0] < c[1]]
        want = pii._chosen(cluster)
        for window in (1, 2, 7, 100):
            best, got, most = pii.Segments(window), [], 0
            for c in cluster:
                if len(best.ends) > best.patience:
                    got += best.settled(c[1] - 40)
                best.add(*c)
                most = max(most, len(best.ends))
            assert got + best.settled(at) == want
            assert most < max(2 * window, 300)


def test_windows_of_whole_texts(monkeypatch):
    field = pii.Field(*pii.shipped())
    rnd = random.Random(3)
    text = " ".join(pii.sentence(rnd)[0] for _ in range(300)) + " " + " ".join(f"+{k % 70 + 20} {k % 900 + 100} {k * 7919 % 9_000_000 + 1_000_000}" for k in range(500))
    want = field.spans(text, [])
    assert len(want) > 400
    for window in (1, 10, 1_000):
        monkeypatch.setattr(pii, "WINDOW", window)
        assert field.spans(text, []) == want


def test_a_local_part_that_is_too_long_is_no_candidate():
    """It isn't cut to a span that starts inside a word."""
    made = list(pii.mails("x" * 80 + "@example.com and " + "y" * 60 + " (at) example.com"))
    assert [s for s, _, _ in made] == [97]
